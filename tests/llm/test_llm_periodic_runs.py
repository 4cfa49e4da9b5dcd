import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fixfold.llm import periodic_runs as R
from llm_fixtures import edge_docs, edge_rows, empty_docs, frame, prose


def brute_runs(words, shortest=12):
    """By definition: for every period the widest stretches, kept with their smallest period."""
    n, least = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, 2 * q):
                least.setdefault((i, j + q), q)
            i = j
    return sorted(((a, b - a, q) for (a, b), q in least.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in dropped)


periodic = st.builds(lambda head, unit, times, cut, tail: head + (unit * times)[:max(len(unit) * times - cut, 0)] + tail,
                     st.lists(st.integers(0, 2), max_size=8), st.lists(st.integers(0, 2), min_size=1, max_size=9),
                     st.integers(1, 9), st.integers(0, 5), st.lists(st.integers(0, 2), max_size=8))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(periodic, max_size=3).map(lambda parts: [w for p in parts for w in p]), max_size=5),
       st.sampled_from([2, 3, 5, 12]))
def test_runs_equal_the_definition(texts, shortest):
    assert R.runs_of(texts, shortest) == [brute_runs(t, shortest) for t in texts]


def test_runs_of_random_and_fibonacci_words():
    r = random.Random(5)
    texts = [[r.randrange(k) for _ in range(n)] for k in (1, 2, 3) for n in (0, 1, 11, 12, 13, 60, 200)]
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    texts += [b, b[::-1], [0] * 400, [0, 1] * 100 + [2] + [0, 1] * 100]
    for shortest in (2, 6, 12):
        assert R.runs_of(texts, shortest) == [brute_runs(t, shortest) for t in texts]


def test_suffix_order_and_shared_words():
    r = random.Random(3)
    texts = [[r.randrange(2) for _ in range(n)] for n in (1, 5, 40, 17)] + [[1] * 20]
    words, first = R._joined(texts)
    order, shared = R.suffix_order(words, first)
    end = np.repeat(first[1:], np.diff(first))
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    suffixes = [(int(doc[p]), words[p:end[p]].tolist()) for p in order]
    assert suffixes == sorted(suffixes)
    for (d, x), (e, y), n in zip(suffixes, suffixes[1:], shared):
        common = 0
        while d == e and common < min(len(x), len(y)) and x[common] == y[common]:
            common += 1
        assert n == common


def test_many_pairs_are_not_met():
    """The same stretch 400 times with other words around: quadratically many maximal pairs, none of them a run."""
    text = [w for k in range(400) for w in [1, 2, 3, 4, 5, 6, 7, 1000 + k]]
    words, first = R._joined([text])
    order, shared = R.suffix_order(words, first)
    met = list(R.maximal_pairs(order.tolist(), np.minimum(shared, 7).tolist(), [-1, *text[:-1]], 12))
    assert met == [] and R.runs_of([text]) == [[]]


def test_time_grows_with_the_words():
    import time

    def seconds(n):
        t = [[0] * n, [0, 1, 2] * (n // 3), [k % 7 for k in range(n)]]
        begin = time.process_time()
        assert [len(r) for r in R.runs_of(t)] == [1, 1, 1]
        return time.process_time() - begin

    seconds(2_000)
    assert seconds(80_000) < 16 * max(seconds(20_000), 0.05)


def test_edge_rows(spark):
    out = R.find_runs(edge_docs(spark)).collect()
    want = []
    for row in edge_rows():
        words = re.findall(r"[^\x20\x09-\x0D]+", row[1] or "")
        runs = R.runs_of([list(map(hash, words))])[0]
        if len(words) < 500:
            assert runs == brute_runs(words)
        want.append((row[0], runs, brute_collapsed(words, runs)))
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert out[0]["rank"] == "extra"  # other columns stay
    assert R.find_runs(empty_docs(spark)).count() == 0


def planted(doc_id, text):
    """The documented tail, by plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_brute_force(spark, tmp_path):
    from fixfold.llm.queries import op13_periodic_runs

    line = "one two three four five six seven"
    rows = [(k, prose(k, 5 + 3 * k) + ("\n" + line) * (k % 4), "en") for k in range(90)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "  \n", "en"), (103, "a b " * 40, "en"), (104, "a b " * 40 + "a", "en")]
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    with_runs = 0
    for doc_id, text, _ in rows:
        words = planted(doc_id, text)
        runs = brute_runs(words)
        with_runs += bool(runs)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert r["collapsed_sha256"] == sha(brute_collapsed(words, runs))
    assert with_runs > 10


def test_null_ids_keep_their_text(spark):
    out = R.repeat_tails(spark.createDataFrame([(None, "a  b"), (2, None)], "doc_id long, text string"))
    assert sorted(out.collect(), key=repr) == sorted([(2, None), (None, "a  b")], key=repr)
