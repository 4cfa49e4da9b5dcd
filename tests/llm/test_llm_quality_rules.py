import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from fixfold.llm import quality_rules as q
from llm_fixtures import GERMAN, WORDS, edge_docs, edge_rows, empty_docs, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if windows[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": dup, "n_repeat_words": len(covered), "base_failed": n < 50 or 100 * len(covered) > 50 * n}


def corpus():
    r, rows = random.Random(2), []
    for k in range(120):
        text = prose(k, r.randint(5, 200), GERMAN if k % 3 == 0 else WORDS)
        if k % 5 == 0:
            text = " | ".join(text.split())
        if k % 7 == 0:
            text = "\n".join([text[:60]] * 4 + [text])
        if k % 11 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((k, text, "de" if k % 3 == 0 else "en"))
    return rows


def test_counts_against_brute_force(spark):
    rows = corpus() + [(200, "a b c a b c d", "en"), (201, "x x x x x", "en"), (202, "a\x0bb\x0cc\r\nd e  f", None)]
    got = q.judge(frame(spark, rows), result_col="r").select("doc_id", "r.*").collect()
    for r in got:
        want = brute(dict((d, t) for d, t, _ in rows)[r["doc_id"]])
        assert {k: r[k] for k in want} == want


def test_exact_path_equals_hashed_path(spark):
    """The sort of the windows themselves (for hash collisions and huge texts) counts the same."""
    words = q.words_of(F.col("text"))
    got = frame(spark, corpus()).select("text", q.repeated_words(words).alias("a")).collect()
    assert all(r["a"] == brute(r["text"])["n_repeat_words"] for r in got)


def test_divergence_against_the_definition(spark):
    r = random.Random(6)

    def share(n, zeros):
        x = [0.0 if k in zeros else r.random() for k in range(n)]
        return [v / sum(x) for v in x]

    p, ref = share(7, {2}), share(7, {5})

    def kl(a, b):
        return sum(x * math.log2(x / y) for x, y in zip(a, b) if x > 0)

    m = [(x + y) / 2 for x, y in zip(p, ref)]
    want = (kl(p, m) + kl(ref, m)) / 2
    got = spark.createDataFrame([(p,)], "s array<double>").select(q.divergence(F.col("s"), ref).alias("d")).first()["d"]
    assert abs(got - want) < 1e-12


def test_native_plan_and_verdicts(spark):
    docs = frame(spark, [(k, prose(k, 150), "en") for k in range(60)] + [(100 + k, " | ".join(prose(k, 150).split()), "en") for k in range(12)])
    kept = q.keep_documents(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(60))


def test_references_do_not_follow_a_minority(spark):
    clean = [(k, prose(k, 150), "en") for k in range(40)]
    junk = [(100 + k, " | ".join(prose(3, 150).split()), "en") for k in range(15)]
    a = q.corpus_references(frame(spark, clean))
    b = q.corpus_references(frame(spark, clean + junk))
    assert max(abs(x - y) for x, y in zip(a.classes["en"], b.classes["en"])) < 0.02


def test_every_language_has_its_references(spark):
    """A language beyond the 50 most frequent ones is judged by its own medians, too."""
    common = [(100 * k + c, prose(100 * k + c, 120), f"l{k}") for k in range(60) for c in range(3)]
    rare = [(9000 + c, " ".join("zug" if w.islower() else "9Ω" for w in prose(c, 150).split()), "rare") for c in range(2)]
    docs = frame(spark, common + rare)
    references = q.corpus_references(docs)
    assert len(references.classes) == len(references.words) == 61
    judged = q.judge(docs, result_col="r")
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    own = {r["doc_id"]: r["r"] for r in judged.collect()}
    assert all(own[d]["class_distance"] < 0.1 and own[d]["word_distance"] < 0.1 for d, _, _ in rare)


def test_references_in_an_array_judge_the_same(spark, monkeypatch):
    docs = frame(spark, corpus())
    plain = q.judge(docs, result_col="r").select("doc_id", "r.*").orderBy("doc_id").collect()
    monkeypatch.setattr(q, "SPELLED_OUT", 0)
    assert q.judge(docs, result_col="r").select("doc_id", "r.*").orderBy("doc_id").collect() == plain


def test_edge_rows(spark):
    got = q.judge(edge_docs(spark), result_col="r").collect()
    assert len(got) == len(edge_rows())
    for r in got:
        want = brute(r["text"])
        assert {k: r["r"][k] for k in want} == want
        if not r["text"]:
            assert r["r"]["base_failed"] and not r["r"]["kept"]
    assert q.judge(empty_docs(spark), result_col="r").count() == 0
    nolang = q.judge(frame(spark, [(1, prose(1, 90), None)]), result_col="r").first()["r"]
    assert nolang["kept"] and not nolang["base_failed"]
