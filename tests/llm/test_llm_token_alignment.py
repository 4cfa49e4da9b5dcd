import hashlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fixfold.llm import token_alignment as A
from llm_fixtures import edge_docs, edge_rows, empty_docs, frame, prose


def sides():
    import public_tokenizers as P

    return (A.byte_level_side(str(P.path("byte_bpe_50k.json")), str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN),
            A.piece_side(str(P.path("piece_bpe_32k.model"))))


def library_tokens(text):
    """(id, bytes) lists of both libraries, or None where the bytes differ."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    letters = {}
    for b in range(256):  # the standard letters of byte-level vocabularies
        letters[b] = chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b else None
    k = 0
    for b in range(256):
        if letters[b] is None:
            letters[b] = chr(256 + k)
            k += 1
    back = {v: b for b, v in letters.items()}
    m = sentencepiece.SentencePieceProcessor(model_file=str(P.path("piece_bpe_32k.model")))
    a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in m.encode(text):
        p = m.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else None


def brute(texts):
    """The documented columns of each text, by definition."""
    linked, shown = [], []
    for text in texts:
        both = library_tokens(text) if text else None
        groups = []
        if both:
            a, b = both
            ends = [set(np.cumsum([len(x) for _, x in s]).tolist()) for s in (a, b)]
            cuts = sorted(ends[0] & ends[1])
            at = [0, 0]
            pos = [0, 0]
            for c in cuts:
                g = ([], [])
                for side, s in enumerate((a, b)):
                    while pos[side] < c:
                        i, x = s[at[side]]
                        g[side].append(i)
                        pos[side] += len(x)
                        at[side] += 1
                groups.append(g)
        linked.append(Counter((x, y) for g in groups for x in g[0] for y in g[1]))
        shown.append((len(both[0]) if both else 0, len(both[1]) if both else 0, len(groups),
                      ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)))
    counts = Counter(p for links in linked for p in links)
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [(*s[:3], sum(links.values()), sum(m for (x, y), m in links.items() if counts[x, y] == best[x]),
             sum(m * counts[p] for p, m in links.items()), s[3]) for s, links in zip(shown, linked)]


TEXTS = ["", "plain words, don't!", "  two  spaces\n\n\ttabs ", "é漢字🙂 ñandú नमस्ते", "<s> a </s> <unk> <|endoftext|> <0x41>",
         "▁already", "x" * 700, "1234567890 3.14", "a\x00b", " nbsp em", "ﬁ ligature é", prose(4, 200), prose(4, 200),
         "aAaAaA" * 50, "=====-----" * 20, "\r\n\r\n"]


def test_alignment_equals_the_definition():
    one, two = sides()
    out = A.aligned_texts(TEXTS + [None], one, two)
    want = brute(TEXTS + [None])
    for k in range(len(want)):
        got = tuple(int(out[c][k]) for c in ("n_a", "n_b", "n_groups", "n_links")) + (out["groups"][k],)
        assert got == want[k][:4] + want[k][6:]
    assert sum(w[0] > 0 for w in want) > 8


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=4), st.randoms())
def test_pointer_jumping_labels_the_groups(sizes, r):
    """Both sides cut the same bytes at random; labels against the cuts that both share."""
    a, b, shift = [], [], 0
    for s in sizes:  # documents behind each other: both sides end at a document's end
        end = np.cumsum(s)
        total = int(end[-1])
        other = sorted(r.sample(range(1, total), r.randrange(0, total))) + [total]
        a += (end + shift).tolist()
        b += [x + shift for x in other]
        shift += total
    cuts = sorted(set(a) & set(b))
    label_a, label_b = A.group_labels(np.array(a), np.array(b))
    assert label_a.tolist() == np.searchsorted(cuts, a).tolist()
    assert label_b.tolist() == np.searchsorted(cuts, b).tolist()


def test_pairs_of_long_groups_come_in_blocks(monkeypatch):
    r = np.random.default_rng(0)
    label_a, label_b = np.sort(r.integers(0, 7, 300)), np.sort(r.integers(0, 7, 200))
    a, b, owner = r.integers(0, 20, 300), r.integers(0, 30, 200), np.array([0, 0, 1, 2, 2, 2, 4])
    want = Counter()
    for g, x in zip(label_a, a):
        for h, y in zip(label_b, b):
            if g == h:
                want[int(owner[g]), int(x) * 30 + int(y)] += 1
    for room in (1, 50, 1 << 22):
        monkeypatch.setattr(A, "_PAIRS_AT_ONCE", room)
        docs, pairs, times = A.group_pairs(label_a, a, label_b, b, owner, 30)
        assert dict(zip(zip(docs.tolist(), pairs.tolist()), times.tolist())) == want
        assert sorted(zip(docs.tolist(), pairs.tolist())) == list(zip(docs.tolist(), pairs.tolist()))


def check(rows, got, columns):
    want = brute([r[1] for r in rows])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    assert sorted([(r[0], *w[:6], sha(w[6])) for r, w in zip(rows, want)], key=repr) == \
        sorted([tuple(r[c] for c in columns) for r in got], key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_equals_brute_force(spark, tmp_path):
    from fixfold.llm.queries import op12_token_alignment

    rows = [(k, t, "en") for k, t in enumerate(TEXTS + [None] + [prose(k % 9, 20 + 5 * k) for k in range(40)])]
    frame(spark, rows).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    check(rows, op12_token_alignment(spark, str(tmp_path)).collect(), COLUMNS)


def test_edge_rows_and_small_chunks(spark):
    import functools

    import public_tokenizers as P
    from pyspark.sql import functions as F

    one = functools.partial(A.byte_level_side, str(P.path("byte_bpe_50k.json")), str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    two = functools.partial(A.piece_side, str(P.path("piece_bpe_32k.model")))
    out = A.link_documents(edge_docs(spark), one, two, 32_000, groups_as=lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256)))
    check(edge_rows(), out.collect(), COLUMNS[:-1] + ("groups",))
    assert A.link_documents(empty_docs(spark), one, two, 32_000).count() == 0


def test_chunks_hold_the_pairs_of_their_documents():
    one, two = sides()
    texts = [t for t in TEXTS if t]
    held = [A.aligned_texts(texts[:6], one, two), A.aligned_texts(texts[6:], one, two)]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    rows = A._chunk_rows(5, list(range(len(texts))), held, to_arrow_schema(A._aligned_schema(T.StructField("id", T.LongType())))).to_pylist()
    pairs = rows[0]["chunk_pairs"]
    seen = Counter()
    for r, h, k in zip(rows, [held[0]] * 6 + [held[1]] * 99, [*range(6), *range(99)]):
        at = np.cumsum(np.frombuffer(r["steps"], "<u4"), dtype=np.int64)
        mine = h["docs"] == k
        assert [pairs[p] for p in at] == h["pairs"][mine].tolist()
        assert np.frombuffer(r["times"], "<u4").tolist() == h["times"][mine].tolist()
        seen.update(at.tolist())
    assert [seen[k] for k in range(len(pairs))] == rows[0]["chunk_docs"]
