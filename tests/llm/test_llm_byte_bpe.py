import base64
import hashlib
import random
import struct
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixfold.llm import byte_bpe as B
from llm_fixtures import edge_docs, edge_rows, empty_docs, frame, prose

NAMES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def library(name):
    import public_tokenizers as P
    import tiktoken

    with open(P.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(name):
    import public_tokenizers as P

    return B.load(str(P.path(name)), P.PATTERN)


@pytest.fixture(scope="module", params=NAMES)
def both(request):
    return ours(request.param), library(request.param)


letters = st.one_of(st.text(), st.text("ab"), st.text("aeiourstn "), st.text(" \n\t\x00\x85 x"),
                    st.text("éß漢字🙂́‍नम"), st.text("don't'll'S 0123")).map(lambda t: t.encode("utf-8", "ignore").decode())


@settings(max_examples=400, deadline=None)
@given(letters, letters)
def test_ids_equal_the_library(both, a, b):
    mine, lib = both
    ids = mine.encode(a + b)
    assert ids == lib.encode_ordinary(a + b)
    assert mine.decode(ids) == (a + b).encode()


def test_random_stretches_need_backtracking(both):
    mine, lib = both
    r = random.Random(1)
    for kind in ("abcdefghijklmnopqrstuvwxyz", "etaoin", "xyzq", "=-_*", "0123456789", "éèñüöя"):
        for n in (1, 2, 7, 30, 400, 5000):
            t = "".join(r.choice(kind) for _ in range(n))
            assert mine.encode(t) == lib.encode_ordinary(t)
    for t in ("<|endoftext|>", "a" * 9999, " " * 3000 + "x", "ab" * 4000, "\n" * 500):
        assert mine.encode(t) == lib.encode_ordinary(t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=6), max_size=25), st.lists(st.text("abc", max_size=30), max_size=5))
def test_any_table_equals_the_plain_merges(made, texts):
    """Tables of random tokens, some of which the merges never make."""
    ranks = {bytes([b]): b for b in range(256)}
    for t in made:
        ranks.setdefault(t.encode(), len(ranks))
    bpe = B.ByteBpe(ranks, r"\S+|\s+")
    for t in texts:
        whole = ranks.get(t.encode())
        want = [] if not t else [whole] if whole is not None else B.merged(t.encode(), ranks)
        assert bpe.encode(t) == want


def test_longest_tokens_by_brute_force(both):
    mine, _ = both
    part = "unbelievable  understandingé".encode()
    found = mine.longest(part)
    for at in range(len(part)):
        best = max((t for k in range(1, 129) if (t := part[at:at + k]) in mine.ranks), key=len)
        assert mine.token[found[len(part) - 1 - at]] == best


def test_time_grows_with_the_stretch():
    mine = ours(NAMES[0])
    r = random.Random(2)

    def seconds(n):
        part = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)).encode()
        begin = time.process_time()
        mine.encode_part(part)
        return time.process_time() - begin

    seconds(50_000)
    assert seconds(400_000) < 16 * max(seconds(100_000), 0.05)


def test_missing_bytes_and_unknown_ids():
    with pytest.raises(ValueError):
        B.ByteBpe({b"a": 0}, r"\S+")
    with pytest.raises(KeyError):
        ours(NAMES[0]).decode([50256])
    assert B.unpack(B.pack([0, 1, 2**32 - 1])) == [0, 1, 2**32 - 1]


def test_memos_stay_bounded():
    memo = B._Memo(lambda k: k + 1, 3, lambda k: k != 7)
    assert [memo[k] for k in (1, 2, 3, 4, 7, 1)] == [2, 3, 4, 5, 8, 2] and len(memo) <= 3 and 7 not in memo


def test_edge_rows(spark):
    import public_tokenizers as P

    path = str(P.path(NAMES[0]))
    lib = library(NAMES[0])
    out = B.decode_documents(B.encode_documents(edge_docs(spark), path, P.PATTERN), path, P.PATTERN)
    got = sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in out.collect()), key=repr)
    want = sorted(((r[0], lib.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in edge_rows()), key=repr)
    assert got == want
    assert B.round_trip(empty_docs(spark), path, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        B.encode_documents(edge_docs(spark), path, P.PATTERN, ids_col="Score")


def test_query_equals_the_library(spark, tmp_path):
    from fixfold.llm.queries import op11_byte_bpe

    rows = [(k, prose(k, 3 * k) + " é漢🙂" * (k % 3), "en") for k in range(40)] + [(90, None, "en"), (91, "", "en"), (92, "x" * 5000, "en")]
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    lib = library(NAMES[0])
    got = {r["doc_id"]: r for r in op11_byte_bpe(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _ in rows:
        ids = lib.encode_ordinary(text or "")
        r = got[doc_id]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
