import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixfold.llm.packing import Packer, byte_bpe_encoder, pack_documents
from fixfold.llm.queries import tokenizer
from llm_fixtures import edge_docs, edge_rows, empty_docs, frame, prose


def reference_ids(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    return t.encode(text or "", add_special_tokens=False).ids


def check_pieces(rows, docs, window=1024):
    """``rows`` hold each token of ``docs`` (id -> list of id arrays) exactly once, without gaps and padding."""
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)
    assert set(pieces) == set(docs)
    for key, arrays in docs.items():
        got = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[key])
        for ids in arrays:  # repeated ids have equal texts here
            assert any(g[3] == len(ids) for g in got)
        assert sum(g[1] for g in got) == sum(map(len, arrays))
        for start, length, crc, total in got:
            assert any(len(ids) == total and zlib.crc32(ids[start:start + length].tobytes()) == crc for ids in arrays)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=60), st.sampled_from([4, 16, 37, 64]), st.sampled_from([1, 2, 8, 100]))
def test_packer_keeps_every_token_once(lengths, window, max_open):
    packer, closed = Packer(window, max_open), []
    docs = [np.arange(n, dtype="<u4") for n in lengths]
    for k, ids in enumerate(docs):
        closed += packer.add(k, ids)
        assert packer.open <= max_open and packer.count.sum() == packer.open
    closed += packer.finish()
    rows = [{"doc_id": key, "start": s, "length": len(i), "ids_crc32": zlib.crc32(i.tobytes()), "doc_tokens": total,
             "sequence_id": q, "offset": sum(len(p[2]) for p in seq[:k])}
            for q, seq in enumerate(closed) for k, (key, s, i, total) in enumerate(seq)]
    check_pieces(rows, {k: [d] for k, d in enumerate(docs)}, window)


def test_level_follows_the_least_sum_of_squares():
    p = Packer(10, 100)
    for size in (4, 4, 7):
        p._put(p._level(size), ("k", 0, np.zeros(size, dtype="<u4"), size), [])
    # brute force over all levels, the fullest of equals
    def growth(level, size):
        n = p.count.copy()
        if level:
            n[level] -= 1
        if level + size < 10:
            n[level + size] += 1
        return int((n[1:10] ** 2).sum())
    for size in range(1, 10):
        options = [(growth(h, size), -h) for h in range(1, 11 - size) if p.count[h]] + [(growth(0, size), 0)]
        assert growth(p._level(size), size) == min(options)[0]


def test_encoder_equals_the_library():
    encode = tokenizer()()
    texts = ["", "plain words don't", "é ñ ß “quoted” – dash", "a b c \u0085 x", "漢字 🙂 <|endoftext|>", "tabs\t\tand\n\n lines ", "ſK µ"]
    assert encode(texts) == [reference_ids(t) for t in texts]


def test_special_tokens_as_the_file_has_them():
    """Loaded as it is, the file gives the special id; as plain text it does not."""
    import public_tokenizers as P

    paths = str(P.path("byte_bpe_50k.json")), str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN
    assert 50256 in tokenizer()()(["a <|endoftext|> b"])[0] and len(tokenizer()()(["a <|endoftext|> b"])[0]) == 4
    plain = byte_bpe_encoder(*paths, plain_specials=True)(["a <|endoftext|> b"])[0]
    assert 50256 not in plain and len(plain) == 9


def test_pack_edge_rows(spark):
    out = pack_documents(edge_docs(spark), tokenizer(), with_ids=True)
    docs = {}
    for r in edge_rows():
        docs.setdefault(r[0], []).append(np.array([*reference_ids(r[1]), 0], dtype="<u4"))
    rows = out.collect()
    check_pieces(rows, docs)
    assert all(len(r["ids"]) == r["length"] for r in rows)


def test_pack_over_many_partitions_and_empty(spark):
    rows = [(k, prose(k, 10 + 37 * (k % 60)), "en") for k in range(120)]
    out = pack_documents(frame(spark, rows).repartition(7), tokenizer())
    check_pieces(out.collect(), {r[0]: [np.array([*reference_ids(r[1]), 0], dtype="<u4")] for r in rows})
    assert pack_documents(empty_docs(spark), tokenizer()).count() == 0


def test_bad_parameters():
    with pytest.raises(ValueError):
        Packer(0)
