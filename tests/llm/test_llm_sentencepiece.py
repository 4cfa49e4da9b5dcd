import random

import public_tokenizers as P
import pytest
import sentencepiece

from fixfold.llm import sentencepiece_fst as fst
from llm_fixtures import edge_docs, edge_rows, empty_docs, frame, prose

PATH = str(P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_texts_equal_the_library(library):
    machine, r = fst.load(PATH), random.Random(3)
    pool = list("abcdeinorst  \n\t.,éß漢字🙂▁1203ABTHE'\"<0x>sﬁ-_=(){}　\x00²½") + ["  ", "ing", "the ", "http://", "<s>", "<0x41>"]
    for _ in range(6000):
        t = "".join(r.choice(pool) for _ in range(r.randint(0, 30)))
        ids = library.encode(t)
        assert machine.encode(t) == ids, t
        assert machine.decode(ids) == library.decode(ids), t
    words = "the of therefore internationalization straße über niño 2024 http://example.com/x.html def foo(x): return x+1   code".split(" ")
    for _ in range(2000):
        t = " ".join(r.choice(words) for _ in range(r.randint(0, 12)))
        assert machine.encode(t) == library.encode(t)


def test_weights_single_out_the_merges():
    """The path of finite weight is what merging the whole stretch gives, cut or not."""
    machine, r = fst.load(PATH), random.Random(5)
    for _ in range(300):
        word = "▁" + "".join(r.choice("aeinorstlghd") for _ in range(r.randint(1, 14)))
        path = machine.shortest_path(word)
        assert path == machine.merged(word)
        assert all(machine.pair_weight(a, b) == 0 for a, b in zip(["", *path], path))


def unigram_model(pieces):
    """A tiny unigram model file."""
    import struct

    def field(n, payload):
        return bytes([n << 3 | 2]) + varint(len(payload)) + payload

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    body = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(k)) for p, s, k in pieces)
    return body + field(2, b"\x18\x01") + field(3, b"\x18\x01\x20\x00")


def test_unigram_shortest_path_against_all_segmentations():
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.1, 1), ("ab", -2.6, 1), ("ba", -3.9, 1), ("▁a", -2.2, 1),
              ("aba", -4.0, 1), ("bb", -4.4, 1)]
    machine = fst.Transducer(unigram_model(pieces))
    weight = {p: -s for p, s, k in pieces if k == 1}

    def best(text):
        if not text:
            return 0.0
        return min(weight.get(text[:k], machine.unknown_weight if k == 1 else float("inf")) + best(text[k:])
                   for k in range(1, len(text) + 1))

    r = random.Random(1)
    for _ in range(200):
        t = "▁" + "".join(r.choice("aabbc") for _ in range(r.randint(1, 9)))
        path = machine.shortest_path(t)
        assert "".join(path) == t
        assert abs(sum(weight.get(p, machine.unknown_weight) for p in path) - best(t)) < 1e-9


def test_documents(spark, library):
    rows = [(k, prose(k, 60), "en") for k in range(20)]
    coded = fst.encode_documents(frame(spark, rows), PATH)
    assert {r["doc_id"]: r["piece_ids"] for r in coded.collect()} == {d: library.encode(t) for d, t, _ in rows}
    back = fst.decode_documents(coded, PATH)
    assert all(r["decoded"] == r["text"] for r in back.collect())
    edges = fst.round_trip(edge_docs(spark), PATH).collect()
    assert len(edges) == len(edge_rows()) and all(r["round_trip"] for r in edges)
    assert {r["doc_id"]: r["n_pieces"] for r in edges}[2] == 0
    assert fst.encode_documents(edge_docs(spark), PATH).where("text is null and piece_ids is not null").count() == 0
    assert fst.round_trip(empty_docs(spark), PATH).count() == 0


def message(*fields):
    """Fields (number, bytes or int) of a protocol buffer message."""
    out = b""
    for n, value in fields:
        if isinstance(value, int):
            out += varint(n << 3) + varint(value)
        else:
            out += varint(n << 3 | 2) + varint(len(value)) + value
    return out


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def model_file(pieces, merges=False, rule=None, front=1, squeeze=1, fallback=False):
    """A model file of (text, score, kind) pieces; ``rule`` names one of the library's character maps."""
    import struct

    if fallback:
        pieces = pieces + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    body = b"".join(message((1, message((1, p.encode())) + b"\x15" + struct.pack("<f", s) + message((3, k)))) for p, s, k in pieces)
    spec = b""
    if rule:
        spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
        spec = message((2, dict(fst._fields(spec))[2]))
    return body + message((2, message((3, 2 if merges else 1), (35, int(fallback))))) + message(
        (3, spec + message((3, front), (4, squeeze), (5, 1))))


def lexicon(r, user=(), run_on=False, unused=False):
    texts = {"▁"} | set("abcdefi12") | {"▁a", "fi", "ab", "ba", "▁ab", "é", "一", "ア"}
    texts |= {"".join(r.choice("▁abfi1") for _ in range(r.randint(2, 3))) for _ in range(25)}
    if not run_on:
        texts = {t for t in texts if "▁" not in t.lstrip("▁")}
    texts -= set(user)
    # scores in 64ths: their sums are exact in single precision too
    scored = [(t, -r.randint(64, 600) / 64 - 0.5 * len(t), 5 if unused and len(t) > 1 and k % 7 == 3 else 1)
              for k, t in enumerate(sorted(texts))]
    return [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(u, 0.0, 4) for u in user] + scored


def random_texts(r, user, n):
    pool = list("abcdefi12 ab  \t\n") + ["ﬁ", "①", "　", "é", "é", "½", "ｱ", "㌀", "´", "​", "▁", "漢字", "🙂", "Å", " ́", "ab", "fi", *user, *user]
    return ["", " ", "▁", "​", "  ▁ "] + ["".join(r.choice(pool) for _ in range(r.randint(1, 25))) for _ in range(n)]


@pytest.mark.parametrize("rule", [None, "nfkc", "nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("front", [0, 1])
def test_character_maps_equal_the_library(rule, squeeze, front):
    r = random.Random(f"{rule}{squeeze}{front}")
    model = model_file(lexicon(r), rule=rule, squeeze=squeeze, front=front, fallback=True)
    library, machine = sentencepiece.SentencePieceProcessor(model_proto=model), fst.Transducer(model)
    for t in random_texts(r, (), 800):
        assert machine.normalise(t) == library.normalize(t), t
        ids = library.encode(t)
        assert machine.encode(t) == ids, t
        assert machine.decode(ids) == library.decode(ids), t


def test_every_key_of_a_map_equals_the_library():
    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec()
    rules = fst.character_map(dict(fst._fields(spec))[2])
    assert len(rules) > 10_000 and rules["ﬁ"] == "fi"
    model = model_file(lexicon(random.Random(1)), rule="nmt_nfkc")
    library, machine = sentencepiece.SentencePieceProcessor(model_proto=model), fst.Transducer(model)
    for key in rules:
        text = f"a{key}b"
        assert machine.normalise(text) == library.normalize(text), text


@pytest.mark.parametrize("merges", [False, True])
@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("user", [(), ("[x]", "ﬁ", "ab", "abc", "a b", "▁i", "12")])
@pytest.mark.parametrize("run_on", [False, True])
def test_user_pieces_and_pieces_over_marks_equal_the_library(merges, fallback, user, run_on):
    if user and not merges:
        with pytest.raises(ValueError, match="user-defined"):
            fst.Transducer(model_file(lexicon(random.Random(4), user)))
        return
    for seed in range(6):
        r = random.Random(f"{merges}{fallback}{user}{run_on}{seed}")
        model = model_file(lexicon(r, user, run_on, unused=not merges), merges, "nmt_nfkc", seed % 2, seed // 2 % 2, fallback)
        library, machine = sentencepiece.SentencePieceProcessor(model_proto=model), fst.Transducer(model)
        for t in random_texts(r, user, 150):
            ids = library.encode(t)
            assert machine.encode(t) == ids, (seed, t)
            assert machine.decode(ids) == library.decode(ids), (seed, t)


def test_refused_models():
    pieces = lexicon(random.Random(2))
    with pytest.raises(ValueError, match="unused"):
        fst.Transducer(model_file(lexicon(random.Random(2), unused=True), merges=True))
    body = b"".join(message((1, message((1, p.encode()), (3, k)))) for p, _, k in pieces)
    with pytest.raises(ValueError, match="unigram and merge"):
        fst.Transducer(body + message((2, message((3, 4)))))
    with pytest.raises(ValueError, match="behind"):
        fst.Transducer(body + message((2, message((3, 1), (24, 1)))))
