"""Toxicity, quality and language models: held-out accuracy, obfuscation, edge rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixfold.llm import common, language_id, quality_model, toxicity
from llm_fixtures import GERMAN, WORDS, edge_docs, edge_rows, empty_docs, frame, prose

BAD = ["idiot", "moron", "scum", "worthless", "pathetic"]


def toxic_corpus(n=600):
    r, rows, labels = random.Random(3), [], []
    for k in range(n):
        words = prose(k, r.randint(20, 80)).split()
        if toxic := k % 4 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((k, " ".join(words), "en"))
        labels.append((k, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows, labels = toxic_corpus()
    return toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, label int").where("doc_id % 5 != 0"))


def test_toxicity_held_out(spark, toxic_model):
    rows, labels = toxic_corpus()
    scored = toxicity.score_documents(frame(spark, rows), toxic_model, score_col="tox").collect()
    label = dict(labels)
    held = [r for r in scored if r["doc_id"] % 5 == 0]
    assert sum((r["tox"] >= 0.5) == bool(label[r["doc_id"]]) for r in held) >= 0.97 * len(held)
    assert set(BAD) <= set(toxic_model.words)


@pytest.mark.parametrize("text, word", [
    ("an 1d10t here", "idiot"), ("m0r0n", "moron"), ("$cum!", "scum"), ("w0rthl3ss", "worthless"), ("paaaathetic", "pathetic"),
    ("i d i o t", "idiot"), ("m.o.r.o.n", "moron"), ("IDIOT!!", "idiot"), ("p@th3tic", "pathetic"), ("scum$$$", "scum")])
def test_obfuscated_words_are_restored(toxic_model, text, word):
    assert word in toxic_model.found(text)
    assert toxic_model.score(text) > toxic_model.score("a house of stone")


def test_clean_texts_stay(toxic_model):
    assert not toxic_model.found("the house & the tree, 1234 items #5 and a@b.cc on 2020-01-02 it's w1nd")


def test_viterbi_is_the_cheapest_path(toxic_model):
    """Against all paths of a short lattice."""
    from itertools import product
    restorer = toxicity.Restorer(toxic_model.costs)
    for token in ("1d0t", "a$$", "m0-n", "ee3"):
        best = None
        for path in product(*restorer.lattice(token)):
            a = b = 0
            cost = 0.0
            for letter, code, channel in path:
                cost += channel
                if letter:
                    cost += restorer.costs[a * 784 + b * 28 + code]
                    a, b = b, code
            cost += restorer.costs[a * 784 + b * 28]
            if best is None or cost < best[0] - 1e-12:
                best = (cost, "".join(x[0] for x in path))
        assert restorer.restore(token) == best[1]


def test_toxicity_edges(spark, toxic_model):
    rows = toxicity.score_documents(edge_docs(spark), toxic_model, score_col="tox").collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["tox"] <= 1 for r in rows)
    assert toxicity.drop_toxic(edge_docs(spark), toxic_model).columns == edge_docs(spark).columns
    assert toxicity.score_documents(empty_docs(spark), toxic_model, score_col="tox").count() == 0
    none = toxicity.fit(empty_docs(spark), spark.createDataFrame([], "doc_id long, label int"))
    assert 0 < none.score("x") < 1
    repeated = spark.createDataFrame([(5, 1), (5, 0), (6, 0), (None, 1), (10, None)], "doc_id long, label int")
    assert 0 < toxicity.fit(edge_docs(spark), repeated).score(None) < 1



def test_fold_of(spark):
    import zlib
    ids = [0, 1, 7, 123456789, -4]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(common.fold_of(F.col("doc_id"), 5).alias("f")).collect()
    assert [r["f"] for r in got] == [zlib.crc32(str(i).encode()) % 5 for i in ids]
    null = spark.createDataFrame([(None,)], "doc_id long").select(common.fold_of(F.col("doc_id"), 5).alias("f")).first()
    assert null["f"] == 0


def quality_corpus(n=700):
    r, rows, labels = random.Random(5), [], []
    for k in range(n):
        text, good = prose(k, r.randint(40, 150)), k % 3 != 0
        if not good:
            w = text.split()
            text = r.choice([" | ".join(w), " ".join(x + "$$$" for x in w), text.upper().replace(" ", "!! "), (w[0] + " ") * 60])
        rows.append((k, text, "en"))
        labels.append((k, int(good)))
    return rows, labels


def test_quality_held_out_and_edges(spark):
    rows, labels = quality_corpus()
    label = dict(labels)
    model = quality_model.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, label int").where("doc_id % 5 != 0"))
    scored = quality_model.score_documents(frame(spark, rows), model, score_col="q").collect()
    held = [r for r in scored if r["doc_id"] % 5 == 0]
    assert sum((r["q"] >= 0.3) == bool(label[r["doc_id"]]) for r in held) >= 0.95 * len(held)
    edges = quality_model.score_documents(edge_docs(spark), model, score_col="q").collect()
    assert len(edges) == len(edge_rows()) and all(0 <= r["q"] <= 1 for r in edges)
    assert quality_model.score_documents(empty_docs(spark), model, score_col="q").count() == 0
    none = quality_model.fit(empty_docs(spark), spark.createDataFrame([], "doc_id long, label int"))
    assert 0 < none.scores(["x", None])[0] < 1


def test_normal_equations_equal_a_direct_fit(spark):
    """The sums over partitions give the ridge solution of the same rows in one place."""
    rows, labels = quality_corpus(200)
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, label int")
    a = quality_model.fit(docs, marks, partitions=3, waves=32)
    b = quality_model.fit(docs, marks, partitions=1, waves=32)
    assert np.allclose(a.weights, b.weights, atol=1e-6)


def test_random_features_approach_the_gaussian_kernel():
    d = len(quality_model.STATISTICS)
    rng, gamma, waves = np.random.default_rng(0), 0.02, 20_000
    m = quality_model.QualityModel(np.zeros(d), np.ones(d), rng.normal(0, np.sqrt(2 * gamma), (d, waves)),
                                   rng.uniform(0, 2 * np.pi, waves), np.zeros(1), np.zeros(1), np.zeros(1))
    x = rng.normal(size=(6, d))
    f = m.features(x)[:, 1 + d:]
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(f @ f.T - kernel).max() < 0.04


def test_isotonic_is_monotone_and_pools():
    x, y = quality_model.isotonic(np.array([1.0, 2, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and len(x) == 3
    r = np.random.default_rng(2)
    s = r.uniform(size=3000)
    x, y = quality_model.isotonic(s, (r.uniform(size=3000) < s).astype(float))
    assert np.abs(np.interp(s, x, y) - s).mean() < 0.06


def test_language_held_out_and_edges(spark):
    rows = [(k, prose(k, 30 + k % 40, GERMAN if k % 2 else WORDS), "de" if k % 2 else "en") for k in range(400)]
    docs = frame(spark, rows)
    model = language_id.fit(docs.where("doc_id % 3 != 1"))
    assert model.languages == ["de", "en"]
    got = language_id.predict(docs, model).collect()
    held = [r for r in got if r["doc_id"] % 3 == 1]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    edges = language_id.predict(edge_docs(spark), model).collect()
    assert len(edges) == len(edge_rows()) and all(0 <= r["lang_score"] <= 1 for r in edges)
    assert {r["lang_pred"] for r in edges if not r["text"] or not r["text"].strip()} == {"und"}
    assert language_id.predict(empty_docs(spark), model).count() == 0
    assert language_id.fit(empty_docs(spark)).predict("words") == ("und", 0.0)
    assert model.predict("1234 !?") == ("und", 0.0)
    assert model.predict("Haus", reject_below=1.1)[0] == "und"


def test_subwords_stay_inside_words():
    one, two = language_id.subwords("ab", 1 << 20), language_id.subwords("ab cd", 1 << 20)
    assert set(one) | set(language_id.subwords("cd", 1 << 20)) == set(two)
    assert set(language_id.subwords("AB\tcd\n", 1 << 20)) == set(two)
    assert len(language_id.subwords("", 8)) == 0


def test_every_language_is_learned(spark):
    """250 languages, no cap; texts without blanks are cut by characters."""
    def word(k):
        return f"q{chr(97 + k % 26)}{chr(97 + k // 26)}z"

    rows = [(3 * k + j, " ".join([word(k)] * (4 + j)), f"l{k:03d}") for k in range(250) for j in range(16)]
    model = language_id.fit(frame(spark, rows), epochs=25)
    assert len(model.languages) == 250 and 0 <= model.reject_below <= 1
    assert sum(model.predict(t, 0.0)[0] == lang for _, t, lang in rows) > 0.5 * len(rows)
    made = language_id._segmenter(4, 64)()(["漢" * 100_000, "w " * 1000, "", None])
    assert all(len(s) <= 640 for (found,) in made for s in found) and len(made[0][0]) == 4


def test_rejection_is_fitted():
    """Segments that carry no language are answered with a score below the limit."""
    r = np.random.default_rng(3)
    word = lambda letters: "".join(r.choice(list(letters), 5))
    data = [(lang, " ".join(word(letters if r.random() < 0.9 else "mno") for _ in range(3)))
            for lang, letters in (("a", "abcd"), ("b", "efgh")) for _ in range(300)]
    data += [(lang, " ".join(word("mno") for _ in range(3))) for lang in "ab" for _ in range(100)]
    model = language_id.train(data)
    assert 0.5 < model.reject_below < 1
    assert model.predict("mnomn onmon mnonm")[0] == "und" and model.predict("abcda dbcab cabda dacbd")[0] == "a"
    assert model.predict("mnomn onmon mnonm", 0.0)[0] in "ab"
