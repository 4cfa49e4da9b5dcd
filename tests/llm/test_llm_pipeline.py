"""The stages against brute force, on documents that hold every kind of case."""

import os
import random
import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from fixfold.llm import quality_rules, secret_scan, toxicity
from fixfold.llm.queries import toxicity_model
from llm_fixtures import WORDS, prose
from test_llm_near_dedup import brute as brute_groups
from test_llm_packing import check_pieces, reference_ids

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, rows, labels = random.Random(1), [], []

    def add(text, toxic=0):
        rows.append((len(rows), text, "en", "s0" if len(rows) % 3 else f"s{len(rows)}", len(text) if text else 0))
        labels.append((rows[-1][0], 1, toxic))

    vocabulary = WORDS + [f"w{k}" for k in range(400)]
    bases = [" ".join(prose(s, 1, vocabulary) for s in range(k * 1000, k * 1000 + 120)).lower() for k in range(40)]
    for text in bases:
        add(text)
    for k in range(0, 40, 4):
        add(bases[k])
        add(bases[k] + " one more end")
    for k in range(60):
        w = bases[k % 40].split()
        r.shuffle(w)
        for bad in ("idiot", "moron", "scum"):
            w.insert(r.randrange(len(w)), bad)
        add(" ".join(w), 1)
    for k in range(8):
        add(" | ".join(bases[k].split()))
        add(f"{' '.join(reversed(bases[k].split()))} password = \"hunter2secret{k}\" end")
    add(None), add(""), add("short one")
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_stages_against_brute_force(spark, tables, tmp_path):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity_model(spark, folder, docs)
    kept = {r[0]: r[1] for r in rows}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_dedup", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            check_pieces(docs.collect(), {d: [np.array([*reference_ids(t), 0], dtype="<u4")] for d, t in kept.items()})
            continue
        assert docs.columns == before.columns
        got = {r["doc_id"]: r for r in docs.collect()}
        if name == "toxicity":
            kept = {d: t for d, t in kept.items() if model.score(t) < 0.5}
            assert not any(t and "idiot" in t.split() for t in kept.values())
        elif name == "quality_rules":
            judged = {r["doc_id"]: r["r"]["kept"] for r in quality_rules.judge(before, result_col="r").collect()}
            kept = {d: t for d, t in kept.items() if judged[d]}
            assert all(" | " not in t for t in kept.values()) and len(kept) >= 60
        elif name == "near_dedup":
            _, root = brute_groups(list(kept.items()), 80)
            kept = {d: t for d, t in kept.items() if root[d] == d}
            assert len(kept) < len(got) + 1
        elif name == "secrets":
            for d, t in kept.items():
                if spans := secret_scan.find_secrets(t)[0]:
                    for _, s, e, _, _ in reversed(spans):
                        t = t[:s] + "[SECRET]" + t[e:]
                    kept[d] = t
            assert any("[SECRET]" in t for t in kept.values())
            assert all(got[d]["n_chars"] == len(t) for d, t in kept.items())
        assert {d: r["text"] for d, r in got.items()} == kept


def test_run_gives_what_the_stages_give(spark, tables):
    folder, _ = tables
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    rows = out.collect()
    assert rows and all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_lists_the_queries():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and len([n for n in names if n.startswith("op")]) >= 10
    assert toxicity and os.path.isfile(__spark_entry__.__file__)
