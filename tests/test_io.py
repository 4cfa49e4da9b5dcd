import json
import os

import pytest
from conftest import rows

from fixfold.operators import environment as ENV
from fixfold.sources import io


def test_read_instances_suffixes(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"instance_id": "x__y-1", "FAIL_TO_PASS": ["t1"], "repo": "x/y"}\n'
                 '{"instance_id": "x__y-2", "FAIL_TO_PASS": "[\\"t2\\"]"}\n')
    df = io.read_instances(spark, str(p))
    got = dict(rows(df, "instance_id", "FAIL_TO_PASS"))
    assert json.loads(got["x__y-1"]) == ["t1"] and json.loads(got["x__y-2"]) == ["t2"]
    q = tmp_path / "b.json"
    q.write_text('[{"instance_id": "a"}, {"instance_id": "b"}]')
    assert io.read_instances(spark, str(q)).count() == 2
    with pytest.raises(ValueError):
        io.read_instances(spark, str(tmp_path / "c.csv"))


def test_read_predictions_last_wins(spark, tmp_path):
    p = tmp_path / "p.jsonl"
    p.write_text("\n".join(json.dumps({"instance_id": i, "model_name_or_path": "m", "model_patch": v})
                           for i, v in [("a", "1"), ("b", "2"), ("a", "3")]) + "\n")
    got = dict(rows(io.read_predictions(spark, str(p)), "instance_id", "model_patch"))
    assert got == {"a": "3", "b": "2"}


def test_read_result_tree(spark, tmp_path):
    for run, inst, res in [("r1", "x__y-1", True), ("r1", "x__y-2", False), ("r2", "x__y-1", False)]:
        d = tmp_path / run / "m" / inst
        os.makedirs(d)
        (d / "patch.diff").write_text("  +a\n")
        (d / "report.json").write_text(json.dumps({inst: {"resolved": res}}))
    d = tmp_path / "r2" / "m" / "x__y-3"
    os.makedirs(d)
    (d / "patch.diff").write_text("+b")  # no report: left out
    got = rows(io.read_result_tree(spark, str(tmp_path)), "run_id", "instance_id", "patch", "resolved")
    assert got == [("r1", "x__y-1", "+a", True), ("r1", "x__y-2", "+a", False), ("r2", "x__y-1", "+a", False)]


def test_read_patch_files(spark, tmp_path):
    (tmp_path / "a__b-1.diff").write_text("diff --git a/f b/f\n")
    (tmp_path / "a__b-2.diff").write_text("sorry, no patch")
    got = rows(io.read_patch_files(spark, str(tmp_path / "*.diff"), "m"), "instance_id", "malformed")
    assert got == [("a__b-1", False), ("a__b-2", True)]


def test_read_source_tree(spark, tmp_path):
    os.makedirs(tmp_path / "pkg" / "tests")
    (tmp_path / "pkg" / "a.py").write_text("x = 1\n")
    (tmp_path / "pkg" / "tests" / "test_a.py").write_text("y = 2\n")
    (tmp_path / "pkg" / "bin.py").write_bytes(b"\xff\xfe\x00")
    got = dict(rows(io.read_source_tree(spark, str(tmp_path)), "path", "text"))
    assert got == {"pkg/a.py": "x = 1\n", "pkg/bin.py": io.BINARY_PLACEHOLDER}


def test_flatten_structure(spark):
    tree = {"pkg": {"a.py": {"classes": [{"name": "C", "start_line": 1, "end_line": 4,
                                          "methods": [{"name": "m", "start_line": 2, "end_line": 3}]}],
                             "functions": [{"name": "f", "start_line": 5, "end_line": 6}],
                             "text": ["class C:", "  def m(self):", "    pass", "", "def f():", "  pass"]},
                    "sub": {"b.py": {"classes": [], "functions": [], "text": ["x = 1"]}}}}
    df = spark.createDataFrame([("i", json.dumps(tree))], "instance_id string, structure string")
    files, symbols = io.flatten_structure(df)
    assert rows(files, "path") == [("pkg/a.py",), ("pkg/sub/b.py",)]
    assert rows(symbols, "kind", "cls", "name", "start", "end") == [
        ("class", None, "C", 1, 4), ("function", None, "f", 5, 6), ("method", "C", "m", 2, 3)]


def test_write_splits_fills_missing(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", None)], "instance_id string, split string, text string")
    io.write_splits(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    r = back.collect()[0]
    assert r["text"] == "" and r["repo"] == "" and r["split"] == "train"
    assert back.columns[:13] == list(io.SPLIT_COLUMNS)


def test_clean_requirements(spark):
    reqs = spark.createDataFrame([("i", "requirements.txt", "-e .\n# c\na==1\n-r more.txt"),
                                  ("i", "more.txt", "b==2\n.[test]")], "instance_id string, file string, text string")
    got = ENV.clean_requirements(reqs).collect()[0]["requirements"]
    assert got == "b==2\na==1"


def test_replace_packages(spark):
    df = spark.createDataFrame([("x\n\n types-pkg_resources \ny",)], "requirements string")
    assert ENV.replace_packages(df).collect()[0][0] == "x\ntypes-pkg-resources==0.1.3\ny\n"


def test_read_split_and_many(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "instance_id string, split string")
    df.write.partitionBy("split").parquet(str(tmp_path / "ds"))
    assert rows(io.read_split(spark, "lite", "test", {"lite": str(tmp_path / "ds")}), "instance_id") == [("b",)]
    with pytest.raises(ValueError):
        io.read_split(spark, str(tmp_path / "ds"), "dev")
    for i in range(2):
        (tmp_path / f"s{i}.jsonl").write_text(json.dumps({"instance_id": f"x{i}"}) + "\n")
    m = io.read_many(spark, str(tmp_path / "s*.jsonl"))
    assert sorted(r["instance_id"] for r in m.collect()) == ["x0", "x1"]


def test_write_dual_and_jsonl(spark, tmp_path):
    from fixfold.operators.curate import write_dual

    df = spark.createDataFrame([("a", "p", "s", "t"), ("b", "p", "s", " "), ("c", "", "s", "t")],
                               "instance_id string, patch string, problem_statement string, test_patch string")
    write_dual(df, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.json(str(tmp_path / "out.all")).select("instance_id").collect()) == ["a", "b"]
    assert [r[0] for r in spark.read.json(str(tmp_path / "out")).select("instance_id").collect()] == ["a"]
    io.write_jsonl(df.select("instance_id"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_utf16_pairs_at_the_end_of_long_texts(spark):
    from pyspark.sql import functions as F

    from fixfold.sources import io as S

    cases = [("x" * 200_000).encode("utf-16"), ("x" * 200_000 + "🙂").encode("utf-16-le"), ("﻿" + "é" * 50_000 + "🙂y").encode("utf-16-be"),
             "﻿ØØÿ".encode("utf-16-be"), "﻿ࣘx".encode("utf-16-le")]
    cases[1] = b"\xff\xfe" + cases[1]
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(cases)], "k int, content binary")
    got = {r["k"]: r["t"] for r in df.select("k", S.decode_content(F.col("content")).alias("t")).collect()}
    assert got == {0: "x" * 200_000, 1: S.BINARY_PLACEHOLDER, 2: S.BINARY_PLACEHOLDER, 3: "ØØÿ", 4: "ࣘx"}
