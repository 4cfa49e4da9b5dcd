"""Cases that once gave wrong rows, lost rows or died."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fixfold.functions import harness as H
from fixfold.functions import registry as RG
from fixfold.operators import code as CD
from fixfold.operators import context as CX
from fixfold.operators import curate as CU
from fixfold.operators import diff as D
from fixfold.operators import grading as G
from fixfold.operators import infer as I
from fixfold.operators import joins as J
from fixfold.operators import repair as RP
from fixfold.operators import retrieval as R
from fixfold.operators import versions as VE
from fixfold.sources import io as S
from fixfold.streaming import jobs as ST


def corpus(spark, docs):
    return spark.createDataFrame(docs, "corpus string, docid string, contents string")


def test_search_counts_every_query_term(spark):
    words = [f"w{k}" for k in range(1500)]
    docs = [("c", f"d{k}", " ".join(words[k * 15:k * 15 + 15])) for k in range(100)]
    index = R.bm25_index(corpus(spark, docs))
    q = spark.createDataFrame([("q", "c", " ".join(words))], "qid string, corpus string, query string")
    assert R.bm25_search(index, q, k=200).count() == 100
    assert R.bm25_search(index, q, k=200, max_terms=30).count() == 2
    plan = R.bm25_search(index, q)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan parquet"):] if "FileScan parquet" in plan else plan
    assert "Exchange hashpartitioning(corpus" not in scan.split("FileScan")[-1]


def test_short_passages_are_found(spark):
    docs = corpus(spark, [("c", "a", "say hello world twice"), ("c", "b", "othello worldly"), ("c", "x", "nothing here!!"),
                          ("d", "y", "hello world")])
    index = R.bm25_index(docs)
    passages = spark.createDataFrame([("p1", "c", "hello world"), ("p2", "c", "ello"), ("p3", "c", "!!"), ("p4", "c", "absent"),
                                      ("p5", "c", "say hello world twice")], "qid string, corpus string, text string")
    got = rows(R.containing_docs(index, docs, passages).select("qid", "docid"))
    assert got == [("p1", "a"), ("p1", "b"), ("p2", "a"), ("p2", "b"), ("p3", "x"), ("p5", "a")]


def test_recall_counts_each_file_once(spark):
    hits = spark.createDataFrame([("q", 1, "README.md"), ("q", 2, "a"), ("q", 3, "b"), ("r", 1, "x"), ("s", 1, "readme")],
                                 "qid string, rank int, docid string")
    gold = spark.createDataFrame([("q", "a"), ("q", "c"), ("r", "x"), ("s", "z"), ("t", "z")], "qid string, docid string")
    r = R.recall_metrics(hits, gold).first()
    assert (r["avg_recall"], r["any_recall"], r["all_recall"], r["n_evaluated"]) == (0.75, 1.0, 0.5, 2)


def test_same_path_in_two_corpora_is_packed_once(spark):
    hits = spark.createDataFrame([("q", "c1", 1, "f.py")], "qid string, corpus string, rank int, docid string")
    sizes = spark.createDataFrame([("c1", "f.py", 5), ("c2", "f.py", 50)], "corpus string, docid string, size int")
    base = spark.createDataFrame([("q", 1)], "qid string, base int")
    assert rows(CX.pack_context(hits, sizes, base, 100).select("qid", F.array_join("files", ",").alias("f"), "total")) == [("q", "f.py", 6)]


def test_closure_of_a_long_chain(spark):
    n = 70
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(n, 0)], "src long, dst long")
    roots = spark.createDataFrame([(0,), (5,)], "root long")
    assert CD.reachable(edges, roots).count() == 2 * (n + 1)


def test_deep_directories_are_kept(spark):
    tree = {"f.py": {"classes": [], "functions": [], "text": ["x"]}}
    for k in range(70):
        tree = {f"d{k}": tree}
    files, _ = S.flatten_structure(spark.createDataFrame([("i", json.dumps(tree))], "instance_id string, structure string"))
    assert [r["path"].count("/") for r in files.collect()] == [70]


def test_removed_comment_opens_no_file(spark):
    patch = "--- a/q.sql\n+++ b/q.sql\n@@ -1,3 +1,2 @@\n select 1\n--- old comment\n+++ plus\n-x\n--- a/r.py\n+++ b/r.py\n@@ -1 +1 @@\n-a\n+b"
    df = spark.createDataFrame([("i", patch)], "instance_id string, patch string")
    files = D.patch_files(D.patch_lines(df, ["instance_id"]), ["instance_id"])
    assert rows(files.select("file_idx", "path", "added", "removed")) == [(1, "q.sql", 1, 2), (2, "r.py", 1, 1)]
    assert "Exchange" not in D.patch_lines(df, ["instance_id"])._jdf.queryExecution().executedPlan().toString()


def test_blank_line_between_files_is_no_context(spark):
    patch = ("--- a/x.py\n+++ b/x.py\n@@ -1,9 +1,9 @@\n c\n-a\n+b\n\n"
             "--- a/y.py\n+++ b/y.py\n@@ -1,1 +1,1 @@\n-a\n+b\n")
    df = spark.createDataFrame([("i", patch)], "instance_id string, patch string")
    fixed = D.repair_patch(D.patch_lines(df, ["instance_id"], lenient=True), ["instance_id"]).first()["repaired"]
    assert "@@ -1,2 +1,2 @@" in fixed and "@@ -1,1 +1,1 @@" in fixed


def test_issue_number_beyond_bigint(spark):
    inst = spark.createDataFrame([("i", "r", "see #99999999999999999999999 and #7"), ("j", "r", "see #99999999999999999999999")],
                                 "instance_id string, repo string, problem_statement string")
    issues = spark.createDataFrame([("r", 7)], "repo string, number long")
    assert rows(CU.references_issue(inst, issues)) == [("i", True), ("j", False)]


def test_registered_rule_parses(spark):
    RG.register_repo_rule("my/repo", "pytest")
    try:
        logs = spark.createDataFrame([("my__repo-1", "PASSED t.py::a\nFAILED t.py::b - x")], "instance_id string, test_output string")
        assert rows(G.parse_logs(G.with_rule(logs)).select("test_case", "status")) == [("t.py::a", "PASSED"), ("t.py::b", "FAILED")]
    finally:
        RG.LOG_RULES.pop("my/repo")


def test_lists_as_json_and_as_lists(spark):
    a = spark.createDataFrame([('["x", "y"]',)], "t string")
    b = spark.createDataFrame([(["x", "y"],)], "t array<string>")
    assert a.select(H.json_list("t", a).alias("t")).first() == b.select(H.json_list("t", b).alias("t")).first()


def test_strict_ids_backfill_check_and_missing_text(spark):
    df = spark.createDataFrame([("a", "t", "p"), ("b", None, "p"), ("c", "t", None)], "instance_id string, text string, model_patch string")
    with pytest.raises(ValueError, match="zz"):
        J.restrict_ids(df, spark.createDataFrame([("a",), ("zz",)], "instance_id string"), strict=True)
    assert rows(J.drop_missing(df), "instance_id") == [("a",)]
    first = spark.createDataFrame([("a", "1.0")], "instance_id string, version string")
    with pytest.raises(ValueError, match="3 rows went in"):
        J.backfill(df, first, lambda rest: rest.limit(0).withColumn("version", F.lit("x")), check=True)


def test_one_answer_too_few_is_an_error_per_row(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "yy")], "instance_id string, text string").coalesce(1)
    out = {r["instance_id"]: r for r in I.complete(df, lambda ts: [t for t in ts if t != "yy"], retries=1).collect()}
    assert out["a"]["output"] == "x" and out["b"]["output"] is None and out["b"]["error"]


def counting_model(folder):
    def fn(texts):
        for _ in texts:
            open(os.path.join(folder, f"{random.getrandbits(64):x}"), "w").close()
        return ["```\n" + t[:20] + "\n```" for t in texts]
    return fn


def test_cap_stops_calling_and_keeps_paid_answers(spark, tmp_path):
    df = spark.createDataFrame([(f"i{k:02}", "w " * (k + 1)) for k in range(20)], "instance_id string, text string")
    out = RP.run_inference(df, counting_model(str(tmp_path)), "gpt-4-0613", max_cost=0.0006, wave_rows=2)
    n = out.count()
    assert n == out.count() == len(os.listdir(tmp_path)) < 20
    with pytest.raises(ValueError, match="no price"):
        RP.run_inference(df, counting_model(str(tmp_path)), "unpriced", max_cost=1.0)


def test_repair_chain_asks_once_per_row_and_step(spark, tmp_path):
    inst = spark.createDataFrame([("o__r-1", "fix it"), ("o__r-2", "fix that")], "instance_id string, problem_statement string")
    files = spark.createDataFrame([(i, "pkg/m.py", "def f():\n    return 1\n") for i in ("o__r-1", "o__r-2")],
                                  "instance_id string, path string, text string")
    symbols = spark.createDataFrame([("o__r-1", "pkg/m.py", "function", None, "f", 1, 2)],
                                    "instance_id string, path string, kind string, cls string, name string, start int, end int")
    lines = files.select("instance_id", "path", F.posexplode(F.split("text", "\n")).alias("i", "text")).select(
        "instance_id", "path", (F.col("i") + 1).alias("line_no"), "text")
    out = RP.repair_chain(inst, files, symbols, lines, counting_model(str(tmp_path)))
    out.collect()
    assert len(os.listdir(tmp_path)) == 2 * 3


def test_dates_of_all_forms_or_an_error(spark):
    def page(date):
        html = f'<a class="reference internal nav-link" href="#version-1-2">Version 1.2.3 ({date})</a>'
        return spark.createDataFrame([("r", html)], "repo string, html string")
    for date in ("2020-01-05", "January 5, 2020", "5 january 2020"):
        assert [str(r["released_at"]) for r in VE.extract_releases(page(date)).collect()] == ["2020-01-05"]
    with pytest.raises(Exception, match="not recognized"):
        VE.extract_releases(page("soon")).collect()


def test_version_paths_in_order(spark):
    files = spark.createDataFrame([
        ("i", "pallets/flask", "flask/__init__.py", '__version__ = "0.9.1"'), ("i", "pallets/flask", "src/flask/__init__.py", '__version__ = "2.1.0"'),
        ("i", "pallets/flask", "other.py", '__version__ = "7.7.7"'), ("q", "Qiskit/qiskit", "qiskit/VERSION.txt", "0.45.1"),
        ("v", "pyvista/pyvista", "pyvista/_version.py", "version_info = 0, 39, 0"), ("u", "my/own", "x.py", "VERSION = (3, 1, 0)")],
        "instance_id string, repo string, path string, text string")
    assert rows(VE.find_version(VE.version_candidates(files))) == [("i", "2.1"), ("q", "0.45"), ("u", "3.1"), ("v", "0.39")]
    specs = spark.createDataFrame([("a", "1.0", "py39")], "repo string, version string, spec string")
    tasks = spark.createDataFrame([("t", "a", "1.0"), ("u", "a", "2.0")], "id string, repo string, version string")
    assert rows(VE.spec_lookup(tasks, specs), "id", "spec") == [("t", "py39"), ("u", None)]


def test_decoding(spark):
    cases = [(b"caf\xc3\xa9", "café"), (b"caf\xe9", "café"), (b"\xef\xbb\xbfx", "x"), ("é".encode("utf-16"), "é"), (b"a\x00b", S.BINARY_PLACEHOLDER)]
    df = spark.createDataFrame([(bytearray(b),) for b, _ in cases], "content binary")
    assert [r["t"] for r in df.select(S.decode_content(F.col("content")).alias("t")).collect()] == [t for _, t in cases]


def stream_of(spark, tmp, batches, schema):
    path = f"{tmp}/in"
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path).schema


def test_late_new_key_is_kept(spark, tmp_path):
    day = "2024-01-01 00:00:00"
    path, schema = stream_of(spark, tmp_path, [[("a", "2024-06-01 00:00:00")], [("late", day), ("a", day)], [("late", day)]], "k string, ts string")
    assert rows(ST.stream_once(spark, path, schema, ["k"], "ts", f"{tmp_path}/out"), "k") == [("a",), ("late",)]


def test_failed_rerun_replaces_the_result(spark, tmp_path):
    good = "Applied Patch\nPASSED t::a"
    path, schema = stream_of(spark, tmp_path, [[("my__flask-1", "pallets/flask", good)], [("my__flask-1", "pallets/flask", "Patch Apply Failed")]],
                             "instance_id string, repo string, content string")
    assert ST.stream_status(spark, path, schema, f"{tmp_path}/out").count() == 0


def test_open_session_is_reported(spark, tmp_path):
    path, schema = stream_of(spark, tmp_path, [[("r", "2024-01-01 00:00:00")], [("r", "2024-01-01 02:00:00")], [("r", "2024-01-01 00:05:00")]],
                             "run string, t string")
    spark.read.parquet(path).select("run", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/typed")
    out = ST.stream_stalls(spark, f"{tmp_path}/typed", spark.read.parquet(f"{tmp_path}/typed").schema, f"{tmp_path}/out")
    assert rows(out, "session_start", "n_events", "open") == [("2024-01-01 00:00:00", 2, False), ("2024-01-01 02:00:00", 1, True)]
