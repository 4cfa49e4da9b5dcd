from conftest import rows

from fixfold.operators import grading as G


def _parse(spark, rule, text):
    logs = spark.createDataFrame([("x__y-1", rule, text)], "instance_id string, rule string, test_output string")
    return dict(rows(G.parse_logs(logs), "test_case", "status"))


def test_pytest_rule(spark):
    got = _parse(spark, "pytest", "PASSED a.py::t1\nFAILED a.py::t2 - Err: x\nERROR\nPASSED a.py::t2")
    assert got == {"a.py::t1": "PASSED", "a.py::t2": "PASSED"}


def test_options_rule(spark):
    assert _parse(spark, "options", "PASSED a.py::t[/tmp/x/y.txt]") == {"a.py::t[/y.txt]": "PASSED"}


def test_verbose_rule(spark):
    text = ("test_a (m.T) ... ok\ntest_b (m.T) ... FAIL\nFAIL: test_c (m.T)\n"
            "test_d (m.T) ... noise\nok")
    got = _parse(spark, "verbose", text)
    assert got["test_a (m.T)"] == "PASSED"
    assert got["test_b (m.T)"] == "FAILED"
    assert got["test_c"] == "FAILED"
    assert got["test_d (m.T)"] == "PASSED"


def test_ansi_rule(spark):
    got = _parse(spark, "ansi", "\x1b[32mPASSED \x1b[0mx.py::t\nx.py::u FAILED")
    assert got == {"x.py::t": "PASSED", "x.py::u": "FAILED"}


def test_mixed_rule(spark):
    assert _parse(spark, "mixed", "x.py::t PASSED [ 50%]\nFAILED x.py::u - y") == \
        {"x.py::t": "PASSED", "x.py::u": "FAILED"}


def test_framed_rule(spark):
    got = _parse(spark, "framed", "____ p/test_a.py:test_x ____\ntest_y ok\ntest_z F\ntest_w ok [OK]")
    assert got == {"p/test_a.py:test_x": "FAILED", "test_y": "PASSED", "test_z": "FAILED",
                   "test_w": "PASSED"}


def test_rewrite_rule(spark):
    assert _parse(spark, "rewrite", "PASSED t.py::b[MouseButton.LEFT]") == {"t.py::b[1]": "PASSED"}


def _grade(spark, expected, status):
    exp = spark.createDataFrame(expected, "instance_id string, category string, test_case string")
    st = spark.createDataFrame(status, "instance_id string, test_case string, status string")
    graded = G.grade_tests(exp, st)
    inst = spark.createDataFrame([("i",)], "instance_id string")
    return G.resolution(G.test_rates(graded, inst)).collect()[0], graded


def test_grading_rates_and_resolution(spark):
    exp = [("i", "FAIL_TO_PASS", "a"), ("i", "FAIL_TO_PASS", "b"), ("i", "PASS_TO_PASS", "c"),
           ("i", "PASS_TO_PASS", "d"), ("i", "PASS_TO_PASS", "e")]
    st = [("i", "a", "PASSED"), ("i", "b", "XFAIL"), ("i", "c", "PASSED"), ("i", "d", "SKIPPED")]
    r, graded = _grade(spark, exp, st)
    assert r["f2p_rate"] == 1.0 and r["p2p_rate"] == 0.5 and r["resolution"] == "RESOLVED_NO"
    assert dict(rows(graded, "test_case", "outcome"))["d"] == "neither"
    r, _ = _grade(spark, exp[:4], st)
    assert r["resolution"] == "RESOLVED_FULL"


def test_partial_and_empty(spark):
    r, _ = _grade(spark, [("i", "FAIL_TO_PASS", "a"), ("i", "FAIL_TO_PASS", "b")], [("i", "a", "PASSED")])
    assert r["resolution"] == "RESOLVED_PARTIAL"
    exp = spark.createDataFrame([], "instance_id string, category string, test_case string")
    st = spark.createDataFrame([], "instance_id string, test_case string, status string")
    inst = spark.createDataFrame([("i",)], "instance_id string")
    r = G.resolution(G.test_rates(G.grade_tests(exp, st), inst)).collect()[0]
    assert (r["f2p_rate"], r["p2p_rate"], r["resolution"]) == (1.0, 1.0, "RESOLVED_FULL")


def test_run_report_classes(spark):
    ds = spark.createDataFrame([(f"i{k}",) for k in range(1, 6)], "instance_id string")
    preds = spark.createDataFrame([("i2", ""), ("i3", "p"), ("i4", "p"), ("i5", "p")],
                                  "instance_id string, model_patch string")
    reps = spark.createDataFrame([("i3", True), ("i4", False)], "instance_id string, resolved boolean")
    got = dict(rows(G.run_report(ds, preds, reps)))
    assert got == {"i1": "incomplete", "i2": "empty_patch", "i3": "resolved", "i4": "unresolved",
                   "i5": "error"}
    c = G.run_report_counts(ds, preds, G.run_report(ds, preds, reps)).collect()[0]
    assert c["completed_instances"] == 2 and c["total_instances"] == 5


def test_repo_of(spark):
    df = spark.createDataFrame([("scikit-learn__scikit-learn-12421",)], "i string")
    assert df.select(G.repo_of("i").alias("r")).collect()[0]["r"] == "scikit-learn/scikit-learn"


def test_run_report_partitions_dataset(spark):
    import __spark_entry__ as e

    c = e.queries()["run_report_counts"](spark, "/root/testdata/sf0.001").collect()[0]
    parts = (c["resolved_instances"] + c["unresolved_instances"] + c["empty_patch_instances"]
             + c["error_instances"] + c["incomplete_instances"])
    assert parts == c["total_instances"]
