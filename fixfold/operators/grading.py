"""Logs → per-test status → graded tests → instance and run reports.

Scale design: a log is one row; it is exploded into lines once and every
dialect is parsed in that single pass (the rule is a column looked up from
the repository).  "Last line wins" is ``max_by`` over the line position — an
aggregate Spark combines map-side.  Grading is one left join of expected tests
to statuses on (instance, test) followed by per-instance aggregates; run
reports are long rows (instance, status) rather than id lists gathered in one
row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixfold.functions import logs as L
from fixfold.functions.text import col_

# Log markers written by the evaluation harness.
APPLY_PATCH_FAIL = ">>>>> Patch Apply Failed"
APPLY_PATCH_PASS = ">>>>> Applied Patch"
RESET_FAILED = ">>>>> Reset Failed"
TESTS_ERROR = ">>>>> Tests Errored"
TESTS_TIMEOUT = ">>>>> Tests Timed Out"
ENV_RESET_FAILED = "Failed to reset task environment"
NOT_APPLIED_MARKERS = (APPLY_PATCH_FAIL, RESET_FAILED, TESTS_ERROR, TESTS_TIMEOUT, ENV_RESET_FAILED)
PRED_MARKER = f"{APPLY_PATCH_PASS} (pred)"

# Test categories and outcome words.
F2P, P2P, F2F, P2F = "FAIL_TO_PASS", "PASS_TO_PASS", "FAIL_TO_FAIL", "PASS_TO_FAIL"
SUCCESS_STATUSES = ("PASSED", "XFAIL")
FAILURE_STATUSES = ("FAILED", "ERROR")
FULL, PARTIAL, NO = "RESOLVED_FULL", "RESOLVED_PARTIAL", "RESOLVED_NO"


def repo_of(instance_id) -> "F.Column":
    """``owner__repo-123`` → ``owner/repo`` (``__``→``/``, drop after the last ``-``)."""
    return F.regexp_replace(F.replace(col_(instance_id), F.lit("__"), F.lit("/")), r"-[^-]*$", "")


def rules_table(spark) -> DataFrame:
    """J8 dimension repo → parser rule: the fixed table and what was registered (U4)."""
    from fixfold.functions.registry import rules_frame

    return rules_frame(spark)


def with_rule(logs: DataFrame, spark=None, rules: DataFrame | None = None) -> DataFrame:
    """Attach the parser rule of each log's repository (broadcast lookup);
    ``rules`` (repo, rule) defaults to the registered ones (U4)."""
    spark = spark or logs.sparkSession
    rules = rules_table(spark) if rules is None else rules
    df = logs if "repo" in logs.columns else logs.withColumn("repo", repo_of("instance_id"))
    return df.join(rules, "repo", "left")


def applied_logs(logs: DataFrame, content: str = "content") -> DataFrame:
    """``applied`` flag and ``test_output`` (the text after the last
    prediction marker) for logs whose patch was applied; others get NULL output."""
    c = F.col(content)
    bad = F.lit(False)
    for m in NOT_APPLIED_MARKERS:
        bad = bad | c.contains(m)
    applied = ~bad & F.lower(c).contains("applied patch")
    return logs.withColumn("applied", F.coalesce(applied, F.lit(False))).withColumn(
        "test_output", F.when(F.col("applied"), F.substring_index(c, PRED_MARKER, -1)))


def _blob_emissions(rule, text):
    """Whole-log matches as (ord, test, status): framed headers come before every
    line (negative order), the verbose runner's multi-line patterns after every
    line (order above any line)."""
    et = "array<struct<ord:bigint,test:string,status:string>>"
    empty = F.array().cast(et)
    framed = F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit("(?d)" + L.FRAMED_PATTERN), 2).alias("a"),
                     F.regexp_extract_all(text, F.lit("(?d)" + L.FRAMED_PATTERN), 3).alias("b")),
        lambda m, i: F.struct((F.lit(-1_000_000_000) + i).cast("bigint").alias("ord"),
                              F.concat(m["a"], F.lit(".py:"), m["b"]).alias("test"),
                              F.lit("FAILED").alias("status")))
    def passed_at(base):
        return lambda x, i: F.struct((F.lit(base) + i).cast("bigint").alias("ord"), x.alias("test"),
                                     F.lit("PASSED").alias("status"))

    verbose = [F.transform(F.regexp_extract_all(text, F.lit("(?d)" + p), 1), passed_at(1_000_000_000_000 * (k + 1)))
               for k, p in enumerate(L.VERBOSE_BLOB_PATTERNS)]
    return (F.when(rule == "framed", framed.cast(et))
            .when(rule == "verbose", F.concat(*verbose).cast(et))
            .otherwise(empty))


def parse_logs(logs: DataFrame, keys=("instance_id",), text: str = "test_output",
               rule: str = "rule") -> DataFrame:
    """(keys..., test_case, status) with the last emission per test winning.

    One pass over each log: the whole-log matches are computed on the log row,
    its lines are exploded once (the verbose rule's carried test name is a
    window over one log's lines), each line's emissions get an order
    (position, index in the line), the whole-log matches have orders of their
    own before or after all lines, and the union feeds ``max_by(status, order)`` per (log, test).
    """
    keys = list(keys)
    base = logs.where(F.col(text).isNotNull()).select(
        *keys, F.col(rule).alias("rule"), _blob_emissions(F.col(rule), F.col(text)).alias("blob"),
        F.col(text).alias("_t"))
    verbose = F.coalesce(F.col("rule") == "verbose", F.lit(False))
    exploded = F.posexplode(F.split(F.col("_t"), "\n", -1)).alias("pos", "line")
    # verbose rule: the test of the latest " ... " line so far (window over one log's lines);
    # the lines of all other rules need no neighbours, so they are not shuffled
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    carried = base.where(verbose).select(*keys, "rule", exploded).withColumn(
        "prev_test", F.last(L.verbose_prev_marker(F.col("line")), ignorenulls=True).over(w))
    plain = base.where(~verbose).select(*keys, "rule", exploded).withColumn("prev_test", F.lit(None).cast("string"))
    lines = carried.unionByName(plain)
    ex = _line_emissions(lines, keys).unionByName(base.select(*keys, F.explode("blob").alias("e")))
    return ex.groupBy(*keys, F.col("e.test").alias("test_case")).agg(
        F.max_by(F.col("e.status"), F.col("e.ord")).alias("status"))


def _line_emissions(lines: DataFrame, keys: list) -> DataFrame:
    """(keys, e) for lines (keys, pos, rule, line, prev_test): ``e`` is (ord, test, status)."""
    staged = lines.select(*keys, "pos", "rule", "line", "prev_test", *L.stage1(F.col("rule"), F.col("line")))
    staged = staged.select("*", *L.stage2())
    em = F.transform(L.stage3(F.col("rule"), F.col("line"), F.col("prev_test")),
                     lambda e, i: F.struct((F.col("pos") * 1000 + i).cast("bigint").alias("ord"),
                                           e["test"].alias("test"), e["status"].alias("status")))
    return staged.select(*keys, F.explode(em).alias("e"))


def line_gates(lines: DataFrame, keys=("instance_id",)) -> DataFrame:
    """Per log what its lines (keys, pos, line) say about F28: ``bad`` marker seen, ``passed`` marker
    seen, and ``start``, the line of the last prediction marker (NULL without one)."""
    line = F.col("line")
    bad = F.lit(False)
    for m in NOT_APPLIED_MARKERS:
        bad = bad | line.contains(m)
    return lines.groupBy(*keys).agg(
        F.bool_or(bad).alias("bad"), F.bool_or(F.lower(line).contains("applied patch")).alias("passed"),
        F.max(F.when(line.contains(PRED_MARKER), F.col("pos"))).cast("long").alias("start"))


def newest_lines(lines: DataFrame, keys=("instance_id",)) -> DataFrame:
    """(keys, test_case, framed, ord, status): for each test the newest of the lines (keys, rule, pos,
    line) that name it; framed headers, which any line outranks, are kept beside.
    Not for the verbose rule, whose lines lean on their neighbours."""
    keys = list(keys)
    # a line with the marker counts from behind it
    cut = lines.select(*keys, "rule", F.col("pos").cast("long").alias("pos"),
                       F.substring_index("line", PRED_MARKER, -1).alias("line"), F.lit(None).cast("string").alias("prev_test"))
    framed = F.transform(_blob_emissions(F.col("rule"), F.col("line")), lambda e, i: F.struct(
        (F.col("pos") * 1000 + i).cast("bigint").alias("ord"), e["test"].alias("test"), e["status"].alias("status")))
    heads = cut.where("rule = 'framed'").select(*keys, F.explode(framed).alias("e"))
    both = _line_emissions(cut, keys).withColumn("framed", F.lit(False)).unionByName(heads.withColumn("framed", F.lit(True)))
    return both.groupBy(*keys, F.col("e.test").alias("test_case"), "framed").agg(
        F.max("e.ord").alias("ord"), F.max_by("e.status", "e.ord").alias("status"))


def statuses_after(newest: DataFrame, starts: DataFrame, keys=("instance_id",)) -> DataFrame:
    """(keys, test_case, status) of the newest lines that lie at or behind their log's ``start``."""
    keys = list(keys)
    valid = newest.join(starts.select(*keys, "start"), keys).where(
        F.col("start").isNull() | (F.col("ord") >= F.col("start") * 1000))
    return valid.groupBy(*keys, "test_case").agg(
        F.max_by("status", F.struct((~F.col("framed")).alias("line"), "ord")).alias("status"))


def status_map(status_rows: DataFrame, keys=("instance_id",), order: str = "line_no") -> DataFrame:
    """Last status per (keys, test) from already-split status rows."""
    return status_rows.groupBy(*keys, "test_case").agg(F.max_by("status", order).alias("status"))


def grade_tests(expected: DataFrame, statuses: DataFrame, keys=("instance_id",),
                to_fail: bool = False) -> DataFrame:
    """A9 + J12: each expected test with outcome success / failure / neither.

    success = PASSED or XFAIL; failure = absent, FAILED or ERROR; anything else
    (SKIPPED, odd tokens) is neither.  The to-fail categories are graded only
    when ``to_fail``."""
    keys = list(keys)
    exp = expected if to_fail else expected.where(F.col("category").isin(F2P, P2P))
    j = exp.join(statuses, keys + ["test_case"], "left")
    outcome = (F.when(F.col("status").isin(*SUCCESS_STATUSES), F.lit("success"))
               .when(F.col("status").isNull() | F.col("status").isin(*FAILURE_STATUSES),
                     F.lit("failure"))
               .otherwise(F.lit("neither")))
    return j.select(*keys, "category", "test_case", "status", outcome.alias("outcome"))


def test_rates(graded: DataFrame, instances: DataFrame, keys=("instance_id",)) -> DataFrame:
    """A10: F2P and P2P success rates; an empty denominator gives 1."""
    keys = list(keys)
    agg = graded.groupBy(*keys).agg(
        *[F.count_if((F.col("category") == cat) & (F.col("outcome") == o)).alias(f"{n}_{o}")
          for cat, n in ((F2P, "f2p"), (P2P, "p2p")) for o in ("success", "failure")])
    base = instances.select(*keys).distinct().join(agg, keys, "left")

    def rate(n):
        s, f = F.coalesce(F.col(f"{n}_success"), F.lit(0)), F.coalesce(F.col(f"{n}_failure"), F.lit(0))
        return F.when(s + f == 0, F.lit(1.0)).otherwise(s / (s + f))

    return base.select(*keys, rate("f2p").alias("f2p_rate"), rate("p2p").alias("p2p_rate"))


def resolution(rates: DataFrame) -> DataFrame:
    """FULL (1, 1), PARTIAL (0 < f2p < 1, p2p = 1), else NO."""
    f2p, p2p = F.col("f2p_rate"), F.col("p2p_rate")
    return rates.withColumn(
        "resolution",
        F.when((f2p == 1) & (p2p == 1), F.lit(FULL))
        .when((f2p < 1) & (f2p > 0) & (p2p == 1), F.lit(PARTIAL))
        .otherwise(F.lit(NO)))


def _test_lists(graded: DataFrame, keys) -> DataFrame:
    # one list per (category, outcome); an instance's expected tests are its own
    # metadata, so these lists are bounded by the instance row, not the table
    cols = []
    for cat, n in ((F2P, "f2p"), (P2P, "p2p"), (F2F, "f2f"), (P2F, "p2f")):
        for o in ("success", "failure"):
            cols.append(F.array_sort(F.collect_list(F.when(
                (F.col("category") == cat) & (F.col("outcome") == o), F.col("test_case"))))
                .alias(f"{n}_{o}"))
    return graded.groupBy(*keys).agg(*cols)


def instance_reports(predictions: DataFrame, logs: DataFrame, expected: DataFrame,
                     statuses: DataFrame, keys=("instance_id",), to_fail: bool = False) -> DataFrame:
    """One report per prediction that has a log.

    ``patch_is_null`` / ``patch_exists`` from the prediction, ``applied`` from
    the log gate (F28), ``resolved`` = applied and FULL; test lists per
    category and outcome.  Statuses only count for applied logs."""
    keys = list(keys)
    names = [f"{n}_{o}" for n in ("f2p", "p2p", "f2f", "p2f") for o in ("success", "failure")]
    lists = _test_lists(grade_tests(expected, statuses, keys, to_fail), keys)
    base = predictions.select(*keys, "model_patch").join(logs.select(*keys, "applied"), keys)
    j = base.join(lists, keys, "left")
    has_patch = F.col("model_patch").isNotNull()
    counted = has_patch & F.coalesce(F.col("applied"), F.lit(False))
    none = F.array().cast("array<string>")
    lists_ = {n: F.when(counted, F.coalesce(F.col(n), none)).otherwise(none) for n in names}

    def rate(n):
        s, f = F.size(lists_[f"{n}_success"]), F.size(lists_[f"{n}_failure"])
        return F.when(s + f == 0, F.lit(1.0)).otherwise(s / (s + f))

    # both rates 1 is RESOLVED_FULL
    return j.select(*keys, (~has_patch).alias("patch_is_null"), has_patch.alias("patch_exists"),
                    (has_patch & F.col("applied")).alias("patch_applied"),
                    (counted & (rate("f2p") == 1) & (rate("p2p") == 1)).alias("resolved"),
                    *[lists_[n].alias(n) for n in names])


def run_report(dataset: DataFrame, predictions: DataFrame, reports: DataFrame,
               key: str = "instance_id") -> DataFrame:
    """Each dataset id in exactly one class: incomplete (no prediction),
    empty (patch '' or NULL), resolved / unresolved (a report exists), error
    (a non-empty prediction without a report).  Long rows, sorted by id."""
    ds = dataset.select(key).distinct()
    p = predictions.select(key, F.lit(True).alias("has_pred"),
                           (F.coalesce(F.col("model_patch"), F.lit("")) == "").alias("empty"))
    r = reports.select(key, F.col("resolved").alias("rep_resolved"))
    j = ds.join(p, key, "left").join(r, key, "left")
    status = (F.when(F.col("has_pred").isNull(), F.lit("incomplete"))
              .when(F.col("empty"), F.lit("empty_patch"))
              .when(F.col("rep_resolved").isNull(), F.lit("error"))
              .when(F.col("rep_resolved"), F.lit("resolved"))
              .otherwise(F.lit("unresolved")))
    return j.select(key, status.alias("status"))


def run_report_counts(dataset: DataFrame, predictions: DataFrame, classes: DataFrame,
                      key: str = "instance_id") -> DataFrame:
    """A13 counts in one row: every class, completed = resolved + unresolved, and
    both submitted counts (all predictions; predictions in the dataset)."""
    ds = dataset.select(key).distinct().withColumn("in_ds", F.lit(True))
    pr = predictions.select(key).distinct().withColumn("is_pred", F.lit(True))
    both = ds.join(pr, key, "full_outer").join(classes, key, "left")
    c = F.col("status")
    return both.agg(
        F.count_if(F.col("in_ds")).alias("total_instances"),
        F.count_if(F.col("is_pred")).alias("submitted_instances"),
        F.count_if(F.col("is_pred") & F.col("in_ds")).alias("submitted_in_dataset"),
        F.count_if(c.isin("resolved", "unresolved")).alias("completed_instances"),
        F.count_if(c == "resolved").alias("resolved_instances"),
        F.count_if(c == "unresolved").alias("unresolved_instances"),
        F.count_if(c == "empty_patch").alias("empty_patch_instances"),
        F.count_if(c == "error").alias("error_instances"),
        F.count_if(c == "incomplete").alias("incomplete_instances"),
        F.lit(2).alias("schema_version"),
    )


def resolved_rate(reports: DataFrame, dataset: DataFrame, subset: DataFrame,
                  key: str = "instance_id") -> DataFrame:
    """Resolved count and rate over the whole set and over the subset
    (denominators are the set and subset sizes)."""
    ds = dataset.select(key).distinct()
    sub = subset.select(key).distinct().withColumn("in_sub", F.lit(True))
    res = reports.where(F.col("resolved")).select(key).distinct().withColumn("ok", F.lit(True))
    j = ds.join(sub, key, "left").join(res, key, "left")
    ok, ins = F.coalesce(F.col("ok"), F.lit(False)), F.coalesce(F.col("in_sub"), F.lit(False))
    agg = j.agg(F.count_if(ok).alias("n_resolved"), F.count(F.lit(1)).alias("n_total"),
                F.count_if(ok & ins).alias("n_resolved_subset"), F.count_if(ins).alias("n_subset"))
    return agg.select("n_resolved", F.round(F.col("n_resolved") / F.col("n_total"), 6).alias("rate"),
                      "n_resolved_subset",
                      F.round(F.col("n_resolved_subset") / F.col("n_subset"), 6).alias("rate_subset"))


def edit_histogram(reports: DataFrame, instances: DataFrame, key: str = "instance_id",
                   patch: str = "patch") -> DataFrame:
    """For resolved instances, how many have n ``@`` characters in the gold patch."""
    res = reports.where(F.col("resolved")).select(key)
    p = F.col(patch)
    marks = F.length(p) - F.length(F.replace(p, F.lit("@"), F.lit("")))
    return instances.join(res, key, "left_semi").groupBy(marks.alias("n_marks")) \
        .agg(F.count(F.lit(1)).alias("n_instances"))


def gold_predictions(instances: DataFrame, key: str = "instance_id") -> DataFrame:
    """The dataset's own patch as a prediction named ``gold``."""
    return instances.select(key, F.col("patch").alias("model_patch"),
                            F.lit("gold").alias("model_name_or_path"))
