"""Registered streaming queries: each stages its input as ordered files under
the checkpoint folder, runs the Structured Streaming job to completion
(``availableNow``, one file per micro-batch) and returns the sink as a batch
DataFrame.  Each is checked against the SQL twin of its batch operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixfold.operators import infer as I
from fixfold.plans import grade_plans as GP
from fixfold.plans import misc_plans as MP
from fixfold.plans import vote_plans as VP
from fixfold.plans.views_sql import with_views
from fixfold.sources import adapters as A
from fixfold.sources.tables import Tables
from fixfold.streaming import jobs as S

QUERIES = {}
ORACLE = {}
N_FILES = 8


def _stage(spark, df, name, order):
    path = S.scratch(spark, name)
    n = S.stage_files(df, path, N_FILES, order)
    return path, spark.read.parquet(path).schema, n


def q_stream_once(spark, sf):
    li = Tables(spark, sf).lineitem
    att = li.select(F.col("l_orderkey").alias("instance_id"),
                    F.concat(F.lit("r"), (F.col("l_suppkey") % 12).cast("string")).alias("run_id"),
                    F.col("l_shipdate").alias("ts"))
    src, schema, n = _stage(spark, att, "once-src", ["instance_id"])
    out = S.scratch(spark, "once-out")
    return S.stream_once(spark, src, schema, ["instance_id", "run_id"], "ts", out, files_per_batch=n).select("instance_id", "run_id")


def q_stream_status(spark, sf):
    src, schema, n = _stage(spark, A.logs(spark, sf), "status-src", ["instance_id"])
    return S.stream_status(spark, src, schema, S.scratch(spark, "status-out"), files_per_batch=n)


def q_stream_report(spark, sf):
    """Each log's lines arrive in three parts, by their position in the log."""
    lines = A.logs(spark, sf).select("instance_id", "repo", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))
    path = S.scratch(spark, "report-src")
    n = S.stage_files(lines, path, 3, ["pos", "instance_id"])
    r = S.stream_report(spark, path, spark.read.parquet(path).schema, A.predictions(spark, sf), A.expected_tests(spark, sf),
                        S.scratch(spark, "report-out"), files_per_batch=n)
    lists = [F.array_join(F.col(c), ",").alias(c) for c in r.columns if c.endswith(("_success", "_failure"))]
    return r.select("instance_id", "patch_is_null", "patch_exists", "patch_applied", "resolved", *lists)


def q_stream_budget_jobs(spark, sf):
    """A cap for each model's calls."""
    c = I.with_cost(MP._calls(spark, sf)).select("call_id", "model", "cost")
    src, schema, n = _stage(spark, c, "budget-jobs-src", ["call_id"])
    return S.stream_budget(spark, src, schema, MP.BUDGET_CAP, S.scratch(spark, "budget-jobs-out"), job="model",
                           files_per_batch=n)


def q_stream_vote(spark, sf):
    att = A.attempts(spark, sf)
    src, schema, n = _stage(spark, att, "vote-src", ["instance_id", "run_id"])
    d = S.stream_vote(spark, src, schema, S.scratch(spark, "vote-out"), files_per_batch=n)
    return d.select("instance_id", "n_candidates", "top_patch", F.col("top_votes").cast("double").alias("top_votes"),
                    "top_resolved", "second_patch", F.col("second_votes").cast("double").alias("second_votes"),
                    "best_resolved_rank", "pass1")


def q_stream_budget(spark, sf):
    c = I.with_cost(MP._calls(spark, sf)).select("call_id", "cost")
    src, schema, n = _stage(spark, c, "budget-src", ["call_id"])
    return S.stream_budget(spark, src, schema, MP.BUDGET_CAP, S.scratch(spark, "budget-out"), files_per_batch=n)


def _results(spark, sf):
    return Tables(spark, sf).events.select("ts", F.col("event_type").alias("status"))


def q_stream_progress(spark, sf):
    src, schema, n = _stage(spark, _results(spark, sf), "progress-src", ["ts"])
    return S.stream_progress(spark, src, schema, S.scratch(spark, "progress-out"), files_per_batch=n)


QUERIES.update({
    "stream_once": q_stream_once,
    "stream_status": q_stream_status,
    "stream_report": q_stream_report,
    "stream_budget_jobs": q_stream_budget_jobs,
    "stream_vote": q_stream_vote,
    "stream_budget": q_stream_budget,
    "stream_progress": q_stream_progress,
})

ORACLE["stream_once"] = with_views(["attempts"]) + """
SELECT DISTINCT l_orderkey AS instance_id, 'r' || CAST(l_suppkey % 12 AS VARCHAR) AS run_id FROM lineitem"""
ORACLE["stream_status"] = GP.ORACLE["parse_logs"]
ORACLE["stream_report"] = GP.ORACLE["instance_reports"]
ORACLE["stream_budget_jobs"] = with_views(["calls"], MP._COST) + f"""
SELECT call_id, model FROM (
  SELECT call_id, model, coalesce(sum(CAST(cost AS DECIMAL(18, 8))) OVER (
           PARTITION BY model ORDER BY call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM costed) WHERE before < {MP.BUDGET_CAP}"""
ORACLE["stream_vote"] = VP.ORACLE["vote_decision"]
ORACLE["stream_budget"] = MP.ORACLE["within_budget"]
ORACLE["stream_progress"] = """
SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_total,
       count(*) FILTER (WHERE event_type = 'error') AS n_error, count(*) FILTER (WHERE event_type <> 'error') AS n_completed
FROM events GROUP BY 1"""


def q_stream_stalls(spark, sf):
    """A run is a user's stream of results."""
    ev = Tables(spark, sf).events.select("ts", F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run"))
    src, schema, n = _stage(spark, ev, "stalls-src", ["ts"])
    return S.stream_stalls(spark, src, schema, S.scratch(spark, "stalls-out"), files_per_batch=n)


QUERIES["stream_stalls"] = q_stream_stalls
ORACLE["stream_stalls"] = """
WITH g AS (SELECT 'r' || user_id AS run, ts,
                  CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 20 MINUTE THEN 1 ELSE 0 END AS new_s
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT run, ts, sum(new_s) OVER (PARTITION BY run ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
sess AS (SELECT run, sid, min(ts) AS s0, max(ts) + INTERVAL 20 MINUTE AS s1, count(*) AS n_events FROM s GROUP BY run, sid)
SELECT run, strftime(s0, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(s1, '%Y-%m-%d %H:%M:%S') AS session_end, n_events,
       s1 > (SELECT max(ts) FROM events) AS open
FROM sess"""
