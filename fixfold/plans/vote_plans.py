"""Registered queries for the vote slice, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixfold.operators import voting
from fixfold.plans.views_sql import with_views
from fixfold.sources import adapters

QUERIES = {}
ORACLE = {}


def _votes(spark, sf):
    return voting.vote_counts(adapters.attempts(spark, sf))


def _decisions(spark, sf):
    return voting.decide(voting.vote_leaders(_votes(spark, sf)))


def q_vote_counts(spark, sf):
    return _votes(spark, sf).withColumn("votes", F.col("votes").cast("double"))


def q_vote_decision(spark, sf):
    d = _decisions(spark, sf)
    return d.select("instance_id", "n_candidates", "top_patch",
                    F.col("top_votes").cast("double").alias("top_votes"), "top_resolved",
                    "second_patch", F.col("second_votes").cast("double").alias("second_votes"),
                    "best_resolved_rank", "pass1")


def q_pass_at_k(spark, sf):
    return voting.pass_at_k(_decisions(spark, sf), adapters.dataset_ids(spark, sf),
                            adapters.subset_ids(spark, sf))


def q_dedupe_outputs(spark, sf):
    return voting.dedupe_outputs(adapters.attempts(spark, sf), "instance_id", "patch")


def q_in_subset(spark, sf):
    return voting.in_subset(_decisions(spark, sf).select("instance_id", "pass1"),
                            adapters.subset_ids(spark, sf))


def q_first_success(spark, sf):
    a = adapters.attempts(spark, sf).withColumn(
        "attempt", F.col("run_id")).withColumn(
        "patch", F.when(F.col("resolved"), F.col("patch")).otherwise(F.lit("")))
    return voting.first_success(a, "instance_id", "attempt", "patch")


QUERIES.update({
    "vote_counts": q_vote_counts,
    "vote_decision": q_vote_decision,
    "pass_at_k": q_pass_at_k,
    "dedupe_outputs": q_dedupe_outputs,
    "in_subset": q_in_subset,
    "first_success": q_first_success,
})

_VOTES = """
votes AS (
  SELECT instance_id, patch,
         sum(CASE WHEN run_id LIKE '%django%' OR run_id LIKE '%matplotlib%'
                  THEN 0.9 ELSE 1 END::DECIMAL(10,1)) AS votes,
         bool_or(coalesce(resolved, false)) AS resolved,
         min(run_id) AS first_run,
         count(*) AS n_attempts
  FROM (SELECT instance_id, run_id, resolved,
               regexp_replace(patch, '^\\s+|\\s+$', '', 'g') AS patch FROM attempts)
  GROUP BY instance_id, patch)"""

_RANKED = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY votes DESC, first_run, patch) AS rn,
         count(*) OVER (PARTITION BY instance_id) AS n
  FROM votes)"""

_DECISION = """
top AS (
  SELECT a.instance_id, a.n AS n_candidates, a.patch AS top_patch, a.votes AS top_votes,
         a.resolved AS top_resolved, b.patch AS second_patch, b.votes AS second_votes,
         coalesce(b.resolved, false) AS second_resolved,
         (SELECT min(rn) FROM ranked r WHERE r.instance_id = a.instance_id AND r.resolved) AS best_resolved_rank
  FROM ranked a LEFT JOIN ranked b ON a.instance_id = b.instance_id AND b.rn = 2
  WHERE a.rn = 1),
feat AS (
  SELECT *,
    len(list_filter(string_split(top_patch, chr(10)), lambda l: left(l, 1) IN ('+', '-'))) AS e1,
    len(list_filter(string_split(second_patch, chr(10)), lambda l: left(l, 1) IN ('+', '-'))) AS e2,
    list_sort(list_distinct(list_filter(string_split(top_patch, chr(10)), lambda l: left(l, 1) IN ('+', '-')))) AS s1,
    list_sort(list_distinct(list_filter(string_split(second_patch, chr(10)), lambda l: left(l, 1) IN ('+', '-')))) AS s2,
    (length(top_patch) - length(replace(top_patch, '+', ''))) + (length(top_patch) - length(replace(top_patch, '-', ''))) AS c1,
    (length(second_patch) - length(replace(second_patch, '+', ''))) + (length(second_patch) - length(replace(second_patch, '-', ''))) AS c2
  FROM top),
decision AS (
  SELECT instance_id, n_candidates, top_patch, top_votes, top_resolved, second_patch, second_votes,
         best_resolved_rank,
         coalesce(CASE
           WHEN n_candidates > 1 AND s1 = s2 AND e1 > 0
             THEN (e1 > e2 AND top_resolved) OR (e1 <= e2 AND second_resolved)
           WHEN top_resolved AND (n_candidates = 1 OR top_votes > second_votes) THEN true
           WHEN n_candidates > 1 AND top_votes = second_votes
             THEN (c1 < c2 AND top_resolved) OR (c1 >= c2 AND second_resolved)
           ELSE false END, false) AS pass1
  FROM feat)"""

ORACLE["vote_counts"] = with_views(["attempts"], _VOTES) + """
SELECT instance_id, patch, CAST(votes AS DOUBLE) AS votes, resolved, first_run, n_attempts FROM votes"""

ORACLE["vote_decision"] = with_views(["attempts"], _VOTES, _RANKED, _DECISION) + """
SELECT instance_id, n_candidates, top_patch, CAST(top_votes AS DOUBLE) AS top_votes, top_resolved,
       second_patch, CAST(second_votes AS DOUBLE) AS second_votes, best_resolved_rank, pass1
FROM decision"""

ORACLE["pass_at_k"] = with_views(["attempts", "dataset_ids", "subset_ids"], _VOTES, _RANKED, _DECISION, """
base AS (
  SELECT d.instance_id, x.pass1, x.best_resolved_rank,
         d.instance_id IN (SELECT instance_id FROM subset_ids) AS in_subset
  FROM (SELECT DISTINCT instance_id FROM dataset_ids) d LEFT JOIN decision x USING (instance_id)),
ks AS (SELECT unnest([1, 3, 5, 10, 20, 50]) AS k)""") + """
SELECT CAST(k AS INTEGER) AS k,
       count(*) FILTER (WHERE CASE WHEN k = 1 THEN coalesce(pass1, false) ELSE coalesce(best_resolved_rank <= k, false) END) AS n_pass,
       count(*) FILTER (WHERE in_subset AND CASE WHEN k = 1 THEN coalesce(pass1, false) ELSE coalesce(best_resolved_rank <= k, false) END) AS n_pass_subset,
       round(count(*) FILTER (WHERE CASE WHEN k = 1 THEN coalesce(pass1, false) ELSE coalesce(best_resolved_rank <= k, false) END) / count(*), 6) AS rate,
       round(count(*) FILTER (WHERE in_subset AND CASE WHEN k = 1 THEN coalesce(pass1, false) ELSE coalesce(best_resolved_rank <= k, false) END) / count(*) FILTER (WHERE in_subset), 6) AS rate_subset
FROM ks, base GROUP BY k"""

ORACLE["dedupe_outputs"] = with_views(["attempts"]) + """
SELECT instance_id, patch, n, dense_rank() OVER (PARTITION BY instance_id ORDER BY n DESC) AS freq_rank
FROM (SELECT instance_id, patch, count(*) AS n FROM attempts GROUP BY ALL)"""

ORACLE["in_subset"] = with_views(["attempts"], _VOTES, _RANKED, _DECISION) + """
SELECT instance_id, pass1, instance_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AS in_subset
FROM decision"""

ORACLE["first_success"] = with_views(["attempts"], """
gen AS (SELECT instance_id, run_id AS attempt, CASE WHEN resolved THEN patch ELSE '' END AS patch FROM attempts)""") + """
SELECT instance_id, attempt, patch FROM (
  SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY attempt, patch) AS rn
  FROM gen WHERE length(patch) > 0)
WHERE rn = 1"""
