"""Majority vote over repair attempts, and Pass@k of the vote.

Input ``attempts``: one row per (run, instance) attempt with its patch text and
whether that attempt's report said *resolved*.

Scale design
------------
A single instance may hold a large share of all attempts, so nothing here
ranks rows with a window partitioned by instance.  Every per-instance step is
an algebraic aggregate (``min`` of an ordered struct, ``count_if``) that Spark
combines map-side before the shuffle, plus one equi-join on the instance key
(AQE splits a skewed side of that join).  The candidate order is total:
votes descending, then the lowest run id that produced the patch, then the
patch text — so results do not depend on file listing order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixfold.functions.text import count_chars, edit_line_set, edit_lines, strip

# Runs whose name contains one of these words count 0.9, all others 1.
DOWNWEIGHTED_RUN_WORDS = ("django", "matplotlib")
DOWNWEIGHT = "0.9"
WEIGHT_TYPE = "decimal(10,1)"  # exact sums: ten 0.9 votes equal nine 1 votes

# The k of Pass@k reported by the vote.
PASS_AT_K = (1, 3, 5, 10, 20, 50)


def vote_weight(run: Column) -> Column:
    cond = F.lit(False)
    for w in DOWNWEIGHTED_RUN_WORDS:
        cond = cond | run.contains(w)
    return F.when(cond, F.lit(DOWNWEIGHT)).otherwise(F.lit("1")).cast(WEIGHT_TYPE)


def vote_counts(attempts: DataFrame, instance: str = "instance_id", run: str = "run_id",
                patch: str = "patch", resolved: str = "resolved") -> DataFrame:
    """Per instance and distinct stripped patch — summed weight and OR of resolved."""
    a = attempts.select(
        F.col(instance).alias("instance_id"),
        F.col(run).alias("run_id"),
        strip(F.col(patch)).alias("patch"),
        F.coalesce(F.col(resolved), F.lit(False)).alias("resolved"),
    )
    return a.groupBy("instance_id", "patch").agg(
        F.sum(vote_weight(F.col("run_id"))).alias("votes"),
        F.bool_or("resolved").alias("resolved"),
        F.min("run_id").alias("first_run"),
        F.count(F.lit(1)).alias("n_attempts"),
    )


def sum_counts(parts: DataFrame) -> DataFrame:
    """The vote counts of all attempts from those of disjoint parts of them."""
    return parts.groupBy("instance_id", "patch").agg(
        F.sum("votes").cast(parts.schema["votes"].dataType).alias("votes"),
        F.bool_or("resolved").alias("resolved"),
        F.min("first_run").alias("first_run"),
        F.sum("n_attempts").alias("n_attempts"),
    )


def _candidate(votes_df: DataFrame) -> DataFrame:
    # Struct order == candidate order (first three fields are unique per instance).
    return votes_df.withColumn(
        "cand",
        F.struct(
            (-F.col("votes")).alias("neg_votes"),
            F.col("first_run"),
            F.col("patch"),
            F.col("votes"),
            F.col("resolved"),
        ),
    )


def vote_leaders(votes_df: DataFrame) -> DataFrame:
    """Per instance: best and second-best candidate, the best resolved candidate's
    1-based position, and the number of candidates.  Skew-safe (see module doc)."""
    cands = _candidate(votes_df).select("instance_id", "cand")
    first = cands.groupBy("instance_id").agg(
        F.min("cand").alias("top1"),
        F.min(F.when(F.col("cand.resolved"), F.col("cand"))).alias("best_resolved"),
        F.count(F.lit(1)).alias("n_candidates"),
    )
    joined = cands.join(first, "instance_id")
    second = joined.groupBy("instance_id").agg(
        F.any_value("top1").alias("top1"),
        F.any_value("best_resolved").alias("best_resolved"),
        F.any_value("n_candidates").alias("n_candidates"),
        F.min(F.when(F.col("cand") > F.col("top1"), F.col("cand"))).alias("top2"),
        F.count_if(F.col("cand") < F.col("best_resolved")).alias("n_before_best"),
    )
    return second.select(
        "instance_id",
        "n_candidates",
        F.col("top1.patch").alias("top_patch"),
        F.col("top1.votes").alias("top_votes"),
        F.col("top1.resolved").alias("top_resolved"),
        F.col("top2.patch").alias("second_patch"),
        F.col("top2.votes").alias("second_votes"),
        F.col("top2.resolved").alias("second_resolved"),
        F.when(F.col("best_resolved").isNotNull(), F.col("n_before_best") + 1)
        .alias("best_resolved_rank"),
    )


def decide(leaders: DataFrame) -> DataFrame:
    """Does the vote pick a resolved patch (Pass@1)?

    (a) top two share the same non-empty set of ``+``/``-`` lines → the one with
        more such lines if rank 1 has more, else rank 2 decides;
    (b) a strict winner (or a single candidate) decides;
    (c) a tie in votes → fewer ``+``/``-`` characters wins, equal → rank 2.
    """
    n = F.col("n_candidates")
    p1, p2 = F.col("top_patch"), F.col("second_patch")
    r1 = F.col("top_resolved")
    r2 = F.coalesce(F.col("second_resolved"), F.lit(False))
    v1, v2 = F.col("top_votes"), F.col("second_votes")
    e1, e2 = F.size(edit_lines(p1)), F.size(edit_lines(p2))
    same = (n > 1) & (edit_line_set(p1) == edit_line_set(p2)) & (e1 > 0)
    by_lines = ((e1 > e2) & r1) | ((e1 <= e2) & r2)
    c1, c2 = count_chars(p1, "+-"), count_chars(p2, "+-")
    by_chars = ((c1 < c2) & r1) | ((c1 >= c2) & r2)
    pass1 = (
        F.when(same, by_lines)
        .when(r1 & ((n == 1) | (v1 > v2)), F.lit(True))
        .when((n > 1) & (v1 == v2), by_chars)
        .otherwise(F.lit(False))
    )
    return leaders.withColumn("pass1", F.coalesce(pass1, F.lit(False)))


def in_subset(df: DataFrame, subset_ids: DataFrame, key: str = "instance_id",
              flag: str = "in_subset") -> DataFrame:
    """Add a membership flag for a (possibly large) id list — left join on
    the distinct ids; AQE turns it into a broadcast only when the list is small."""
    ids = subset_ids.select(F.col(subset_ids.columns[0]).alias(key)).distinct() \
        .withColumn(flag, F.lit(True))
    return df.join(ids, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def pass_at_k(decisions: DataFrame, dataset_ids: DataFrame, subset_ids: DataFrame,
              ks=PASS_AT_K) -> DataFrame:
    """Per k, instances whose vote passes — overall and in the subset, with
    rates over the dataset and subset sizes (one aggregate pass, no driver loop)."""
    ds = dataset_ids.select(F.col(dataset_ids.columns[0]).alias("instance_id")).distinct()
    base = in_subset(ds.join(decisions, "instance_id", "left"), subset_ids)
    aggs = [F.count(F.lit(1)).alias("n_total"), F.count_if("in_subset").alias("n_subset")]
    for k in ks:
        hit = F.coalesce(F.col("pass1"), F.lit(False)) if k == 1 else \
            F.coalesce(F.col("best_resolved_rank") <= k, F.lit(False))
        aggs.append(F.count_if(hit).alias(f"p{k}"))
        aggs.append(F.count_if(hit & F.col("in_subset")).alias(f"s{k}"))
    wide = base.agg(*aggs)
    stack = ", ".join(f"{k}, p{k}, s{k}" for k in ks)
    long = wide.selectExpr("n_total", "n_subset",
                           f"stack({len(ks)}, {stack}) as (k, n_pass, n_pass_subset)")
    return long.select(
        F.col("k").cast("int").alias("k"),
        "n_pass",
        "n_pass_subset",
        F.round(F.col("n_pass") / F.col("n_total"), 6).alias("rate"),
        F.round(F.col("n_pass_subset") / F.col("n_subset"), 6).alias("rate_subset"),
    )


def dedupe_outputs(df: DataFrame, key: str = "instance_id", text: str = "text") -> DataFrame:
    """Distinct answers per key with their frequency and a dense frequency
    rank (1 = most frequent; ties share a rank).

    The window runs over the distinct *frequencies* of a key, not its answers:
    a group of m answers has fewer than sqrt(2m) distinct counts, so even a
    key holding a third of all rows ranks a tiny frame."""
    from pyspark.sql import Window

    counts = df.groupBy(key, text).agg(F.count(F.lit(1)).alias("n"))
    freqs = counts.select(key, "n").distinct().withColumn(
        "freq_rank", F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("n"))))
    return counts.join(freqs, [key, "n"]).select(key, text, "n", "freq_rank")


def first_success(df: DataFrame, key: str = "instance_id", attempt: str = "attempt",
                  value: str = "patch") -> DataFrame:
    """Per key, the value of the lowest attempt whose value is non-empty
    (ties on the attempt broken by the value, so the pick is deterministic)."""
    ok = df.where(F.coalesce(F.length(value), F.lit(0)) > 0)
    return ok.groupBy(key).agg(
        F.min(attempt).alias(attempt),
        F.min_by(value, F.struct(attempt, value)).alias(value),
    )
