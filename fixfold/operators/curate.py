"""Task-set curation: filter cascade with stage counts, seeded sampling and
splits, decontamination, funnels (F14, F7, L4–L6, A26, S13).

The cascade is one pass: every predicate becomes a boolean column, the stage
counts are one aggregate of ``count_if`` over the running conjunctions, and
the surviving rows are one ``filter`` — not a job per stage.  Sampling orders by
an md5 of (seed, id), which is deterministic and identical in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixfold.functions import criteria as C
from fixfold.operators import diff as D


def lite_flags(instances: DataFrame, issues: DataFrame | None = None,
               key: str = "instance_id") -> DataFrame:
    """The three stage predicates of the lite-set cascade as boolean columns:
    ``ok_statement`` (F13 > 40 words, F5, F7, F4, F6 all clean), ``ok_patch``
    (F8 none added/removed, F11 ≤ 1 modified file, F12 1..3 hunks) and
    ``ok_test_patch`` (F9 false).  The patch is exploded once (X1)."""
    lines = D.patch_lines(instances, [key], "patch")
    stats = D.patch_stats(D.patch_files(lines, [key]), [key])
    st = F.col("problem_statement")
    refs = references_issue(instances, issues, key) if issues is not None else None
    df = instances.join(stats, key, "left")
    if refs is not None:
        df = df.join(refs, key, "left")
    ref_flag = F.coalesce(F.col("refers_issue"), F.lit(False)) if refs is not None else \
        (C.keyword_reference(st) | C.gitlab_reference(st))
    bad_statement = (C.max_words(st, 40) | C.contains_hyperlink(st, F.col("repo"))
                     | ref_flag | C.contains_commit_hash(st) | C.contains_image(st))
    ok_patch = (~F.coalesce(F.col("has_added_or_removed"), F.lit(False))
                & F.coalesce(D.max_files(1), F.lit(True))
                & F.coalesce(D.max_hunks(3), F.lit(False)))
    return df.select(*instances.columns,
                     (~bad_statement).alias("ok_statement"),
                     ok_patch.alias("ok_patch"),
                     (~C.contains_match_arg(F.col("test_patch"))).alias("ok_test_patch"))


def references_issue(instances: DataFrame, issues: DataFrame, key: str = "instance_id",
                     text: str = "problem_statement") -> DataFrame:
    """(key, refers_issue).  Keyword references and issue-tracker URLs are
    column tests; a bare ``#n`` counts only when issue n of the same repository
    exists — a semi-join to the known issues instead of one web request each."""
    t = F.col(text)
    direct = instances.select(key, (C.keyword_reference(t) | C.gitlab_reference(t)).alias("d"))
    bare = instances.select(key, "repo", F.explode(C.bare_references(t)).alias("n")) \
        .select(key, "repo", F.col("n").try_cast("long").alias("number"))
    known = issues.select("repo", "number").distinct()
    hit = bare.join(known, ["repo", "number"], "left_semi").select(key).distinct() \
        .withColumn("b", F.lit(True))
    return direct.join(hit, key, "left").select(
        key, (F.col("d") | F.coalesce(F.col("b"), F.lit(False))).alias("refers_issue"))


def cascade_counts(flags: DataFrame, stages: list[str]) -> DataFrame:
    """rows before any stage and after each stage, in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("n_start")]
    running = F.lit(True)
    for s in stages:
        running = running & F.coalesce(F.col(s), F.lit(False))
        aggs.append(F.count_if(running).alias(f"after_{s}"))
    return flags.agg(*aggs)


def apply_cascade(flags: DataFrame, stages: list[str]) -> DataFrame:
    """the rows passing every stage."""
    cond = F.lit(True)
    for s in stages:
        cond = cond & F.coalesce(F.col(s), F.lit(False))
    return flags.where(cond).drop(*stages)


def md5_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "instance_id", few: int = 100_000) -> DataFrame:
    """L4: a seeded subset of n rows — the n smallest md5(seed:id), ties by id.

    The n-th smallest is found by counting, and the rows below it stay where they
    are: a histogram over the next four hexadecimal digits tells the bin it lies in, until a
    bin holds at most ``few`` rows (or the digits end), and only that bin is sorted.
    Each histogram is at most 65,536 rows.  The order is written once (hash and id), so ``df`` is
    computed twice, whatever the rounds.  Rows of a null id come first; of equal
    rows at the boundary as many as are missing."""
    from fixfold.streaming.jobs import scratch

    if n < 1:
        return df.limit(0)
    o = F.coalesce(md5_order(key, seed), F.lit(""))
    path = scratch(df.sparkSession, "sample")
    df.select(o.alias("o"), F.col(key).alias("k")).write.parquet(path)
    order = df.sparkSession.read.parquet(path)
    prefix, missing = "", n  # the wanted row is the missing-th one with this prefix
    while True:
        bins = order.where(F.col("o").startswith(prefix)).groupBy(
            F.substr("o", F.lit(len(prefix) + 1), F.lit(4)).alias("d")).count().collect()
        for d, count in sorted(bins):
            if count >= missing:
                break
            missing -= count
        else:
            return df  # no more than n rows
        prefix += d
        if count <= few or d == "" or len(prefix) >= 32:
            break
    at = F.struct("o", "k")
    last = order.where((F.col("o") == prefix) if d == "" else F.col("o").startswith(prefix)).orderBy("o", "k").limit(missing)
    edge = last.groupBy(at.alias("at")).count().orderBy(F.desc("at")).first()
    mine = F.struct(o.alias("o"), F.col(key).alias("k"))
    bound = F.struct(F.lit(edge["at"]["o"]).alias("o"), F.lit(edge["at"]["k"]).cast(df.schema[key].dataType).alias("k"))
    equal = o.eqNullSafe(F.lit(edge["at"]["o"])) & F.col(key).eqNullSafe(F.lit(edge["at"]["k"]))
    if order.where(F.col("o").eqNullSafe(edge["at"]["o"]) & F.col("k").eqNullSafe(F.lit(edge["at"]["k"]))).count() == edge["count"]:
        return df.where((mine < bound) | equal)
    return df.where((mine < bound) & ~equal).unionByName(df.where(equal).limit(edge["count"]))


def cap_per_group(df: DataFrame, group: str, n: int, seed: int = 42,
                  key: str = "instance_id", drop: tuple = ("test_patch",)) -> DataFrame:
    """At most n rows per group in seeded order, dropping the given columns.

    Two steps keep a hot group from landing in one task: rows are first ranked
    within (group, salt) buckets, only each bucket's best n survive, and the
    final rank runs over at most n × buckets rows per group."""
    salt = F.abs(F.xxhash64(F.col(key))) % 64
    o = md5_order(key, seed)
    d = df.withColumn("_o", o).withColumn("_salt", salt)
    w1 = Window.partitionBy(group, "_salt").orderBy("_o", key)
    d = d.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n)
    w2 = Window.partitionBy(group).orderBy("_o", key)
    d = d.withColumn("_r2", F.row_number().over(w2)).where(F.col("_r2") <= n)
    return d.drop("_o", "_salt", "_r1", "_r2", *[c for c in drop if c in df.columns])


def split_validation(df: DataFrame, ratio: float = 0.01, seed: int = 42,
                     key: str = "instance_id") -> DataFrame:
    """Add ``split`` = validation for the rows whose md5 fraction is below
    ratio, else train (a per-row hash: no shuffle, no global sort)."""
    h = F.conv(F.substring(md5_order(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(h < ratio, F.lit("validation")).otherwise(F.lit("train")))


def funnel(pulls: DataFrame, instances: DataFrame, seen: DataFrame | None = None,
           key: str = "instance_id") -> DataFrame:
    """Read / valid pulls / valid instances / with tests / skipped as seen — one aggregate."""
    p = pulls.select(key, C.valid_pull().alias("vp"))
    i = instances.select(key, C.valid_instance().alias("vi"), C.has_tests().alias("ht"))
    j = p.join(i, key, "left")
    if seen is not None:
        j = j.join(seen.select(key).distinct().withColumn("seen", F.lit(True)), key, "left")
    else:
        j = j.withColumn("seen", F.lit(None).cast("boolean"))
    seen_c = F.coalesce(F.col("seen"), F.lit(False))
    return j.agg(
        F.count(F.lit(1)).alias("n_read"),
        F.count_if(seen_c).alias("n_seen"),
        F.count_if(~seen_c & F.col("vp")).alias("n_valid_pulls"),
        F.count_if(~seen_c & F.col("vp") & F.col("vi")).alias("n_valid_instances"),
        F.count_if(~seen_c & F.col("vp") & F.col("vi") & F.col("ht")).alias("n_with_tests"),
    )


def write_dual(df: DataFrame, path: str, mode: str = "append") -> None:
    """Every valid instance to ``<path>.all``, those with tests also to ``<path>``.
    Both writes read one persisted frame."""
    df = df.where(C.valid_instance()).persist()
    try:
        df.write.mode(mode).json(path + ".all")
        df.where(C.has_tests()).write.mode(mode).json(path)
    finally:
        df.unpersist()
