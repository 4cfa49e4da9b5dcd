"""Id-set joins and set operations.

All membership tests are semi/anti joins on the key, never Python sets on the
driver; Spark (with AQE) picks broadcast or shuffle from the runtime sizes, so
an id list of any length works.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ids(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(df.columns[0] if key not in df.columns else key).alias(key)).distinct()


def non_empty_predictions(preds: DataFrame, patch: str = "model_patch") -> DataFrame:
    """predictions whose patch is neither '' nor NULL."""
    return preds.where(F.coalesce(F.col(patch), F.lit("")) != "")


def skip_existing(df: DataFrame, done: DataFrame, key: str = "instance_id") -> DataFrame:
    """Rows whose id is not in prior outputs (resume)."""
    return df.join(_ids(done, key), key, "left_anti")


def missing_ids(inputs: DataFrame, outputs: DataFrame, key: str = "instance_id") -> DataFrame:
    """Input ids with no output."""
    return _ids(inputs, key).join(_ids(outputs, key), key, "left_anti")


def select_work(dataset: DataFrame, preds: DataFrame, done: DataFrame | None = None,
                ids: DataFrame | None = None, key: str = "instance_id",
                patch: str = "model_patch") -> DataFrame:
    """Predictions for dataset instances, minus completed ones and empty
    patches, optionally restricted to an id list."""
    work = preds.join(_ids(dataset, key), key, "left_semi")
    if ids is not None:
        work = work.join(_ids(ids, key), key, "left_semi")
    if done is not None:
        work = work.join(_ids(done, key), key, "left_anti")
    return non_empty_predictions(work, patch)


def common_ids(a: DataFrame, b: DataFrame, key: str = "instance_id") -> DataFrame:
    """O3: ids present in both inputs."""
    return _ids(a, key).intersect(_ids(b, key))


def restrict_ids(df: DataFrame, ids: DataFrame, key: str = "instance_id", strict: bool = False) -> DataFrame:
    """rows whose id is listed; ``strict`` is an error that names listed ids not in the data."""
    if strict and (unknown := [r[key] for r in unknown_ids(df, ids, key).orderBy(key).limit(21).collect()]):
        more = ", ..." if len(unknown) > 20 else ""
        raise ValueError(f"ids not in the data: {', '.join(map(str, unknown[:20]))}{more}")
    return df.join(_ids(ids, key), key, "left_semi")


def unknown_ids(df: DataFrame, ids: DataFrame, key: str = "instance_id") -> DataFrame:
    """F21 strict mode: listed ids that are not in the data (the caller raises
    with them; they stay a DataFrame so the check is distributed)."""
    return _ids(ids, key).join(_ids(df, key), key, "left_anti")


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """O1: union of shards/files by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_ids(a: DataFrame, b: DataFrame, key: str = "instance_id") -> DataFrame:
    """Distinct ids from two inputs."""
    return _ids(a, key).union(_ids(b, key)).distinct()


def lost_pairs(old: DataFrame, new: DataFrame, cols=("instance_id", "version")) -> DataFrame:
    """O2: (id, version) pairs present before and missing after."""
    cols = list(cols)
    return old.select(*cols).subtract(new.select(*cols))


def exclude_groups(train: DataFrame, evaluation: DataFrame, key: str = "repo") -> DataFrame:
    """Training rows whose group (repo) does not occur in the evaluation set."""
    return train.join(evaluation.select(key).distinct(), key, "left_anti")


def exclude_exact(df: DataFrame, evaluation: DataFrame, line: str = "line") -> DataFrame:
    """Rows whose raw record text equals an evaluation record.  Joined on a
    hash first (short keys shuffle cheaply), then the text itself is compared."""
    h = F.sha2(F.col(line), 256)
    ev = evaluation.select(h.alias("_eh"), F.col(line).alias("_line")).distinct()
    return df.withColumn("_h", h).join(
        ev, (F.col("_h") == F.col("_eh")) & (F.col(line) == F.col("_line")), "left_anti").drop("_h")


def backfill(df: DataFrame, first: DataFrame, second_fn, key: str = "instance_id",
             value: str = "version", check: bool = False) -> DataFrame:
    """Rows resolved by method one keep its value; the rest go through method
    two (a DataFrame → DataFrame function); both parts are recombined.  ``check``
    compares the row counts (two counts, no rows) and raises if any were lost."""
    got = df.join(first.select(key, value).where(F.col(value).isNotNull()), key, "inner")
    rest = df.join(got.select(key), key, "left_anti")
    out = got.withColumn("method", F.lit(1)).unionByName(
        second_fn(rest).withColumn("method", F.lit(2)))
    if check and (had := df.count()) != (has := out.count()):
        raise ValueError(f"{had} rows went in, {has} came out")
    return out


def drop_missing(df: DataFrame, columns=("text", "model_patch")) -> DataFrame:
    """rows with a NULL in any of the columns go (those the frame has)."""
    return df.na.drop(subset=[c for c in columns if c in df.columns])


def with_hits(df: DataFrame, hits: DataFrame, k: int, key: str = "instance_id",
              hits_col: str = "hits") -> DataFrame:
    """Attach an instance's retrieval hits (array), cut to k, default empty."""
    j = df.join(hits.select(key, hits_col), key, "left")
    return j.withColumn(hits_col, F.coalesce(F.slice(F.col(hits_col), 1, k),
                                             F.array().cast(hits.schema[hits_col].dataType)))
