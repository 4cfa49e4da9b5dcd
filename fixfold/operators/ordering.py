"""Operators that need a position in a *global* order.

A window without ``partitionBy`` pulls every row into one task.  Instead the
global position is computed in two phases:

1. range-partition and sort by the (total) order, tag each row with its
   partition id and its index inside the partition, and cut the lineage with a
   reliable checkpoint so a lost executor recomputes the same tags;
2. count rows per partition (one row per partition), prefix-sum those counts
   (a window over a table as small as the partition count), and add the
   partition's offset to each row's local index.

The per-partition offsets table has as many rows as there are partitions — a
proven bound — so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixfold.session import ensure_checkpoint_dir

LOCAL_BITS = 33  # monotonically_increasing_id keeps the in-partition index in the low 33 bits


def global_row_number(df: DataFrame, order: list, name: str = "row_number",
                      partitions: int | None = None, total: str | None = None) -> DataFrame:
    """Add a 1-based position in the total order ``order`` (ties must not exist:
    include a unique key); with ``total``, also the row count of the frame."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    tagged = ranged.select("*", F.spark_partition_id().alias("_pid"),
                           (F.monotonically_increasing_id()
                            .bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))).alias("_local"))
    tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"),
                            F.sum("_n").over(Window.partitionBy()).alias("_total"))
    extra = [F.col("_total").alias(total)] if total else []
    return tagged.join(F.broadcast(offsets), "_pid").select(
        *df.columns, (F.col("_off") + F.col("_local") + 1).alias(name), *extra)


def _ntile(pos0: Column, total: Column, n: int) -> Column:
    """1-based part of a 0-based position when ``total`` rows are cut into n
    contiguous near-equal parts, the first ``total % n`` one row larger."""
    q = F.floor(total / n)
    rem = total - q * n
    big = (q + 1) * rem
    return (F.when(pos0 < big, F.floor(pos0 / (q + 1)))
            .otherwise(rem + F.floor((pos0 - big) / F.greatest(q, F.lit(1))))
            + 1).cast("int")


def split_even(df: DataFrame, n: int, order: list, name: str = "part") -> DataFrame:
    """Contiguous split into n near-equal parts (the first len % n one larger)."""
    r = global_row_number(df, order, "_rn", total="_total")
    return r.withColumn(name, _ntile(F.col("_rn") - 1, F.col("_total"), n)).drop("_rn", "_total")


def shard(df: DataFrame, n: int, k: int, order: list, contiguous: bool = True) -> DataFrame:
    """Shard k (0-based) of n — a contiguous part, or every n-th row."""
    if contiguous:
        return split_even(df, n, order, "_part").where(F.col("_part") == k + 1).drop("_part")
    r = global_row_number(df, order, "_rn")
    return r.where((F.col("_rn") - 1) % n == k).drop("_rn")


def merge_shards(shards: list[DataFrame], expected: int | None = None) -> DataFrame:
    """Union shard outputs by name; with ``expected``, fail unless the row
    count matches (one distributed count, checked on the driver)."""
    from fixfold.operators.joins import union_all

    out = union_all(shards)
    if expected is not None:
        got = out.count()
        if got != expected:
            raise ValueError(f"merged {got} rows, expected {expected}")
    return out


def within_budget(df: DataFrame, cost: str, cap: float, order: list, by: list | None = None,
                  carried: DataFrame | None = None) -> DataFrame:
    """Walk rows in order and stop once the running cost reaches ``cap``;
    the row that crosses the cap is kept.  Running sums over the global order use
    the same two-phase scheme: per-partition sums, prefix offsets, local sums.

    With ``by`` each group of these columns has a cap of its own; rows are
    range-partitioned by group and order, so a large group is spread over
    partitions and many small ones share one.  ``carried`` (by, spent) is what a
    group has spent before."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    by = list(by or [])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in [*by, *order]]
    exact = F.col(cost).cast("decimal(18,8)")  # sums must not depend on how the rows are partitioned
    tagged = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .select("*", F.spark_partition_id().alias("_pid"),
                      F.monotonically_increasing_id().alias("_mid"))
              .checkpoint(eager=True))
    sums = tagged.groupBy("_pid", *by).agg(F.sum(exact).alias("_s"))
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_pid", *by, F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_off"))
    wl = Window.partitionBy("_pid", *by).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn("_before", F.coalesce(F.sum(exact).over(wl), F.lit(0)))
    # one row for each partition (and group in it); without groups no more than partitions, which is a bound
    j = local.join(offsets if by else F.broadcast(offsets), ["_pid", *by])
    before = F.col("_before") + F.col("_off")
    if carried is not None:
        j = j.join(carried.select(*by, F.col("spent").cast("decimal(38,8)").alias("_spent")), by, "left")
        before = before + F.coalesce("_spent", F.lit(0))
    return j.where(before < cap).select(*df.columns)
