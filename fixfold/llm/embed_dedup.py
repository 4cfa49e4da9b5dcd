"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables.

Equal vectors are one class first.  Each class's vector gets one bucket per
table (the signs of its products with random hyperplanes); the number of
tables follows from the wanted recall at the threshold.  Buckets are dealt to
tasks, large ones as pairs of blocks, and every pair inside is verified by its
exact cosine in double precision.  A pair that meets in several tables counts
in the first one only, so links are counted without passing the pairs on.
What a task passes on is, per vector, its number of links and the smallest id
it is connected to; connected components of these finish the work.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixfold.llm.common import checkpointed
from fixfold.llm.components import connected_components
from fixfold.llm.near_dedup import _runs, _starts


def table_plan(rows: int, threshold: float, recall: float, bucket_rows: int = 16) -> tuple[int, int]:
    """(bits, tables): about ``bucket_rows`` unrelated rows a bucket, and ``recall`` for a pair at the threshold."""
    bits = min(30, max(4, math.ceil(math.log2(max(2, rows) / bucket_rows))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-meet)))


@functools.lru_cache(maxsize=8)
def _hyperplanes(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, count))


def _scaled(v: np.ndarray) -> np.ndarray:
    """The vector by its largest component: squares neither overflow nor vanish, the direction stays.

    Division by a power of two is exact, so ordinary vectors keep all their digits."""
    return v / 2.0 ** min(max(math.frexp(np.abs(v).max())[1], -1000), 1000)


def signatures(reps: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(id, copies, dim, vec, buckets): the vector as doubles, and its bucket in each table."""
    schema = T.StructType([
        reps.schema["id"], T.StructField("copies", T.LongType()), T.StructField("dim", T.IntegerType()),
        T.StructField("vec", T.BinaryType()), T.StructField("buckets", T.ArrayType(T.IntegerType()))])
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches):
        for b in batches:
            vecs = [_scaled(np.array(v, dtype=np.float64)) for v in b.column(2).to_pylist()]
            out: list = [None] * len(vecs)
            dims = np.array([len(v) for v in vecs])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                signs = (np.stack([vecs[i] for i in at]) @ _hyperplanes(int(d), bits * tables, seed)) >= 0
                for i, x in zip(at, signs.reshape(len(at), tables, bits) @ weights):
                    out[i] = x
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(dims, type=pa.int32()),
                 pa.array([v.tobytes() for v in vecs], type=pa.binary()),
                 pa.array(out, type=pa.list_(pa.int32()))], names=schema.names)

    return reps.select("id", "copies", "embedding").mapInArrow(run, schema)


def verified(signed: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(id, links, root): per vector and task, links counted here, and the smallest id it is connected to."""
    kind = signed.schema["id"].dataType
    rows = signed.select("id", "copies", "dim", "vec", "buckets", F.posexplode("buckets").alias("tab", "bucket"))
    key = ["dim", "tab", "bucket"]
    # large buckets are dealt as pairs of blocks; only their names are joined, not the vectors
    large = signed.select("dim", F.posexplode("buckets").alias("tab", "bucket")).groupBy(*key).agg(
        F.count("*").alias("n")).where(F.col("n") > block_rows)
    blocks = F.coalesce(F.ceil(F.col("n") / block_rows), F.lit(1)).cast("int")
    rows = rows.join(large, key, "left").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    group = [*key, "first", "second"]
    rows = rows.select(*group, "block", "id", "copies", "vec", "buckets").repartition(*group).sortWithinPartitions(*group)

    def bucket(ids, copies, vec, hashes, side, tab, same, out):
        norm = np.sqrt((vec * vec).sum(1))
        if same:
            left = right = np.arange(len(ids))
        else:
            left, right = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(left) or not len(right):
            return
        cosine = (vec[left] @ vec[right].T) / np.outer(norm[left], norm[right])
        i, j = np.nonzero(cosine >= threshold)
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        if not len(i):
            return
        i, j = left[i], right[j]
        new = ~(hashes[i, :tab] == hashes[j, :tab]).any(1) if tab else np.ones(len(i), dtype=bool)
        links = np.bincount(i[new], copies[j[new]], len(ids)) + np.bincount(j[new], copies[i[new]], len(ids))
        root = ids.copy()
        while True:  # the smallest id within the links of this bucket
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            if (low == root).all():
                break
            root = low
        seen = np.unique(np.concatenate([i, j]))
        out.append((ids[seen], links[seen].astype(np.int64), root[seen]))

    def run(batches):
        for t in _runs(batches, group):
            cols = [t.column(c).to_numpy() for c in group]
            at = _starts(cols)
            if not (np.diff(at) > 1).any():
                continue
            ids, copies, block = (t.column(c).to_numpy() for c in ("id", "copies", "block"))
            raw, hashes = t.column("vec").to_pylist(), t.column("buckets").combine_chunks()
            hashes = hashes.flatten().to_numpy().reshape(len(ids), -1)
            out: list = []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                if e - s > 1:
                    vec = np.frombuffer(b"".join(raw[s:e]), dtype=np.float64).reshape(e - s, -1)
                    bucket(ids[s:e], copies[s:e], vec, hashes[s:e], block[s:e] == cols[3][s], int(cols[1][s]),
                           cols[3][s] == cols[4][s], out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["id", "links", "root"])

    return rows.mapInArrow(run, T.StructType([
        T.StructField("id", kind), T.StructField("links", T.LongType()), T.StructField("root", kind)]))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
                    recall: float = 0.99, block_rows: int = 1000, seed: int = 29) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``.

    Links are pairs found with a cosine at or over ``threshold``; each pair at
    the threshold is found with a chance of ``recall`` at least.  Vectors that
    are null, empty, zero, or hold null or non-finite components, and rows with
    a null id, are linked with nothing.  Vectors of different lengths are not
    linked.  Repeated rows and equal vectors link with each other.  Empty
    table: empty.  Other columns are ignored, whatever their names.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce(F.col("id").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.select("id", "embedding", fine.alias("fine"))
    used = rows.where("fine").select("id", F.transform("embedding", lambda x: x + 0.0).alias("embedding"))
    classes = used.groupBy("embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    members = checkpointed(used.join(classes, "embedding").select(
        "id", "rep", "copies", F.when(F.col("id") == F.col("rep"), F.col("embedding")).alias("embedding")))
    reps = members.where("embedding is not null").select(F.col("rep").alias("id"), "copies", "embedding").dropDuplicates()
    count = members.select("rep").distinct().count()
    bits, tables = table_plan(count, threshold, recall)
    found = checkpointed(verified(checkpointed(signatures(reps, bits, tables, seed)), threshold, block_rows))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found, "id", "root")
    out = members.select("id", "rep", "copies").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(
        components.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
