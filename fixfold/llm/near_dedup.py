"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

1. Each text becomes its set of word shingles (64-bit hashes), a MinHash
   signature, and index keys.  Texts with equal sets are one class from here on.
2. A pair at or over the threshold differs in at most ``radius`` of the
   signature's positions (but for a chance of about 1e-6).  The signature is
   split into ``chunks``; by the pigeonhole principle, if two signatures are
   within radius ``chunks * a + c``, then one of the first ``c + 1`` chunks is
   within ``a`` errors or another one within ``a - 1``.  Each allowed error is
   enumerated as a key with that position left out, so all signature pairs
   within the radius meet under a key; their distance is then computed.
3. Under a key, only enough pairs to connect what is within the radius are
   passed on.  Their connected components hold every pair within the radius.
4. Inside these components the links are confirmed on the full sets.  A large
   component is dealt into blocks; between blocks only what is not yet linked
   is compared, by pairs of blocks, so a group of copies costs about its size,
   not its square, and no task holds more than two blocks of a component at once.
5. Connected components of the confirmed links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixfold.llm.common import checkpointed, free_name, slices
from fixfold.llm.components import connected_components

_NIBBLES = np.array([((x & 15) > 0) + ((x >> 4) > 0) for x in range(256)], dtype=np.uint8)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes; word hashes are cached."""

    def __init__(self, size: int = 5, cache_size: int = 400_000):
        self.size, self.cache, self.cache_size = size, {}, cache_size
        self.factors = np.random.default_rng(101).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def shingles(self, text: str | None) -> np.ndarray:
        """Empty for a text without words; the whole sequence as one shingle if it has too few."""
        words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
        if not words:
            return np.zeros(0, dtype=np.uint64)
        cache, out = self.cache, []
        if len(cache) > self.cache_size:
            cache.clear()
        for w in words:
            h = cache.get(w)
            if h is None:
                h = cache[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        h = np.array(out, dtype=np.uint64)
        k = min(self.size, len(h))
        n = len(h) - k + 1
        total = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            total = total + h[i:i + n] * self.factors[i]
        return np.unique(_mix(total))


@dataclass(frozen=True)
class Index:
    """The signature's layout: positions, radius, and the chunks with their allowed errors (0 or 1)."""

    positions: int = 64
    radius: int = 23
    chunks: int = 18
    seed: int = 7

    def __post_init__(self):
        if not self.radius < 2 * self.chunks:
            raise ValueError("at most one error a chunk is enumerated: radius must be under twice the chunks")

    @staticmethod
    def for_threshold(threshold: float, positions: int = 64) -> Index:
        """A radius that a pair at the threshold exceeds with a chance of about 1e-6."""
        p, radius, tail = 1 - threshold, positions, 0.0
        while radius > 0 and tail + (now := math.comb(positions, radius) * p ** radius * (1 - p) ** (positions - radius)) < 3e-6:
            tail, radius = tail + now, radius - 1
        return Index(positions, radius, max(1, -(-3 * radius // 4)))

    def plan(self) -> list[tuple[int, int, int]]:
        """(first, last, errors) of each chunk; the widest chunks get the errors."""
        edges = [self.positions * k // self.chunks for k in range(self.chunks + 1)]
        spans = sorted(zip(edges, edges[1:]), key=lambda x: x[0] - x[1])
        whole, rest = divmod(self.radius, self.chunks)
        return [(a, b, whole if k <= rest else whole - 1) for k, (a, b) in enumerate(spans)]


class Signer:
    def __init__(self, index: Index):
        r = np.random.default_rng(index.seed)
        self.index = index
        self.mul = r.integers(1, 1 << 63, index.positions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = r.integers(1, 1 << 63, index.positions, dtype=np.uint64)
        self.masks = []  # of each key: positions that count, and a salt
        for a, b, errors in index.plan():
            for skip in ([None] if errors == 0 else list(range(a, b)) if errors == 1 else []):
                keep = [p for p in range(a, b) if p != skip]
                self.masks.append(keep or list(range(a, b)))
        self.salts = r.integers(1, 1 << 63, len(self.masks), dtype=np.uint64)
        width = max(map(len, self.masks), default=1)
        self.take = np.array([m + [m[0]] * (width - len(m)) for m in self.masks])
        self.odd = r.integers(1, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(self, shingles: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(4 bits of each position, packed; index keys made of 16 bits of each)."""
        least = np.full(self.index.positions, np.iinfo(np.uint64).max, dtype=np.uint64)
        for k in range(0, len(shingles), 4096):
            np.minimum(least, (shingles[k:k + 4096, None] * self.mul + self.add).min(0), out=least)
        value = _mix(least) >> np.uint64(48)
        low = (value & np.uint64(15)).astype(np.uint8)
        keys = _mix((value[self.take] * self.odd).sum(1) + self.salts)
        return (low[::2] | (low[1::2] << 4)).tobytes(), keys.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, index: Index, size: int) -> DataFrame:
    """(id, n_shingles, fp, sig, keys); the last three are null for texts without words."""
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()),
        T.StructField("fp", T.BinaryType()), T.StructField("sig", T.BinaryType()),
        T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(size), Signer(index)
        for b in slices(batches):
            n, fp, sig, keys = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingler.shingles(text)
                n.append(len(s))
                if len(s):
                    one, own = signer.sign(s)
                    fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sig.append(one)
                    keys.append(own)
                else:
                    fp.append(None), sig.append(None), keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, type=pa.int64()), pa.array(fp, type=pa.binary()),
                 pa.array(sig, type=pa.binary()), pa.array(keys, type=pa.list_(pa.int64()))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _distance(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return _NIBBLES[one ^ many].sum(-1, dtype=np.int64)


def _span(n: int, near) -> list[tuple[int, int]]:
    """(first, other) for the other items of each component of ``n`` items; ``near(i, rest)`` marks the neighbours of i in rest.

    Only items that are not yet reached are compared with, so one dense group
    costs one comparison for each of its items.
    """
    rest, edges = np.arange(n), []
    while len(rest) > 1:
        first, rest = int(rest[0]), rest[1:]
        work = [first]
        while work and len(rest):
            hit = near(work.pop(), rest)
            if hit.any():
                found = rest[hit].tolist()
                edges += [(first, j) for j in found]
                work += found
                rest = rest[~hit]
    return edges


def _runs(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``by`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in by]
        last = np.ones(b.num_rows, dtype=bool)
        for c in cols:
            last &= c == c[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if held and not cut:
            before = held[-1]
            if all(before.column(before.schema.get_field_index(c))[-1].as_py() == col[0] for c, col in zip(by, cols)):
                held.append(b)
                continue
            yield pa.Table.from_batches(held)
            held = [b]
            continue
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held = [b]
    if held:
        yield pa.Table.from_batches(held)


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(columns[0]) - 1, dtype=bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(columns[0])]])


def candidate_edges(signed: DataFrame, index: Index, whole_run: int = 20_000) -> DataFrame:
    """(a, b) that connect all signatures within the radius that meet under a key.

    The rows of a key that has over ``whole_run`` are connected with the smallest
    id without a look at the distances: components only grow by that, and every
    link inside them is confirmed later, so the answer is the same.  Such keys are
    counted and joined without signatures and never gathered in a task.
    """
    kind = signed.schema["id"].dataType
    rows, keyed = (signed.select("id", *sig, F.explode("keys").alias("key")) for sig in (["sig"], []))
    large = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a")).where(
        F.col("n") > whole_run).select("key", "a"))
    any_large = not large.isEmpty()
    if any_large:
        rows = rows.join(large, "key", "left_anti")
    rows = rows.repartition("key").sortWithinPartitions("key", "id")

    def run(batches):
        for t in _runs(batches, ["key"]):
            ids = t.column("id").to_numpy()
            key = t.column("key").to_numpy()
            at = _starts([key])
            size = np.diff(at)
            if not (size > 1).any():
                continue
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            two = at[:-1][size == 2]
            near = _distance(sig[two], sig[two + 1]) <= index.radius
            a, b = [ids[two][near]], [ids[two + 1][near]]
            for s, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist()):
                own = sig[s:s + n]
                edges = _span(n, lambda i, rest: _distance(own[i], own[rest]) <= index.radius)  # noqa: B023
                if edges:
                    e = np.array(edges) + s
                    a.append(ids[e[:, 0]]), b.append(ids[e[:, 1]])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    near = rows.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
    if not any_large:
        return near
    return near.unionByName(keyed.join(large, "key").where("id != a").select("a", F.col("id").alias("b")))


def _confirmed(rows: DataFrame, percent: int, size: int) -> DataFrame:
    """(a, b): confirmed links that connect what is linked within each (component, block).

    ``rows``: component, block, id, label, text.  Rows of one label are known to
    be connected and are not compared; a null label is a label of its own.  With
    a column ``side``, where a block has rows of both sides only those of one
    are compared with those of the other.
    """
    kind = rows.schema["id"].dataType
    two_sided = "side" in rows.columns

    def linked(t: pa.Table, shingler: Shingler, a: list, b: list):
        ids, labels = t.column("id").to_pylist(), t.column("label").to_pylist()
        if len(ids) < 2:
            return
        sets = [shingler.shingles(x) for x in t.column("text").to_pylist()]
        n = np.array([len(s) for s in sets])
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        edge = np.concatenate([[0], n.cumsum()])
        marks = np.zeros(len(names), dtype=np.int64)

        def near(i, rest):
            possible = rest[(100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])) & (n[rest] > 0)]
            hit = np.zeros(len(n), dtype=bool)
            if len(possible) and n[i]:
                own = flat[edge[i]:edge[i + 1]]
                marks[own] = 1
                take = np.concatenate([flat[edge[j]:edge[j + 1]] for j in possible])
                common = np.add.reduceat(marks[take], np.concatenate([[0], n[possible].cumsum()[:-1]]))
                marks[own] = 0
                hit[possible] = 100 * common >= percent * (n[i] + n[possible] - common)
            return hit[rest]

        known: dict = {}
        for i, label in enumerate(labels):
            known.setdefault(("own", i) if label is None else ("label", label), []).append(i)
        if len(known) == len(ids) and not two_sided:
            for i, j in _span(len(ids), near):
                a.append(ids[i]), b.append(ids[j])
            return
        # components that are known already: smaller ones look for a link to the rows of others, each pair once
        root, order = np.empty(len(ids), dtype=np.int64), sorted(known.values(), key=len)
        for k, own in enumerate(order):
            root[own] = k
        side = t.column("side").to_numpy() if two_sided else np.zeros(len(ids), dtype=np.int32)
        paired, left = side.min() != side.max(), np.ones(len(ids), dtype=bool)
        for i in [i for own in order[:-1] for i in own]:
            left[i] = False
            rest = np.flatnonzero(left & (root != root[i]) & (side != side[i] if paired else True))
            if not len(rest):
                continue
            for j in rest[near(i, rest)].tolist():
                a.append(ids[i]), b.append(ids[j])
                if root[j] != root[i]:
                    root[root == root[i]] = root[j]

    def run(batches):
        shingler = Shingler(size)
        for t in _runs(batches, ["component", "block"]):
            at = _starts([t.column("component").to_numpy(), t.column("block").to_numpy()])
            a, b = [], []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                linked(t.slice(s, e - s), shingler, a, b)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = rows.repartition("component", "block").sortWithinPartitions("component", "block", "id")
    return dealt.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def link_components(rows: DataFrame, percent: int, size: int, block_rows: int) -> DataFrame:
    """(node, component) of the links confirmed on full sets; ``rows``: component, id, text."""
    counts = rows.groupBy("component").agg(F.count("*").alias("n"))
    rows = rows.join(counts, "component").withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("n")
    rows = checkpointed(rows)
    label = F.lit(None).cast(rows.schema["id"].dataType).alias("label")
    edges = checkpointed(_confirmed(rows.select("component", "block", "id", label, "text"), percent, size))
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return connected_components(edges)

    # each row was in one block, whose links all start at the smallest id of the linked rows: its label so far
    first = edges.select(F.col("b").alias("id"), F.col("a").alias("label")).distinct()
    large = checkpointed(large.join(first, "id", "left").withColumn("label", F.coalesce("label", "id")))

    # one row of each block's largest label: these connect the bulk of the blocks, level by level
    sizes = large.groupBy("component", "block", "label").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("component", "block").orderBy(F.desc("n"), "label"))
    heads = sizes.withColumn("best", best).where("best = 1").select(
        "component", F.col("label").alias("id"), F.col("block").alias("of"))
    heads = checkpointed(large.select("component", "id", "text").join(heads, ["component", "id"]).dropDuplicates(["component", "id"]))
    labels = large.select("component", "id", "label", "block", "blocks", "text")
    while True:
        level = heads.withColumn("block", F.floor(F.col("of") / block_rows).cast("int"))
        links = checkpointed(_confirmed(level.select("component", "block", "id", label, "text"), percent, size))
        edges = edges.unionByName(links)
        higher = links.select(F.col("b").alias("label"), F.col("a").alias("higher")).distinct()
        labels = labels.join(higher, "label", "left").withColumn("label", F.coalesce("higher", "label")).drop("higher")
        if level.agg(F.max("block")).first()[0] == 0:
            break
        joined = level.join(higher.withColumnRenamed("label", "id"), "id", "left_anti")  # those that no other one took over
        best = F.row_number().over(Window.partitionBy("component", "block").orderBy("id"))
        heads = checkpointed(joined.withColumn("best", best).where("best = 1").select(
            "component", "id", "text", F.col("block").alias("of")))

    # what is outside the component's largest label is compared with all rows, as pairs of blocks
    labels = checkpointed(labels)
    sizes = labels.groupBy("component", "label").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("n"), "label"))
    main = sizes.withColumn("best", best).where("best = 1").select("component", F.col("label").alias("main"))
    sent = sizes.join(main, "component").groupBy("component").agg(
        F.first("main").alias("main"), F.sum(F.when(F.col("label") == F.col("main"), F.col("n"))).alias("n_main"),
        F.sum(F.when(F.col("label") != F.col("main"), F.col("n"))).alias("n_sent")).where("n_sent > 0")
    blocks = lambda n: F.ceil(F.col(n) / block_rows).cast("long")
    sent = sent.select("component", "main", blocks("n_sent").alias("s"), blocks("n_main").alias("m"))
    # blocks 0 to s - 1 are of the sent rows, s to s + m - 1 of the largest label; no pair of the latter is needed
    rows = labels.select("component", "id", "label", "text").join(sent, "component")
    outside, place = F.col("label") != F.col("main"), F.xxhash64("id")
    rows = rows.withColumn("side", F.when(outside, F.pmod(place, F.col("s"))).otherwise(F.col("s") + F.pmod(place, F.col("m"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(outside, F.col("s") + F.col("m")).otherwise(F.col("s")) - 1)))
    pair = F.least("side", "other") * (F.col("s") + F.col("m")) + F.greatest("side", "other")
    dealt = rows.select("component", pair.alias("block"), "id", "label", "text", "side")
    return connected_components(edges.unionByName(_confirmed(dealt, percent, size)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
                    size: int = 5, block_rows: int = 500) -> DataFrame:
    """(id, n_shingles, component_id, kept): documents linked by 100 * common >= percent * all shingles.

    ``component_id`` is the smallest id that links reach.  Texts that are null,
    empty or without words have no shingles and are linked with nothing.  Rows
    of one id are one document: equal texts count once, and of different texts
    the links of each count.  A null id stays alone (its component is null).
    Empty table: empty.  Other columns are ignored, whatever their names.
    """
    index = Index.for_threshold(percent / 100)
    prints = fingerprints(docs, id_col, text_col, index, size)
    prints = checkpointed(prints)
    whole = prints.where(F.col("fp").isNotNull() & F.col("id").isNotNull())
    classes = whole.groupBy("fp").agg(F.min("id").alias("rep"))
    members = checkpointed(whole.select("id", "n_shingles", "fp").join(classes, "fp").select("id", "n_shingles", "rep"))
    reps = members.where("id = rep").select("id").distinct()
    signed = whole.select("id", "sig", "keys").join(reps, "id").dropDuplicates(["id", "sig"])
    coarse = connected_components(candidate_edges(signed, index))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = coarse.select(F.col("node").alias("id"), "component").join(texts, "id")
    found = link_components(rows.select("component", "id", "text"), percent, size, block_rows)
    out = members.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = prints.where(F.col("fp").isNull() | F.col("id").isNull()).select(
        "id", "n_shingles", F.col("id").alias("component_id"))
    return out.unionByName(alone).select(
        F.col("id").alias(id_col), "n_shingles", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row of each near-duplicate component of ``docs`` (its smallest id), columns unchanged.

    Texts without words are linked with nothing and stay.  Of repeated rows of
    an id, the one whose text has the smallest hash stays; rows with a null id
    all stay.
    """
    kept = near_duplicates(docs, id_col, text_col, percent).where(F.col("kept") & F.col(id_col).isNotNull())
    rank = free_name(docs.columns, "rank")
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col)))
    rows = docs.join(kept.select(id_col).distinct(), id_col, "left_semi").withColumn(rank, first)
    return rows.where(F.col(rank) == 1).drop(rank).unionByName(docs.where(F.col(id_col).isNull()))
