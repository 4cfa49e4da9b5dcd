"""Alignment of two tokenizers' tokens over the same bytes.

Every token points to the token of the other side that overlaps it and reaches
farthest to the right: the one that holds its last byte.  Where both end at the
same byte the first side's token points to itself and is the end of a group.
Successor doubling (``s = s[s]`` until nothing changes) then leads every token to
the last token of its group, over all documents of a batch at once, for at a
document's end both sides end.

Links are the pairs of tokens that share a group.  How many documents of the
corpus hold a pair of ids linked is counted over chunks: a task deals its
documents into chunks and writes, per chunk, the distinct pairs with their numbers of
documents, and per document positions in that list.  So what is shuffled
to count and to look up is one row per chunk and pair, not one per document
and pair, and counts of any number of pairs come back by a join.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixfold.llm.common import slices
from fixfold.session import ensure_checkpoint_dir

#: Characters that are encoded at once; positions of pairs that a chunk holds; pairs that are laid out at once.
_CHARS_AT_ONCE, _CHUNK_PAIRS, _PAIRS_AT_ONCE = 1 << 20, 1 << 21, 1 << 22


class Side:
    """One tokenizer: ``encode(texts)`` gives id lists, ``token[id]`` the bytes of an id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], token: list[bytes | None]):
        self.encode, self.token = encode, token
        self.size = np.array([len(t or b"") for t in token], dtype=np.int64)
        numbers = [str(i) for i in range(len(token))]
        #: ids as text, with what may stand behind them
        self.shown = {mark: np.array([n + mark for n in numbers], dtype=object) for mark in ",|;"}

    def bytes_of(self, ids: list[int]) -> bytes | None:
        """The joined bytes; None if an id stands for no bytes."""
        try:
            return b"".join([self.token[i] for i in ids])
        except TypeError:
            return None


def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@functools.lru_cache(maxsize=4)
def byte_level_side(tokenizer_json: str, ranks: str | None = None, pattern: str | None = None) -> Side:
    """A byte-level BPE file; strings of special tokens are plain text.  The text gets a space in front."""
    from tokenizers import Tokenizer

    from fixfold.llm.packing import byte_bpe_encoder

    letters = byte_letters()
    tokenizer = Tokenizer.from_file(tokenizer_json)
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    token: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
    for t, i in vocabulary.items():
        if all(c in letters for c in t):
            token[i] = bytes(letters[c] for c in t)
    encode = byte_bpe_encoder(tokenizer_json, ranks, pattern, plain_specials=True)
    return Side(lambda texts: encode([" " + t for t in texts]), token)


@functools.lru_cache(maxsize=4)
def piece_side(model_file: str) -> Side:
    """A piece model with byte fallback, which itself puts a space in front."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    token: list[bytes | None] = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            token.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            token.append(None)
        else:
            token.append(piece.replace("▁", " ").encode())
    return Side(lambda texts: model.encode(texts, num_threads=1), token)


def group_labels(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers (from 0, left to right) of both sides' tokens, given where they end.

    Both sides cover the same bytes, without gaps and empty tokens.
    """
    n, m = len(end_a), len(end_b)
    to_b = np.searchsorted(end_b, end_a)  # the first that ends there or later holds the last byte
    to_a = np.searchsorted(end_a, end_b)
    here = np.arange(n)
    successor = np.concatenate((np.where(end_b[to_b] > end_a, n + to_b, here), to_a)) if n else np.empty(0, np.int64)
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            break
        successor = further
    last = np.zeros(n, dtype=np.int64)
    last[successor[:n]] = 1
    number = np.cumsum(last) - 1
    label = number[successor]
    return label[:n], label[n:n + m]


def group_pairs(label_a: np.ndarray, a: np.ndarray, label_b: np.ndarray, b: np.ndarray,
                owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, a * width + b, times) of the id pairs that share a group, sorted, each once per owner.

    ``owner[g]`` is the document of group ``g``.  Equal ids of a group are put
    together first, and the pairs are laid out in blocks, so a long group needs
    no more room than its distinct pairs.
    """
    ga, ia, ta = _distinct(label_a, a)
    gb, ib, tb = _distinct(label_b, b)
    upto_b = np.concatenate(([0], np.cumsum(np.bincount(gb, minlength=len(owner)))))
    from_ = upto_b[ga]
    count = upto_b[ga + 1] - from_
    upto = np.concatenate(([0], np.cumsum(count)))
    found = []
    row = 0
    while row < len(ga):
        stop = max(int(np.searchsorted(upto, upto[row] + _PAIRS_AT_ONCE, side="right")) - 1, row + 1)
        c = count[row:stop]
        left = np.repeat(np.arange(row, stop), c)
        right = np.arange(len(left)) + np.repeat(from_[row:stop] - (upto[row:stop] - upto[row]), c)
        found.append(_summed(owner[ga[left]], ia[left] * np.int64(width) + ib[right], ta[left] * tb[right]))
        row = stop
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    return found[0] if len(found) == 1 else _summed(*(np.concatenate(c) for c in zip(*found)))


def _distinct(label: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids of each group and how often they occur; labels ascend already."""
    order = np.flatnonzero(label[1:] == label[:-1])
    if len(order):  # only groups of several tokens need sorting
        key = label << np.int64(32) | ids
        several = np.zeros(len(ids), dtype=bool)
        several[order] = several[order + 1] = True
        key[several] = np.sort(key[several])
        new = np.concatenate(([True], key[1:] != key[:-1]))
        starts = np.flatnonzero(new)
        return key[starts] >> 32, key[starts] & 0xFFFFFFFF, np.diff(starts, append=len(key))
    return label, ids, np.ones(len(ids), dtype=np.int64)


def _summed(first: np.ndarray, second: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, with the sums of ``times`` (both below 2**31 and 2**32)."""
    key = first << np.int64(32) | second
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[:len(key)])
    total = np.add.reduceat(times, starts) if len(starts) else times
    return key[starts] >> 32, key[starts] & 0xFFFFFFFF, total


def aligned_texts(texts: list[str | None], one: Side, two: Side) -> dict:
    """Alignment of some texts: counts per text, the groups as text, and the id pairs linked.

    Texts without tokens (null, empty, or bytes that differ on a side) count 0.
    """
    n = len(texts)
    some = [k for k, t in enumerate(texts) if t]
    ids = list(zip(one.encode([texts[k] for k in some]), two.encode([texts[k] for k in some])))
    kept = []
    for k, (x, y) in zip(some, ids):
        want = (" " + texts[k]).encode()
        if one.bytes_of(x) == want and two.bytes_of(y) == want:
            kept.append((k, x, y))
    n_a, n_b = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for k, x, y in kept:
        n_a[k], n_b[k] = len(x), len(y)
    a = np.fromiter(chain.from_iterable(x for _, x, _ in kept), dtype=np.int64, count=int(n_a.sum()))
    b = np.fromiter(chain.from_iterable(y for _, _, y in kept), dtype=np.int64, count=int(n_b.sum()))
    label_a, label_b = group_labels(np.cumsum(one.size[a]), np.cumsum(two.size[b]))
    groups = int(label_a[-1]) + 1 if len(label_a) else 0
    in_a, in_b = np.bincount(label_a, minlength=groups), np.bincount(label_b, minlength=groups)
    owner = np.zeros(groups, dtype=np.int64)
    owner[label_a] = np.repeat(np.arange(n), n_a)
    docs, pairs, times = group_pairs(label_a, a, label_b, b, owner, len(two.token))
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(owner, minlength=n),
            "n_links": np.bincount(owner, weights=in_a * in_b, minlength=n).astype(np.int64),
            "groups": _shown(a, b, label_a, label_b, in_a, in_b, n_a + n_b, one, two),
            "docs": docs, "pairs": pairs, "times": times}


def _shown(a, b, label_a, label_b, in_a, in_b, per_text, one: Side, two: Side) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each text."""
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    marks = np.empty(len(a) + len(b), dtype=object)
    # before a token: the tokens of its side before it, and the other side's of the groups before (and, for b, of its own)
    at_a = np.arange(len(a)) + (upto_b - in_b)[label_a]
    at_b = np.arange(len(b)) + upto_a[label_b]
    last_a = np.arange(len(a)) + 1 == upto_a[label_a]
    last_b = np.arange(len(b)) + 1 == upto_b[label_b]
    for at, ids, last, side, mark in ((at_a, a, last_a, one, "|"), (at_b, b, last_b, two, ";")):
        marks[at[~last]] = side.shown[","][ids[~last]]
        marks[at[last]] = side.shown[mark][ids[last]]
    out, begin, marks = [], 0, marks.tolist()
    for size in per_text.tolist():
        out.append("".join(marks[begin:begin + size])[:-1])
        begin += size
    return out


def _aligned_schema(id_field: T.StructField) -> T.StructType:
    return T.StructType([id_field, *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")],
                         T.StructField("groups", T.StringType()), T.StructField("chunk", T.LongType()),
                         # steps between positions in the chunk's pairs, and how often each is linked (little-endian)
                         T.StructField("steps", T.BinaryType()), T.StructField("times", T.BinaryType()),
                         # on the first row of a chunk only: its distinct pairs and how many of its documents hold each
                         T.StructField("chunk_pairs", T.ArrayType(T.LongType())),
                         T.StructField("chunk_docs", T.ArrayType(T.IntegerType()))])


def align_documents(docs: DataFrame, one: Callable[[], Side], two: Callable[[], Side], id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: counts, the groups as text, and the pairs linked, by chunk.

    A pair is the number ``id of one * size of two's vocabulary + id of two``.
    Chunk numbers hold as long as a task's rows do: write the table before it is used twice.
    """
    schema = _aligned_schema(T.StructField("id", docs.schema[id_col].dataType))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        left, right = one(), two()
        chunk = TaskContext.get().partitionId() << 32
        ids: list = []
        held: list[dict] = []
        for part in _by_chars(batches):
            ids += part.column(0).to_pylist()
            held.append(aligned_texts(part.column(1).to_pylist(), left, right))
            if sum(len(h["pairs"]) for h in held) >= _CHUNK_PAIRS:
                yield _chunk_rows(chunk, ids, held, arrow)
                chunk, ids, held = chunk + 1, [], []
        if ids:
            yield _chunk_rows(chunk, ids, held, arrow)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def _by_chars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows and characters (one row at least)."""
    for b in slices(batches, 2048):
        sizes = [len(t.as_py() or "") for t in b.column(1)]
        begin, taken = 0, 0
        for k, size in enumerate(sizes):
            if k > begin and taken + size > _CHARS_AT_ONCE:
                yield b.slice(begin, k - begin)
                begin, taken = k, 0
            taken += size
        yield b.slice(begin)


def _chunk_rows(chunk: int, ids: list, held: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    pairs, place = np.unique(np.concatenate([h["pairs"] for h in held]), return_inverse=True)
    times = np.concatenate([h["times"] for h in held])
    rows = np.concatenate([np.bincount(h["docs"], minlength=len(h["n_a"])) for h in held])
    step = np.diff(place, prepend=0)
    first = np.concatenate(([0], np.cumsum(rows)))
    starts = first[:-1][rows > 0]
    step[starts] = place[starts]
    step, times = step.astype("<u4"), times.astype("<u4")
    cut = lambda column: [column[i:j].tobytes() for i, j in zip(first, first[1:])]
    carrier = [None] * (len(ids) - 1)
    columns = [ids, *[np.concatenate([h[c] for h in held]) for c in ("n_a", "n_b", "n_groups", "n_links")],
               [g for h in held for g in h["groups"]], [chunk] * len(ids), cut(step), cut(times),
               [pairs] + carrier, [np.bincount(place, minlength=len(pairs)).astype(np.int32)] + carrier]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _chunk_pairs(aligned: DataFrame) -> DataFrame:
    """(chunk, place, pair, docs): one row for each distinct pair of a chunk."""
    held = aligned.where(F.col("chunk_pairs").isNotNull()).select(
        "chunk", F.posexplode(F.arrays_zip("chunk_pairs", "chunk_docs")).alias("place", "x"))
    return held.select("chunk", "place", F.col("x.chunk_pairs").alias("pair"), F.col("x.chunk_docs").alias("docs"))


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, count, is_best): how many documents hold the pair, and whether no pair of the same first id has more."""
    counts = _chunk_pairs(aligned).groupBy("pair").agg(F.sum("docs").alias("count"))
    counts = counts.withColumn("a", (F.col("pair") - F.col("pair") % width) / width)
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("is_best"))


def link_documents(docs: DataFrame, one: Callable[[], Side], two: Callable[[], Side], width: int,
                   id_col: str = "doc_id", text_col: str = "text",
                   groups_as: Callable[[Column], Column] = lambda g: g) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``one`` and ``two`` make the sides in a task; ``width`` is the size of two's
    vocabulary.  A pair's count is the number of documents (rows) that hold it
    linked; ``n_best`` counts a document's links whose count no other pair with the
    same first id exceeds, ``count_sum`` adds the counts over its links.
    ``groups`` is ``a1,a2|b1;a3|b2,b3``, kept as what ``groups_as`` makes of it.

    Null and empty texts, and texts of which a side gives other bytes, have no
    tokens: zeros and an empty ``groups``.  Repeated rows and ids are documents of
    their own; null ids stay.  An empty table gives an empty one.  Other columns are
    ignored, whatever their names.  A text is aligned whole, in one task's memory.
    The alignment is written to the shared checkpoint folder and read again.
    """
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    aligned = align_documents(docs, one, two, id_col, text_col)
    aligned.withColumn("groups", groups_as(F.col("groups"))).write.parquet(path)
    aligned = spark.read.parquet(path)
    looked_up = _chunk_pairs(aligned).join(pair_counts(aligned, width), "pair").select(
        F.col("chunk").alias("of_chunk"), "place", "count", "is_best")
    out = T.StructType([aligned.schema["id"], *[T.StructField(n, T.LongType()) for n in (
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], aligned.schema["groups"]])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        place = found["place"].to_numpy()
        counts, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        counts[place], best[place] = found["count"].to_numpy(), found["is_best"].to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for steps, times in zip(rows["steps"], rows["times"]):
            at = np.cumsum(np.frombuffer(steps.as_buffer(), dtype="<u4"), dtype=np.int64)
            n = np.frombuffer(times.as_buffer(), dtype="<u4").astype(np.int64)
            n_best.append(int((best[at] * n).sum()))
            count_sum.append(int((counts[at] * n).sum()))
        columns = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        return pa.Table.from_arrays([columns[f.name] if f.name in columns else rows[f.name].cast(f.type) for f in arrow],
                                    schema=arrow)

    rows = aligned.drop("chunk_pairs", "chunk_docs")
    scored = rows.groupBy("chunk").cogroup(looked_up.groupBy("of_chunk")).applyInArrow(score, out)
    return scored.withColumnRenamed("id", id_col)

