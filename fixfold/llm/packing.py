"""Sum-of-squares online packing of token sequences.

Each task packs its own documents in one pass, so nothing is shuffled and no
driver state exists.  A task tracks its partially filled windows in a level
array: ``count[h]`` is the number of open windows that hold ``h`` tokens.  A
document's whole windows are cut off first; the rest goes to the fill level at
which the sum of squared counts grows least.  The number of open windows is
bounded (``max_open``): when a new one would exceed the bound, the rest is cut
to fill the emptiest open window.  At the end of a task the open windows are
emptied into each other by cutting, and what is left over after the last whole
window is laid out in sequences whose lengths are powers of two.  So no
sequence needs padding.

Sequence ids are ``partition * 2**40 + running number``: unique, and the same
when a lost task is run again, for its input partition is read in the same order.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fixfold.llm.common import slices

#: Characters on which both byte-level BPE implementations split alike whatever
#: Unicode tables they carry; any other text goes to the reference library.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ‐-‧€]*")
_SEQUENCES = 1 << 40


@functools.lru_cache(maxsize=4)
def byte_bpe_encoder(tokenizer_json: str, ranks: str | None = None, pattern: str | None = None,
                     plain_specials: bool = False):
    """``encode(texts) -> list of id lists`` for a byte-level BPE tokenizer file.

    The file is taken as it is: strings of its special tokens that stand in a
    text give their ids.  With ``plain_specials`` they are ordinary text.

    With ``ranks`` (the same vocabulary as a rank file) and its split
    ``pattern``, texts of well-known characters without such strings take the
    faster library; the ids are the same (tests compare them).
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_json)
    slow.encode_special_tokens = plain_specials
    special = [] if plain_specials else [t.content for t in slow.get_added_tokens_decoder().values()]
    fast = None
    if ranks:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [fast.encode_ordinary(t) if fast is not None and _PLAIN.fullmatch(t) and not any(x in t for x in special)
                else slow.encode(t, add_special_tokens=False).ids for t in texts]

    return encode


class Packer:
    """Packs items (key, ids) into windows; ``add`` and ``finish`` return closed sequences.

    A closed sequence is a list of pieces ``(key, start, ids, total)``.
    """

    def __init__(self, window: int = 1024, max_open: int = 256):
        if window < 1 or max_open < 1:
            raise ValueError("window and max_open must be positive")
        self.window, self.max_open = window, max_open
        self.count = np.zeros(window + 1, dtype=np.int64)  # the level array
        self.levels: list[list[list]] = [[] for _ in range(window + 1)]  # open windows by level
        self.open = 0

    def _level(self, size: int) -> int:
        """Level to put ``size`` tokens on: the least growth of the sum of squares, then the fullest; 0 is a new window."""
        top = self.window - size
        below, above = self.count[1:top + 1], self.count[size + 1:self.window + 1]
        growth = 2 * (above - below) + 2
        if top >= 1:
            growth[-1] = 1 - 2 * self.count[top]  # a window that becomes full is no longer counted
        growth = np.where(below > 0, growth, np.iinfo(np.int64).max)
        fresh = 2 * int(self.count[size]) + 1
        if top >= 1:
            best = top - int(np.argmin(growth[::-1]))
            if self.count[best] and (growth[best - 1] <= fresh or self.open >= self.max_open):
                return best
        return 0

    def _put(self, level: int, piece: tuple, closed: list) -> None:
        if level:
            pieces = self.levels[level].pop()
            self.count[level] -= 1
            self.open -= 1
        else:
            pieces = []
        pieces.append(piece)
        level += len(piece[2])
        if level == self.window:
            closed.append(pieces)
        else:
            self.levels[level].append(pieces)
            self.count[level] += 1
            self.open += 1

    def add(self, key, ids: np.ndarray) -> list[list[tuple]]:
        closed: list[list[tuple]] = []
        total, start = len(ids), 0
        while total - start >= self.window:
            closed.append([(key, start, ids[start:start + self.window], total)])
            start += self.window
        while start < total:
            size = total - start
            level = self._level(size)
            if not level and self.open >= self.max_open:
                level = int(np.flatnonzero(self.count)[0])  # the emptiest: fill it by a cut
                size = self.window - level
            self._put(level, (key, start, ids[start:start + size].copy(), total), closed)
            start += size
        return closed

    def finish(self) -> list[list[tuple]]:
        """Empty the open windows into each other, the last one into powers of two."""
        closed: list[list[tuple]] = []
        left = [(h, w) for h in range(self.window, 0, -1) for w in self.levels[h]]
        low = len(left) - 1
        high = 0
        donor = left[low][1] if left else []
        while high < low:
            level, pieces = left[high]
            gap = self.window - level
            while gap and high < low:
                if not donor:
                    low -= 1
                    donor = left[low][1]
                    continue
                key, start, ids, total = donor.pop()
                if len(ids) > gap:
                    donor.append((key, start, ids[:-gap], total))
                    start, ids = start + len(ids) - gap, ids[-gap:]
                pieces.append((key, start, ids, total))
                gap -= len(ids)
            if not gap:
                closed.append(pieces)
                high += 1
        rest = left[high][1] if left and high == low else []
        size = sum(len(p[2]) for p in rest)
        while size:
            room = 1 << (size.bit_length() - 1)
            size -= room
            part = []
            while room:
                key, start, ids, total = rest.pop()
                if len(ids) > room:
                    rest.append((key, start + room, ids[room:], total))
                    ids = ids[:room]
                part.append((key, start, ids, total))
                room -= len(ids)
            closed.append(part)
        self.__init__(self.window, self.max_open)
        return closed


def pack_documents(docs: DataFrame, encoder, id_col: str = "doc_id", text_col: str = "text",
                   window: int = 1024, end_id: int = 0, max_open: int = 256,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``encoder()`` is called once per task and returns ``encode(texts)``.  Each
    document is its ids and then ``end_id``; each id lies in exactly one piece.
    ``with_ids`` adds the piece's ids.

    Null and empty texts: one piece with ``end_id`` alone.  Null and repeated
    ids: each row is packed as a document of its own.  Very long texts: whole
    windows, then the rest.  Empty table: no rows.  Other columns of ``docs``
    are ignored, whatever their names.
    """
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType())]
        + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = encoder(), Packer(window, max_open)
        base, made, out, kind = TaskContext.get().partitionId() * _SEQUENCES, 0, [], None

        def emit(sequences):
            nonlocal made
            for pieces in sequences:
                offset = 0
                for key, start, ids, total in pieces:
                    row = (key, start, len(ids), zlib.crc32(ids.tobytes()), total, base + made, offset)
                    out.append(row + (ids.astype(np.int32),) if with_ids else row)
                    offset += len(ids)
                made += 1

        def batch():
            types = [kind] + [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=t) for c, t in zip(columns, types)], names=schema.names)

        for b in slices(batches, 64):  # bounds what is encoded but not yet packed
            kind = b.schema.field(0).type
            texts = [t or "" for t in b.column(1).to_pylist()]
            for key, ids in zip(b.column(0).to_pylist(), encode(texts)):
                emit(packer.add(key, np.array([*ids, end_id], dtype="<u4")))
            if len(out) >= 4096:
                yield batch()
        emit(packer.finish())
        if out:
            yield batch()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
