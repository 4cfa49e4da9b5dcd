"""Periodic runs of words, by enumeration of maximal pairs.

A maximal pair is two places of a text where the same stretch of ``depth`` words
begins, and where neither the word before nor the word after agrees.  If their
distance ``q`` is at most ``depth``, the two stretches touch or overlap, and what they
cover has the period ``q`` and cannot be extended: it is a run.  Every run with
smallest period ``q`` is the pair of its first word and the word ``q`` further
on, so the pairs within this bound are exactly the runs (a run of many periods
is met with 2q, 3q, ... as well; the least one counts).

Pairs come from the LCP-interval tree of the suffix array, bottom up: places in
different children of an interval agree for just its depth, places with
different words on the left are maximal there too.  An interval holds its
places in order and the ends of their classes (stretches of places with the
same word on the left).  When a child is joined, each place of the smaller side
looks from itself to the left and right, over whole classes, as far as the
depth.  So only pairs that are runs are met, and all their number is at most
proportional to the words.

A run of at least ``shortest`` words needs a depth of at least half of that, so
documents without a repeated stretch of that many words are passed over, and
only intervals of that depth are built.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixfold.llm.common import WORD, free_name

#: Words that a task works on at once, unless a single text has more.
_WORDS_AT_ONCE = 1 << 18

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def repeated_documents(words: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """Whether a document holds two equal stretches of ``depth`` words (a few without may come along).

    ``first`` holds the documents' first places and the number of all words.
    """
    docs = len(first) - 1
    places = len(words) - depth + 1
    found = np.zeros(docs, dtype=bool)
    if places < 1:
        return found
    of = np.repeat(np.arange(docs), np.diff(first))
    key = of[:places].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(depth):
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[k:k + places].astype(np.uint64)
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    whole = of[:places] == of[depth - 1:]
    key, of = key[whole], of[:places][whole]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    found[of[order[1:]][same]] = True
    return found


def suffix_order(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the suffixes of their documents, and how many words neighbours share.

    Prefix doubling over all documents at once: the ranks of 1, 2, 4, ... words,
    told apart by document, until all differ.  The ranks kept also give the
    shared words, from the largest power of two down.
    """
    n = len(words)
    lengths = np.diff(first)
    end = np.repeat(first[1:], lengths)
    here = np.arange(n)
    key = np.repeat(np.arange(len(lengths)), lengths) * (int(words.max()) + 1) + words
    ranks = [np.unique(key, return_inverse=True)[1].astype(np.int32)]
    step = 1
    while ranks[-1].max() < n - 1:
        rank = ranks[-1]
        inside = here + step < end
        key = rank.astype(np.int64) * (n + 1)
        key[inside] += rank[here[inside] + step] + 1  # a suffix that ends comes first
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
        step *= 2
    order = np.empty(n, dtype=np.int64)
    order[ranks[-1]] = here
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(n - 1, 0), dtype=np.int64)
    for level in range(len(ranks) - 2, -1, -1):  # of the last ranks no two are equal
        rank, size = ranks[level], 1 << level
        # ranks near a document's end stand for fewer words than the power says
        fits = (a + size <= end[order[:-1]]) & (b + size <= end[order[1:]])
        same = np.zeros(len(a), dtype=bool)
        same[fits] = rank[a[fits]] == rank[b[fits]]
        shared[same] += size
        a[same] += size
        b[same] += size
    return order, shared


class _Interval:
    """The places of an LCP interval in order, and those after which the word on the left changes."""

    __slots__ = ("places", "ends")

    def __init__(self, place: int):
        self.places, self.ends = [place], []

    def insert(self, place: int, left: list[int]) -> None:
        places, ends = self.places, self.ends
        k = bisect_left(places, place)
        if k and k < len(places) and left[places[k - 1]] != left[places[k]]:
            del ends[bisect_left(ends, places[k - 1])]
        if k and left[places[k - 1]] != left[place]:
            insort(ends, places[k - 1])
        if k < len(places) and left[place] != left[places[k]]:
            insort(ends, place)
        places.insert(k, place)

    def others(self, place: int, word: int, reach: int, left: list[int]) -> Iterator[int]:
        """Places within ``reach`` whose word on the left is another, on both sides of ``place``."""
        places, ends = self.places, self.ends
        k = bisect_left(places, place) - 1
        while k >= 0 and places[k] >= place - reach:
            if left[places[k]] == word:  # on to the class before
                e = bisect_left(ends, places[k]) - 1
                if e < 0 or ends[e] < place - reach:
                    break
                k = bisect_left(places, ends[e])
            yield places[k]
            k -= 1
        k = bisect_left(places, place)
        while k < len(places) and places[k] <= place + reach:
            if left[places[k]] == word:
                e = bisect_left(ends, places[k])
                if e == len(ends) or ends[e] >= place + reach:
                    break
                k = bisect_left(places, ends[e]) + 1
                if places[k] > place + reach:
                    break
            yield places[k]
            k += 1


def maximal_pairs(order: list[int], shared: list[int], left: list[int], shortest: int) -> Iterator[tuple[int, int, int]]:
    """(first place, end, distance) of the maximal pairs that are runs of at least ``shortest`` words.

    ``order`` are places in suffix order, ``shared[k]`` the words that
    ``order[k]`` and ``order[k + 1]`` share, ``left`` the word before each place.
    """
    open_: list[tuple[int, _Interval]] = []  # intervals on the way down to the place, by depth

    def join(a: _Interval, b: _Interval, depth: int):
        big, small = (a, b) if len(a.places) >= len(b.places) else (b, a)
        for p in small.places:
            for q in big.others(p, left[p], depth, left):
                near, far = (p, q) if p < q else (q, p)
                if far - near + depth >= shortest:
                    yield near, far + depth, far - near
        for p in small.places:
            big.insert(p, left)
        return big

    interval = _Interval(order[0])
    for k, depth in enumerate([*shared, -1]):
        while open_ and open_[-1][0] > depth:
            deeper, before = open_.pop()
            interval = yield from join(before, interval, deeper)
        if depth < 0:
            return
        if open_ and open_[-1][0] == depth:
            joined = yield from join(open_[-1][1], interval, depth)
            open_[-1] = (depth, joined)
        else:
            open_.append((depth, interval))
        interval = _Interval(order[k + 1])


def runs_of(texts: list[list[int]], shortest: int = 12) -> list[list[tuple[int, int, int]]]:
    """For each list of word numbers its runs (start, length, period) by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    depth = -(-shortest // 2)
    busy = [k for k, t in enumerate(texts) if len(t) >= shortest]
    if not busy:
        return found
    words, first = _joined([texts[k] for k in busy])
    busy = [busy[k] for k in np.flatnonzero(repeated_documents(words, first, depth))]
    if not busy:
        return found
    words, first = _joined([texts[k] for k in busy])
    order, shared = suffix_order(words, first)
    left = np.empty(len(words), dtype=np.int64)
    left[1:] = words[:-1]
    left[first[:-1]] = -1  # there is none
    left = left.tolist()
    least: dict[tuple[int, int], int] = {}
    # stretches of the suffix order whose neighbours share at least ``depth`` words
    deep = np.concatenate(([False], shared >= depth, [False]))
    edges = np.flatnonzero(deep[1:] != deep[:-1])
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        for start, end, q in maximal_pairs(order[a:b + 1].tolist(), shared[a:b].tolist(), left, shortest):
            key = start, end
            if q < least.get(key, end):
                least[key] = q
    at = np.searchsorted(first, [s for s, _ in least], side="right") - 1
    for ((start, end), q), k in zip(least.items(), at.tolist()):
        found[busy[k]].append((start - int(first[k]), end - start, q))
    for f in found:
        f.sort(key=lambda r: (r[0], r[2]))
    return found


def _joined(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    words = np.array([w for t in texts for w in t], dtype=np.int64)
    return words, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words no run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def find_runs(docs: DataFrame, text_col: str = "text", shortest: int = 12, runs_col: str = "runs",
              collapsed_col: str | None = "collapsed") -> DataFrame:
    """``docs`` with the runs of each whole text and the text without their repetitions.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A run is a stretch of
    words with smallest period ``q`` (words ``q`` apart are the same) and a length
    of at least ``max(shortest, 2 * q)`` that no neighbouring word extends.
    ``runs_col`` holds structs (start, length, period) by start, then period;
    ``collapsed_col`` (None: no such column) the words that no run holds after its
    first ``q`` words, joined by one space.

    Null, empty and blank texts have no runs and the collapsed text "".  Repeated
    rows stay, each with its runs; an empty table gives an empty one.  Other
    columns pass through, ids are not looked at; a column that is named like a
    new one is a ValueError.  A task holds about ``_WORDS_AT_ONCE`` words at a time, or
    one text if that has more.
    """
    if shortest < 2:
        raise ValueError("shortest must be at least 2")
    new = [T.StructField(runs_col, RUNS)] + ([T.StructField(collapsed_col, T.StringType())] if collapsed_col else [])
    if clash := {f.name.lower() for f in new} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns already present: {sorted(clash)}")
    schema = T.StructType(docs.schema.fields + new)
    from pyspark.sql.pandas.types import to_arrow_schema

    types = [f.type for f in to_arrow_schema(T.StructType(new))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            begin = 0
            while begin < b.num_rows:
                numbers: dict[str, int] = {}
                words: list[list[str]] = []
                taken, row = 0, begin
                while row < b.num_rows and (taken < _WORDS_AT_ONCE):
                    words.append(WORD.findall(texts[row].as_py() or ""))
                    taken += len(words[-1])
                    row += 1
                coded = [[numbers.setdefault(w, len(numbers)) for w in ws] for ws in words]
                runs = runs_of(coded, shortest)
                out = [pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], type=types[0])]
                if collapsed_col:
                    out.append(pa.array([" ".join(_pick(ws, rs)) for ws, rs in zip(words, runs)], type=types[1]))
                part = b.slice(begin, row - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=schema.names)
                begin = row

    return docs.mapInArrow(run, schema)


def _pick(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    if not runs:
        return words
    return [words[k] for k in np.flatnonzero(kept_words(len(words), runs)).tolist()]


def longest_run(runs: Column) -> Column:
    """The run of the greatest length, the first of equals, then the least period; null without runs."""
    ranked = F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("rank"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(ranked)
    return F.when(F.size(runs) > 0, F.struct(best["start"].alias("start"), (-best["rank"]).alias("length"),
                                             best["period"].alias("period")))


def run_lines(runs: Column) -> Column:
    """Every run as ``start,length,period`` and a line feed."""
    text = lambda r, n: r[n].cast("string")
    return F.array_join(F.transform(runs, lambda r: F.concat(
        text(r, "start"), F.lit(","), text(r, "length"), F.lit(","), text(r, "period"), F.lit("\n"))), "")


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 10) -> DataFrame:
    """``docs`` with periodic tails written into one document of ``one_in`` (a stand-in for degenerate texts).

    With h the crc32 of the id as decimal text and g = h // one_in, a text of n > 0 words for
    which h % one_in = 0 becomes its words, joined by one space, where from word
    a = g % n on the first p = 1 + (n - a) // (3 + g % 8) words are repeated.
    Other texts, and those of null ids, stay as they are.
    """
    h, w, g, n, a, p = (free_name(docs.columns, "_" + c) for c in ("h", "w", "g", "n", "a", "p"))
    chosen = docs.withColumn(h, F.crc32(F.col(id_col).cast("string").cast("binary")))
    is_chosen = F.coalesce(F.col(h) % one_in == 0, F.lit(False))
    words = F.filter(F.split(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    d = chosen.withColumn(w, F.when(is_chosen, words)).withColumn(g, F.floor(F.col(h) / one_in))
    d = d.withColumn(n, F.size(w)).withColumn(a, F.when(F.col(n) > 0, F.col(g) % F.col(n)).cast("int"))
    d = d.withColumn(p, (1 + F.floor((F.col(n) - F.col(a)) / (3 + F.col(g) % 8))).cast("int"))
    tail = F.col(n) - F.col(a)
    times = F.floor((tail + F.col(p) - 1) / F.col(p)).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(F.col(w), F.col(a) + 1, F.col(p)), times)), 1, tail)
    text = F.array_join(F.concat(F.slice(F.col(w), 1, F.col(a)), again), " ")
    return d.withColumn(text_col, F.when(F.col(n) > 0, text).otherwise(F.col(text_col))).drop(h, w, g, n, a, p)
