"""Toxicity scores of deobfuscated text: a noisy channel decoded with Viterbi.

Every token of a text that is not a plain word (digits or symbols between
letters, letters drawn out, letters spaced apart) becomes a character lattice:
each observed character may stand for itself, for the letters it imitates, or,
if it is a separator or a repetition, for nothing.  The cheapest path under a
character trigram model is the restored word.  The trigram model counts all
documents (no labels), mixed with the words the classifier learned.  The score
is a logistic regression on the learned words that occur in the restored text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixfold.llm.common import checkpointed, free_name, map_rows, slices

#: What letters a character may imitate.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y"}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SIZE = 28  # boundary, a-z, any other letter
_OTHER = 27
_EDGES = ".,;:?\"'()[]{}«»“”‘’…-_*#~%&|<>/\\`^="
_ENDS = _EDGES + "!$@+"
_DRAWN_OUT = re.compile(r"(.)\1\1")
_PARTS = re.compile(r"[^\w@$!|+(<€£¥]+")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_CODES = np.full(256, _OTHER, dtype=np.int32)
_CODES[:128] = 0
for _i, _c in enumerate(_LETTERS):
    _CODES[ord(_c)] = _i + 1


def trigram_counts(text: str) -> np.ndarray:
    """Counts of (letter, letter, letter) codes; two boundaries stand before each word."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    raw = raw[(raw & 0xC0) != 0x80]  # one byte for each character
    c = _CODES[raw]
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # one boundary between words
    before = np.where(c[:-1] == 0, 0, np.concatenate([[0], c[:-2]]))
    return np.bincount(before * _SIZE * _SIZE + c[:-1] * _SIZE + c[1:], minlength=_SIZE ** 3)


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probability of the third code given the two before, backing off to shorter contexts."""
    n = counts.reshape(_SIZE, _SIZE, _SIZE).astype(float)
    uni = n.sum((0, 1)) + 1.0
    uni /= uni.sum()
    bi = n.sum(0)
    bi = (bi + 20 * uni) / (bi.sum(1, keepdims=True) + 20)
    tri = (n + 20 * bi[None]) / (n.sum(2, keepdims=True) + 20)
    return -np.log(tri)


def _code(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else _OTHER


@dataclass
class Restorer:
    """Viterbi decoding of a token's character lattice."""

    costs: list[float]  # trigram costs, flat

    def lattice(self, token: str) -> list[list[tuple[str, int, float]]]:
        """For each character its readings: (letter or nothing, code, cost of the channel)."""
        out, before = [], ""
        for i, c in enumerate(token):
            options = []
            if c.isalpha():
                options.append((c, _code(c), 0.0))
                if c > "z" and "a" <= (plain := unicodedata.normalize("NFD", c)[0]) <= "z":
                    options.append((plain, _code(plain), 1.0))
            else:
                options.append(("", 0, 2.5 if c in LOOKALIKES else 1.0))
            options += [(x, _code(x), 0.7) for x in LOOKALIKES.get(c, "")]
            if c == before:
                long = (i > 1 and token[i - 2] == c) or token[i + 1:i + 2] == c
                options.append(("", 0, 0.3 if long else 4.0))
            out.append(options)
            before = c
        return out

    def restore(self, token: str) -> str:
        costs, nothing = self.costs, _SIZE * _SIZE
        states = {(0, 0): (0.0, None)}  # the last two codes: cost and path
        for options in self.lattice(token):
            ahead: dict = {}
            for (a, b), (cost, path) in states.items():
                base = a * nothing + b * _SIZE
                for letter, code, channel in options:
                    if letter:
                        state, total, way = (b, code), cost + channel + costs[base + code], (letter, path)
                    else:
                        state, total, way = (a, b), cost + channel, path
                    if state not in ahead or total < ahead[state][0]:
                        ahead[state] = (total, way)
            states = ahead
        _, path = min(((cost + costs[a * nothing + b * _SIZE], path) for (a, b), (cost, path) in states.items()),
                      key=lambda x: x[0])
        letters = []
        while path:
            letters.append(path[0])
            path = path[1]
        return "".join(reversed(letters))


def words_of(token: str, restore) -> tuple[str, ...]:
    """The plain or restored words of a lower-cased token."""
    core = token.rstrip(_ENDS).lstrip(_EDGES)
    if core.isalpha() and not _DRAWN_OUT.search(core):
        return (core,)
    if not any(c.isalpha() for c in core):
        return ()
    parts = _PARTS.split(core)
    if len(parts) > 1 and all(len(p) > 1 for p in parts):
        return tuple(w for p in parts for w in words_of(p, restore))
    return (restore(core),)


@dataclass
class ToxicityModel:
    words: dict[str, float]  # learned words and their weights
    intercept: float
    costs: list[float]
    strong: float = 1.0  # weight from which a word is looked for in spaced-out letters
    cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def found(self, text: str | None) -> set[str]:
        """Learned words in the restored text."""
        if not text:
            return set()
        out, cache, restore = set(), self.cache, Restorer(self.costs).restore
        if len(cache) > 200_000:
            cache.clear()
        low = text.lower()
        for token in set(low.split()):
            hit = cache.get(token)
            if hit is None:
                hit = cache[token] = tuple(w for w in words_of(token, restore) if w in self.words)
            out.update(hit)
        for m in _SPACED.finditer(low):
            if any(c.isalpha() for c in m[0]):
                word = restore(re.sub(r"\s", "", m[0]))
                out.update(w for w, x in self.words.items() if len(w) > 3 and x >= self.strong and w in word)
        return out

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.intercept + sum(self.words[w] for w in sorted(self.found(text)))))))


def corpus_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all texts: summed in each task, then by a shuffle of at most 28**3 keys a task."""
    def run(batches):
        total = np.zeros(_SIZE ** 3, dtype=np.int64)
        for b in slices(batches, 64):
            total += trigram_counts(" ".join(t for t in b.column(0).to_pylist() if t))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    rows = docs.select(text_col).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_SIZE ** 3, dtype=np.int64)
    for r in rows:
        out[r["k"]] = r["n"]
    return out


def _word_table(sample: DataFrame) -> DataFrame:
    """(word, a, b) over the sample: toxic texts, and other texts.

    Near copies of one toxic text repeat its words in the same places, so ``a``
    is at most the number of different words that stand before the word.
    """
    def run(batches):
        toxic, clean, before = Counter(), Counter(), set()
        for b in slices(batches):
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = (text or "").lower().split()
                of = {t: words_of(t, lambda _: "") for t in set(tokens)}
                found = {w for words in of.values() for w in words}
                (toxic if label else clean).update(found)
                if label:
                    before.update((w, prev) for prev, t in zip(["", *tokens], tokens) for w in of[t])
        words, pairs = sorted(set(toxic) | set(clean)), sorted(before)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words + [w for w, _ in pairs], type=pa.string()),
             pa.array([None] * len(words) + [x for _, x in pairs], type=pa.string()),
             pa.array([toxic[w] for w in words] + [1] * len(pairs), type=pa.int64()),
             pa.array([clean[w] for w in words] + [0] * len(pairs), type=pa.int64())],
            names=["word", "prev", "a", "b"])

    rows = sample.select("text", "label").mapInArrow(run, "word string, prev string, a long, b long")
    return rows.groupBy("word", "prev").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).groupBy("word").agg(
        F.least(F.max(F.when(F.col("prev").isNull(), F.col("a"))), F.count("prev")).alias("a"), F.sum("b").alias("b"))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Newton steps for an L2-penalised logistic regression; the intercept is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_rows: int, seed: int) -> DataFrame:
    """(text, label) of about ``max_rows`` labelled rows at most, equal texts once.

    ``labels`` has the id and ``label`` (0 or 1).  The sampled labels are bounded
    by ``max_rows``, so they are broadcast; the documents are only scanned.
    """
    labels = labels.where(F.col("label").isNotNull() & F.col(id_col).isNotNull())
    share = min(1.0, max_rows / max(1, labels.count()))
    drawn = labels.where(F.rand(seed) < share).groupBy(id_col).agg(F.max("label").alias("label"))
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(drawn), id_col)
    key = F.xxhash64("text")
    return rows.select("text", F.col("label").cast("int").alias("label"), key.alias("key")).dropDuplicates(["key"]).drop("key")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = 20_000, max_words: int = 300, seed: int = 5, penalty: float = 0.1) -> ToxicityModel:
    """Learn the words and weights from a bounded labelled sample, and the trigrams from all documents."""
    sample = checkpointed(labelled_sample(docs, labels, id_col, text_col, max_rows, seed))
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    counts = corpus_trigrams(docs, text_col)
    if not n1 or not n0:
        rate = (n1 + 1) / (n1 + n0 + 2)
        return ToxicityModel({}, math.log(rate / (1 - rate)), trigram_costs(counts).ravel().tolist())

    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    gain = a * F.log(a / (n1 * (a + b) / (n1 + n0))) + b * F.log(b / (n0 * (a + b) / (n1 + n0)))
    table = _word_table(sample).where((F.col("a") >= 3) & (F.length("word") > 1) & (a * n0 > 3 * b * n1)).withColumn("gain", gain)
    words = [r["word"] for r in table.where("gain > 10").orderBy(F.desc("gain"), "word").limit(max_words).collect()]
    learned = sum((trigram_counts(w) for w in words), np.zeros(_SIZE ** 3, dtype=np.int64))
    mixed = counts / max(1, counts.sum()) + learned / max(1, learned.sum())
    model = ToxicityModel(dict.fromkeys(words, 0.0), 0.0,
                          trigram_costs(mixed * max(1, counts.sum())).ravel().tolist())
    model.strong = math.inf  # weights are not known yet
    where = {w: k for k, w in enumerate(words)}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda texts: [([where[w] for w in sorted(m.found(t))],) for t in texts]

    rows = map_rows(sample, ["text"], make, [("found", "array<int>")]).select("label", "found").collect()
    seen = Counter((r["label"], tuple(r["found"])) for r in rows)
    x = np.zeros((len(seen), len(words)))
    y, weight = np.zeros(len(seen)), np.zeros(len(seen))
    for i, ((label, found), n) in enumerate(sorted(seen.items())):
        x[i, list(found)], y[i], weight[i] = 1.0, label, n
    repeat = np.repeat(np.arange(len(seen)), weight.astype(int))
    w, intercept = logistic(x[repeat], y[repeat], penalty)
    model.words = {k: float(v) for k, v in zip(words, w)}
    model.intercept, model.strong = intercept, 1.0
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, text_col: str = "text",
                    score_col: str = "toxicity") -> DataFrame:
    """``docs`` with a score between 0 and 1 for each whole text.

    Null and empty texts get the score of a text without any learned word.
    Repeated rows: each its own (equal) score.  Empty table: empty.  The column
    name is an argument; other columns pass unchanged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda texts: [(m.score(t),) for t in texts]

    return map_rows(docs, [text_col], make, [(score_col, "double")])


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, columns unchanged."""
    name = free_name(docs.columns, "toxicity")
    return score_documents(docs, model, text_col, name).where(F.col(name) < threshold).drop(name)
