"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are the byte n-grams of its lower-cased words (a blank on
each side marks the word's ends), hashed into ``buckets``.  The model averages
their embeddings and applies a linear softmax; it is trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows.  As the softmax
is linear, embeddings and weights fold into one table of logits per bucket, so
a prediction is one pass of array operations over the whole text.  A temperature
fitted on held-out segments calibrates the score, and on the same segments a
limit is fitted below which answers are rejected (``und``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixfold.llm.common import checkpointed, map_rows

UNDETERMINED = "und"
#: Languages up to which their counts are broadcast (checked before).
_FEW = 10_000
_LETTER = re.compile(r"[^\W\d_]")
_NGRAMS = (2, 3, 4)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Multiplier of the rolling hash (fixed so that a model and its users agree).
_MULTIPLIER = np.uint32(0x9E3779B1)


def subwords(text: str, buckets: int) -> np.ndarray:
    """Bucket numbers of all n-grams within the words of ``text``."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    blank = _BLANK[raw]
    codes = np.where(blank, 32, raw).astype(np.uint32)
    seen, out = np.zeros(len(raw), dtype=np.uint32), []
    inner = np.ones(len(raw), dtype=bool)  # no blank strictly inside the n-gram
    for n in range(1, max(_NGRAMS) + 1):
        size = len(raw) - n + 1
        if size <= 0:
            break
        seen = (seen[:size] + np.uint32(1)) * _MULTIPLIER
        seen ^= seen >> np.uint32(15)
        seen += codes[n - 1:]
        if n >= 3:
            inner = inner[:size] & ~blank[n - 2:n - 2 + size]
        if n in _NGRAMS:
            keep = inner[:size] & ~(blank[:size] & blank[n - 1:])
            h = seen[keep] * _MULTIPLIER
            out.append((h ^ (h >> np.uint32(13))) % np.uint32(buckets))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # bucket x language: embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0  # fitted: answers with at least this score reach the wanted precision

    def scores(self, text: str) -> np.ndarray:
        h = subwords(text, len(self.logits))
        counts = np.bincount(h, minlength=len(self.logits)) if len(h) > len(self.logits) else None
        total = counts @ self.logits if counts is not None else self.logits[h].sum(0, dtype=np.float64)
        return (total / max(1, len(h)) + self.bias) / self.temperature

    def predict(self, text: str | None, reject_below: float | None = None) -> tuple[str, float]:
        """(language, score); ``und`` below the limit, the fitted one unless another is given."""
        reject_below = self.reject_below if reject_below is None else reject_below
        if not text or not _LETTER.search(text) or not self.languages:
            return UNDETERMINED, 0.0
        z = np.exp((s := self.scores(text)) - s.max())
        best = int(z.argmax())
        score = float(z[best] / z.sum())
        return (self.languages[best] if score >= reject_below else UNDETERMINED), score


def train(segments: list[tuple[str, str]], buckets: int = 1 << 15, dim: int = 16, epochs: int = 4,
          rate: float = 8.0, batch: int = 32, seed: int = 7, precision: float = 0.99) -> LanguageModel:
    """Fit on (language, text) segments; every tenth one calibrates the temperature and the limit of rejection.

    The limit is the lowest score from which on answers are right in ``precision`` of the held-out segments.
    """
    languages = sorted({x for x, _ in segments})
    number = {x: k for k, x in enumerate(languages)}
    data = [(number[x], *np.unique(subwords(t, buckets), return_counts=True)) for x, t in segments]
    data = [d for d in data if len(d[1])]
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    weights, bias = np.zeros((dim, len(languages))), np.zeros(len(languages))
    order = rng.permutation(len(data))
    fit, held = (order[len(order) // 10:], order[:len(order) // 10]) if len(data) >= 100 else (order, order)
    steps = max(1, epochs * -(-len(fit) // batch))
    step = 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for k in range(0, len(fit), batch):
            part = [data[i] for i in fit[k:k + batch]]
            used, where = np.unique(np.concatenate([p[1] for p in part]), return_inverse=True)
            x = np.zeros((len(part), len(used)))
            x[np.repeat(np.arange(len(part)), [len(p[1]) for p in part]), where] = np.concatenate([p[2] / p[2].sum() for p in part])
            mean = x @ emb[used]
            z = mean @ weights + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), [q[0] for q in part]] -= 1
            p /= len(part)
            now = rate * (1 - step / steps)
            back = x.T @ (p @ weights.T)
            weights -= now * mean.T @ p
            bias -= 0.1 * now * p.sum(0)
            emb[used] -= now * back
            step += 1
    model = LanguageModel(languages, emb @ weights, bias)
    if len(held):
        z = np.array([(d[2] @ model.logits[d[1]]) / d[2].sum() + bias for d in (data[i] for i in held)])
        y = np.array([data[i][0] for i in held])

        def loss(t):
            s = z / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

        model.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
        z /= model.temperature
        sure = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
        order = np.argsort(-sure, kind="stable")
        right = np.cumsum((z.argmax(1) == y)[order])
        good = np.flatnonzero(right >= precision * np.arange(1, len(y) + 1))
        model.reject_below = float(sure[order][good[-1]]) if len(good) else 1.0
    return model


def _segmenter(segments: int, words: int):
    def make():
        def fn(texts):
            out = []
            for t in texts:
                t = t or ""
                w = t.split()
                if len(w) > len(t) // 20:  # usual words
                    n = max(1, min(segments, -(-len(w) // words)))
                    starts = [k * max(0, len(w) - words) // max(1, n - 1) for k in range(n)]
                    found = [" ".join(w[s:s + words])[:10 * words] for s in starts]
                else:  # no blanks, or very long words: passages of characters
                    size = 6 * words
                    n = max(1, min(segments, -(-len(t) // size)))
                    found = [t[s:s + size] for s in (k * max(0, len(t) - size) // max(1, n - 1) for k in range(n))]
                out.append((found,))
            return out
        return fn
    return make


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 3000,
        max_rows: int = 60_000, least: int = 20, segments: int = 4, words: int = 64, seed: int = 11,
        **training) -> LanguageModel:
    """Train on a bounded sample of labelled rows of every language.

    Bounds: about ``per_language`` rows of a language, fewer where that would make more
    than ``max_rows`` rows in all, but never fewer than ``least`` (so each value of the
    column is learned, however many there are); of each row ``segments`` evenly
    spaced passages of ``words`` words, or of six times as many characters of texts
    with few blanks.  Rows without language are left out.
    """
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null")
    counts = checkpointed(rows.groupBy("lang").agg(F.count("*").alias("_n")))
    languages = counts.count()
    if not languages:
        return LanguageModel([], np.zeros((1, 0)), np.zeros(0))
    wanted = max(least, min(per_language, max_rows // languages))
    # drawn by row, not by text, so copies of one text weigh no more than their number
    share = F.least(F.lit(1.0), wanted / F.col("_n"))
    # a few languages are sent to the texts; a column with more values than that is joined by a shuffle
    sample = rows.join(F.broadcast(counts) if languages <= _FEW else counts, "lang").where(F.rand(seed) < share).drop("_n")
    got = map_rows(sample, ["text"], _segmenter(segments, words), [("segments", "array<string>")])
    data = sorted((r["lang"], s) for r in got.select("lang", "segments").collect() for s in r["segments"])
    return train(data, **training)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang_pred",
            score_col: str = "lang_score", reject_below: float | None = None) -> DataFrame:
    """``docs`` with the predicted language and its calibrated score.

    Below ``reject_below`` (the model's fitted limit if None; 0 rejects nothing) the language is ``und``.

    Whole texts are read.  Null texts and texts without a letter: ``und`` and 0.
    Ties go to the first language by name.  Repeated rows: each its own answer.
    Empty table: empty.  Column names are arguments; other columns pass unchanged.
    """
    model.logits = model.logits.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda texts: [m.predict(t, reject_below) for t in texts]

    return map_rows(docs, [text_col], make, [(lang_col, "string"), (score_col, "double")])
