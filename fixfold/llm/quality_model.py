"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a whole text (lengths, character classes, repetition, function
words) are standardised and mapped through random Fourier features, which
approximate a Gaussian kernel.  Each partition of the labelled sample sums its
part of the normal equations; the driver solves the sum, a matrix whose size is
the number of features.  Isotonic regression on a held-back part of the sample
turns ridge scores into probabilities.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixfold.llm.common import checkpointed, map_rows
from fixfold.llm.quality_rules import COMMON_WORDS
from fixfold.llm.toxicity import labelled_sample

_COMMON = frozenset(COMMON_WORDS)
_CLASSES = np.zeros(256, dtype=np.int64)  # other letters and bytes
_CLASSES[[9, 10, 11, 12, 13, 32]] = 1
_CLASSES[97:123] = 2
_CLASSES[65:91] = 3
_CLASSES[48:58] = 4
_CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASSES[ord("!")] = 6
_CLASSES[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 7
_CLASSES[ord("|")] = 8
STATISTICS = ("log_words", "log_chars", "mean_word", "sd_word", "blank", "lower", "upper", "digit", "punct", "exclaim",
              "symbol", "pipe", "other", "distinct", "top_word", "bigram_repeat", "line_repeat", "common", "line_words",
              "sentence_words", "capital_words", "symbol_words")
_SENTENCE = re.compile(r"[.!?]+")


def statistics(text: str | None) -> list[float]:
    """Numbers of a whole text; all zero for a null or empty one."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    share = np.bincount(_CLASSES[raw], minlength=9) / len(raw)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    n = len(words)
    counts = Counter(words)
    pairs = n - 1 - len(set(zip(words, words[1:]))) if n > 1 else 0
    lines = [x for x in text.split("\n") if x.strip()]
    low = text.lower().split()
    return [math.log1p(n), math.log1p(len(text)), float(sizes.mean()), float(sizes.std()),
            share[1], share[2], share[3], share[4], share[5], share[6], share[7], share[8], share[0],
            len(counts) / n, max(counts.values()) / n, pairs / max(1, n - 1), 1 - len(set(lines)) / len(lines),
            sum(w in _COMMON for w in low) / n, math.log1p(n / len(lines)),
            math.log1p(n / max(1, len(_SENTENCE.findall(text)))),
            sum(w.isupper() for w in words) / n, sum(not w[-1].isalnum() and w[-1] not in ".,;:?'\")" for w in words) / n]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps_x: np.ndarray  # isotonic calibration: score -> probability
    steps_y: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.frequencies + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([np.ones((len(z), 1)), z, waves])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        raw = self.features(np.array([statistics(t) for t in texts])) @ self.weights
        return np.interp(raw, self.steps_x, self.steps_y)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; equal scores are one point.  Returns the points of a rising function."""
    at, where = np.unique(score, return_inverse=True)
    n, total = np.bincount(where), np.bincount(where, weights=label)
    blocks: list[list[float]] = []  # positives, rows, score sum
    for k in range(len(at)):
        blocks.append([total[k], n[k], at[k] * n[k]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    # (positives + prior) keeps the ends off exactly 0 and 1
    rate = (total.sum() + 1) / (n.sum() + 2)
    return (np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + rate) / (b[1] + 1) for b in blocks]))


def _partial_sums(rows: DataFrame, size: int, make) -> list[np.ndarray]:
    """Per partition ``make()`` folds batches of (statistics, label, part) into a vector of ``size`` numbers."""
    def run(batches):
        total, add = np.zeros(size), make()
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).to_pylist())
                total += add(x, np.array(b.column(1).to_pylist(), dtype=float), np.array(b.column(2).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], type=pa.binary())], names=["total"])

    return [np.frombuffer(r["total"]) for r in rows.select("x", "label", "part").mapInArrow(run, "total binary").collect()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 30_000,
        waves: int = 256, gamma: float = 0.02, ridge: float = 1.0, partitions: int = 16, seed: int = 3) -> QualityModel:
    """Fit on about ``max_rows`` labelled rows at most (equal texts once); every fifth calibrates.

    The sample's statistics are dealt into ``partitions`` parts, so the driver
    gets that many matrices whatever the sample's size.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, max_rows, seed)

    def make():
        return lambda texts: [(statistics(t),) for t in texts]

    rows = map_rows(sample, ["text"], make, [("x", "array<double>")]).select(
        "x", "label", F.pmod(F.xxhash64("x"), F.lit(5)).cast("int").alias("part"), F.xxhash64("x", "label").alias("key"))
    rows = checkpointed(rows.repartition(partitions, "key").drop("key"))
    d = len(STATISTICS)

    def moments():
        return lambda x, y, part: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0), [y.sum()]])

    total = sum(_partial_sums(rows, 2 * d + 2, moments), np.zeros(2 * d + 2))
    n, positives = max(1.0, total[0]), total[-1]
    mean = total[1:d + 1] / n
    sd = np.sqrt(np.maximum(0.0, total[d + 1:2 * d + 1] / n - mean ** 2))
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, np.where(sd > 1e-9, sd, 1.0), rng.normal(0, math.sqrt(2 * gamma), (d, waves)),
                         rng.uniform(0, 2 * math.pi, waves), np.zeros(1 + d + waves), np.zeros(1), np.zeros(1))
    rate = (positives + 1) / (n + 2)
    if not 0 < positives < n:  # one class only, or no labels
        model.steps_y = np.array([rate if total[0] else 0.5])
        return model
    size = 1 + d + waves

    def normal():
        def add(x, y, part):
            keep = part != 0
            f = model.features(x[keep])
            return np.concatenate([(f.T @ f).ravel(), f.T @ y[keep]])
        return add

    total = sum(_partial_sums(rows, size * size + size, normal))
    penalty = np.full(size, ridge)
    penalty[0] = 1e-6
    model.weights = np.linalg.solve(total[:size * size].reshape(size, size) + np.diag(penalty), total[size * size:])
    held = rows.where("part = 0").select("x", "label").collect()  # a fifth of the bounded sample
    if held:
        score = model.features(np.array([r["x"] for r in held])) @ model.weights
        model.steps_x, model.steps_y = isotonic(np.round(score, 6), np.array([r["label"] for r in held], dtype=float))
    else:
        model.steps_x, model.steps_y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score_documents(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "quality") -> DataFrame:
    """``docs`` with the calibrated probability of good quality of each whole text.

    Null and empty texts are scored like any other (all statistics zero).
    Repeated rows: each its own (equal) score.  Empty table: empty.  The column
    name is an argument; other columns pass unchanged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda texts: [(float(x),) for x in (m.scores(texts) if texts else ())]

    return map_rows(docs, [text_col], make, [(score_col, "double")])
