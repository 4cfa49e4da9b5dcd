"""Quality rules by distribution divergence, in DataFrame functions only.

Two histograms of a text are compared with references of each language by the
Jensen-Shannon distance: the shares of seven character classes, and the shares
of common words (all others in one bin).  The references are the medians, bin
by bin, over all documents of a language, so a minority of junk or of copies
does not move them.  A text is judged by its nearest language.  Sampling noise
alone gives a short text some distance, so the limits grow with bins / length,
and texts under a minimum length are not judged by their common words at all.

Plain rules come first: fewer than 50 words, or more than half of the words in
three-word windows that occur twice or more.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ASCII white space that ends words.
BLANKS = r"\x20\x09-\x0D"
#: Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in is that it for with as was on are by this be or from an a "
    "der die das und ist nicht mit von zu den ein eine für auf im "
    "le la les et des du que en un une est dans pour pas sur "
    "el los las y del se por con no para").split()
#: Character classes (inside of a regular expression's brackets).  White space and all other
#: characters (lower-case letters above all) are two more bins, counted without a scan of their own.
CLASSES = ("A-Z", "0-9", r".,;:!?'\"()\-", r"\x{80}-\x{10FFFF}", r"\x00-\x08\x0E-\x1F#$%&*+/<=>@\[\\\]^_`{|}~\x7F")
CLASS_BINS, WORD_BINS = len(CLASSES) + 2, len(COMMON_WORDS) + 1
#: The references of up to so many languages are spelled out in the plan; more are an array that is walked.
SPELLED_OUT = 50


@dataclass
class References:
    """Per language: shares of the character classes and of the common words."""

    classes: dict[str, list[float]] = field(default_factory=dict)
    words: dict[str, list[float]] = field(default_factory=dict)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once (a lambda variable, not a copied expression)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{BLANKS}]+"), "")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def _covered(pairs: Column) -> Column:
    """Positions inside the three-word windows that start at the ends of ``pairs``."""
    def count(at):
        return F.aggregate(
            F.zip_with(at, F.slice(at, F.lit(2), F.size(at)),
                       lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))).cast("long")),
            F.lit(0).cast("long"), lambda n, x: n + x)

    return F.when(F.size(pairs) == 0, F.lit(0).cast("long")).otherwise(
        _let(F.sort_array(F.array_distinct(F.concat(pairs["a"], pairs["b"]))), count))


def _adjacent(ordered: Column, same, position) -> Column:
    """Pairs of positions of neighbours in ``ordered`` that are the same."""
    return F.filter(F.zip_with(ordered, F.slice(ordered, F.lit(2), F.size(ordered)), lambda x, y: F.when(
        same(x, y), F.struct(position(x).alias("a"), position(y).alias("b")))), lambda p: p.isNotNull())


def repeated_words(words: Column) -> Column:
    """Words (positions) inside three-word windows that occur twice or more.

    Equal windows are brought together by sorting 44 bits of their hash with
    the position below them.  The words of each pair are then compared; where a
    hash met a different window, or a text has 2**20 words or more, the windows
    themselves are sorted.  Either way the count is exact.
    """
    low = (1 << 20) - 1

    def exact(w):
        windows = F.slice(F.transform(w, lambda x, i: F.struct(
            F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))),
            F.lit(1), F.size(w) - 2)
        pairs = _let(F.sort_array(windows), lambda s: _adjacent(
            s, lambda x, y: x["t"] == y["t"], lambda x: x["i"]))
        return _let(pairs, _covered)

    def hashed(w):
        keys = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
                                   .bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))), F.lit(1), F.size(w) - 2)
        pairs = _let(F.sort_array(keys), lambda s: _adjacent(
            s, lambda x, y: x.bitwiseXOR(y).between(0, low), lambda x: x.bitwiseAND(F.lit(low)).cast("int")))

        def differs(p):
            a, b = p["a"], p["b"]
            return ((F.get(w, a) != F.get(w, b)) | (F.get(w, a + 1) != F.get(w, b + 1))
                    | (F.get(w, a + 2) != F.get(w, b + 2)))

        return _let(pairs, lambda p: F.when(F.exists(p, differs), exact(w)).otherwise(_covered(p)))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(
        words, lambda w: F.when(F.size(w) < low, hashed(w)).otherwise(exact(w))))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def class_counts(text: Column, word_chars: Column) -> Column:
    """Characters of each class, then white space, then all others."""
    def of(t):
        counts = [F.length(t) - F.length(F.regexp_replace(t, f"[{c}]+", "")) for c in CLASSES]
        return _let(F.array(*counts, F.length(t) - word_chars), lambda n: F.concat(n, F.array(
            F.length(t) - F.aggregate(n, F.lit(0), lambda a, x: a + x))))
    return _let(text, of)


def word_counts(words: Column) -> Column:
    """Occurrences of each common word, then all other words."""
    places = F.array(*[F.lit(c) for c in COMMON_WORDS])

    def of(w):
        found = F.transform(F.filter(w, lambda x: x.isin(*COMMON_WORDS)), lambda x: F.array_position(places, x).cast("int"))
        return _let(found, lambda f: F.array(
            *[F.size(f) - F.size(F.array_remove(f, k + 1)) for k in range(len(COMMON_WORDS))], F.size(w) - F.size(f)))
    return _let(words, of)


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return _let(total, lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def divergence(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon divergence in bits; its square root is the distance.

    A bin that the reference lacks adds half its share, so only the others are spelled out.
    """
    def xlog(x):
        return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))

    terms, covered = F.lit(0.0), F.lit(0.0)
    for k, q in enumerate(reference):
        if q > 0:
            p = F.get(shares, F.lit(k))
            terms = terms + (xlog(p) + q * math.log2(q) - (p + q) * F.log2((p + q) / 2)) / 2
            covered = covered + p
    return F.greatest(F.lit(0.0), terms + (1 - covered) / 2)


def least_divergence(shares: Column, references: list[list[float]]) -> Column:
    """The least ``divergence`` from any of ``references``, an array literal: the plan does not grow with them."""
    known = [[{"k": k, "q": q, "l": q * math.log2(q)} for k, q in enumerate(ref) if q > 0] for ref in references]
    table = F.from_json(F.lit(json.dumps(known)), "array<array<struct<k:int,q:double,l:double>>>")

    def xlog(x):
        return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))

    def add(a, r):
        p, q = F.get(shares, r["k"]), r["q"]
        return F.struct((a["terms"] + (xlog(p) + r["l"] - (p + q) * F.log2((p + q) / 2)) / 2).alias("terms"),
                        (a["covered"] + p).alias("covered"))

    start = F.struct(F.lit(0.0).alias("terms"), F.lit(0.0).alias("covered"))
    return F.array_min(F.transform(table, lambda ref: F.aggregate(
        ref, start, add, lambda a: F.greatest(F.lit(0.0), a["terms"] + (1 - a["covered"]) / 2))))


def features(text: Column, counts: bool = True) -> Column:
    """Struct of ``n_words`` and the shares ``classes`` and ``words``; with ``counts`` the base counts too."""
    def of(t):
        def on(w):
            parts = [F.size(w).cast("long").alias("n_words"), F.length(t).cast("long").alias("chars"),
                     _shares(class_counts(t, word_chars(w))).alias("classes"),
                     _shares(word_counts(w)).alias("words")]
            if counts:
                parts += [
                    word_chars(w).cast("long").alias("word_chars"),
                    (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
                    duplicate_lines(t).alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words")]
            return F.struct(*parts)
        return _let(words_of(t), on)
    return _let(F.coalesce(text, F.lit("")), of)


def fit_references(measured: DataFrame, lang_col: str = "lang", features_col: str = "features") -> References:
    """Medians of the bins' shares over all documents of each language that has one.

    What comes to the driver is one row per language, of all languages.  Texts
    without a word are left out.
    """
    # no filter on the features: it would be pushed below them and compute them twice
    f = F.col(features_col)
    rows = measured.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), _let(f, lambda x: F.when(
        x["n_words"] > 0, F.struct(x["classes"].alias("c"), x["words"].alias("w")))).alias("f"))
    bins = ([F.percentile_approx(F.col("f.c")[k], 0.5, 200).alias(f"c{k}") for k in range(CLASS_BINS)]
            + [F.percentile_approx(F.col("f.w")[k], 0.5, 200).alias(f"w{k}") for k in range(WORD_BINS)])
    found = rows.groupBy("lang").agg(F.count("f").alias("n"), *bins).where("n > 0")

    def shares(r, key, n):
        x = [max(0.0, r[f"{key}{k}"]) for k in range(n)]
        return [v / (sum(x) or 1.0) for v in x]

    out = References()
    for r in found.collect():
        out.classes[r["lang"]] = shares(r, "c", CLASS_BINS)
        out.words[r["lang"]] = shares(r, "w", WORD_BINS)
    return out


def distances(f: Column, references: References) -> tuple[Column, Column]:
    """Distances of a ``features`` struct to the nearest language's references."""
    def nearest(shares, table):
        if not table:
            return F.lit(0.0)
        if len(table) > SPELLED_OUT:
            return F.sqrt(least_divergence(shares, [ref for _, ref in sorted(table.items())]))
        found = [F.sqrt(divergence(shares, ref)) for _, ref in sorted(table.items())]
        return F.least(*found) if len(found) > 1 else found[0]

    return nearest(f["classes"], references.classes), nearest(f["words"], references.words)


def verdict(m: Column, min_words: int = 50, max_repeat: float = 0.5, class_limit: float = 0.16,
            word_limit: float = 0.30, noise: float = 1.5, min_judged_words: int = 100) -> tuple[Column, Column]:
    """(base_failed, kept) of a struct of the base counts and distances.

    ``noise * sqrt(bins / (8 * length))`` is added to each limit for sampling noise.
    """
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > int(100 * max_repeat) * m["n_words"])
    n_words, chars = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["chars"], F.lit(1))
    classes_ok = m["class_distance"] <= class_limit + noise * F.sqrt(CLASS_BINS / (8 * chars))
    words_ok = (m["n_words"] < min_judged_words) | (
        m["word_distance"] <= word_limit + noise * F.sqrt(WORD_BINS / (8 * n_words)))
    return failed, ~failed & classes_ok & words_ok


def judgement(f: Column, references: References, **limits) -> Column:
    """Struct of the base counts, distances, ``base_failed`` and ``kept`` of a ``features`` struct.

    Every part is bound once, so the expression may stand in a filter as well.
    """
    counts = ("n_words", "chars", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    distant = ("class_distance", "word_distance")

    def of(x):
        found = F.struct(*[x[c].alias(c) for c in counts], *[d.alias(n) for d, n in zip(distances(x, references), distant)])

        def on(m):
            failed, kept = verdict(m, **limits)
            return F.struct(*[m[c].alias(c) for c in (*counts, *distant)], failed.alias("base_failed"), kept.alias("kept"))
        return _let(found, on)
    return _let(f, of)


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
          result_col: str = "quality_rules", **limits) -> DataFrame:
    """``docs`` with the struct column of ``judgement``, against references from all of ``docs``.

    Two passes over the texts (shares for the references, then the verdicts)
    and no shuffle of rows.  Null and empty texts: no words, so ``base_failed``.
    Texts of any length are judged whole.  Repeated rows: each its own verdict.
    Empty table: empty.  Without any language only the base rules count.
    """
    references = corpus_references(docs, text_col, lang_col)
    return docs.withColumn(result_col, judgement(features(F.col(text_col)), references, **limits))


def corpus_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> References:
    """``fit_references`` over the texts themselves."""
    return fit_references(docs.select(
        F.col(lang_col).alias("lang"), features(F.col(text_col), counts=False).alias("features")))


def keep_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged."""
    references = corpus_references(docs, text_col, lang_col)
    return docs.where(judgement(features(F.col(text_col)), references, **limits)["kept"])
