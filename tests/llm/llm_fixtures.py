"""Small tables that hold the awkward cases: nulls, empty and long texts, repeats, clashing names."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    # names that operators use inside
    *[T.StructField(n, T.StringType()) for n in (
        "id", "score", "kept", "features", "label", "key", "rep", "component", "start", "verdict", "measured", "rank",
        "redacted", "toxicity", "block", "n", "x", "spans")]])
EXTRA = ["extra"] * (len(SCHEMA) - 3)
WORDS = "the of and to in is that it was on are by this be or from an a house tree river stone cloud light music paper".split()
GERMAN = "der die das und ist nicht mit von zu den ein eine für auf im haus baum fluss stein wolke licht musik papier".split()


def prose(seed, n, words=WORDS):
    r = random.Random(seed)
    out = []
    for k in range(n):
        w = r.choice(words)
        out.append(w.capitalize() + ("." if k % 9 == 8 else "") if k % 9 in (0, 8) else w)
    return " ".join(out)


def edge_rows():
    """Every awkward row: the same ones for all operators."""
    long_text = prose(1, 60_000)
    return [
        (1, None, "en", *EXTRA), (2, "", "en", *EXTRA), (3, " \n\t ", None, *EXTRA), (None, prose(2, 120), "en", *EXTRA),
        (None, None, None, *EXTRA), (5, prose(3, 80), "en", *EXTRA), (5, prose(3, 80), "en", *EXTRA),
        (6, long_text, "en", *EXTRA), (7, "word", "de", *EXTRA), (8, "é漢🙂 \x00 ½", "fr", *EXTRA),
        (9, "x" * 50_000, "en", *EXTRA), (10, prose(4, 70, GERMAN), "de", *EXTRA)]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def frame(spark, rows):
    """Documents (doc_id, text, lang) with the clashing columns."""
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
