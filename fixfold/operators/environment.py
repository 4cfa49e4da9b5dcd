"""Environment requirement files.

Requirement texts are rows ``(key, file, text)``; lines are exploded once and
an include (``-r other.txt``) is resolved with an equi-join on the included
file's name — one level deep, included lines first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixfold.functions.text import strip

# Requirement lines that are dropped (after stripping).
EXCLUDED_PREFIXES = ("-e .", "#", ".[test")

# Yanked packages and their installable replacements.
PACKAGE_REPLACEMENTS = {"types-pkg_resources": "types-pkg-resources==0.1.3"}


def _excluded(line):
    s = strip(line)
    c = F.lit(False)
    for p in EXCLUDED_PREFIXES:
        c = c | s.startswith(p)
    return c


def clean_requirements(reqs: DataFrame, key: str = "instance_id", main: str = "requirements.txt") -> DataFrame:
    """the main requirements file with excluded lines dropped and each
    ``-r file`` line replaced by that file's kept lines; all included lines
    come first (in include order), then the main file's kept lines.
    ``reqs``: (key, file, text).  Returns (key, requirements)."""
    lines = reqs.select(key, "file", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    m = lines.where(F.col("file") == main)
    inc = m.where(strip(F.col("line")).startswith("-r")).select(
        key, F.col("pos").alias("inc_pos"),
        strip(F.substr(strip(F.col("line")), F.lit(3))).alias("file"))
    extra = inc.join(lines.where(~_excluded(F.col("line"))), [key, "file"]).select(
        key, F.struct("inc_pos", "pos", "line").alias("x"))
    own = m.where(~strip(F.col("line")).startswith("-r") & ~_excluded(F.col("line"))).select(
        key, F.struct("pos", "line").alias("x"))
    e = extra.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("e"))
    o = own.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]),
                                          "\n").alias("o"))
    base = reqs.where(F.col("file") == main).select(key).distinct()
    j = base.join(e, key, "left").join(o, key, "left")
    return j.select(key, F.array_join(F.concat(F.coalesce("e", F.array().cast("array<string>")),
                                                F.array(F.coalesce("o", F.lit("")))), "\n").alias("requirements"))


def replace_packages(reqs: DataFrame, text: str = "requirements") -> DataFrame:
    """stripped non-blank requirement lines with known replacements
    applied, newline-joined with a trailing newline."""
    items = F.filter(F.transform(F.split(F.col(text), "\n", -1), lambda l: strip(l)), lambda l: l != "")

    def repl(l):
        out = l
        for a, b in PACKAGE_REPLACEMENTS.items():
            out = F.when(l == a, F.lit(b)).otherwise(out)
        return out

    return reqs.withColumn(text, F.concat(F.array_join(F.transform(items, repl), "\n"), F.lit("\n")))
