"""Column functions of the evaluation harness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from fixfold.functions.paths import NON_TEST_EXTS
from fixfold.functions.text import col_

# Repository whose test targets are rewritten to dotted module names.
MODULE_STYLE_REPO = "django/django"

# Truthy / falsy words.
TRUE_WORDS = ("yes", "true", "t", "y", "1")
FALSE_WORDS = ("no", "false", "f", "n", "0")


def test_directives(test_patch, repo) -> Column:
    """P10: changed files after ``diff --git a/.. b/`` minus non-test suffixes; for
    the module-style repository ``tests/x/y.py`` becomes ``x.y``."""
    files = F.regexp_extract_all(col_(test_patch), F.lit(r"(?d)diff --git a/.* b/(.*)"), 1)

    def keep(d):
        c = F.lit(True)
        for e in NON_TEST_EXTS:
            c = c & ~d.endswith(e)
        return c

    kept = F.filter(files, keep)
    dotted = F.transform(kept, lambda d: F.replace(
        F.regexp_replace(F.regexp_replace(d, r"\.py$", ""), r"^tests/", ""), F.lit("/"), F.lit(".")))
    return F.when(col_(repo) == MODULE_STYLE_REPO, dotted).otherwise(kept)


def json_list(col, of: DataFrame | None = None) -> Column:
    """A JSON-encoded list of strings (or NULL) as ``array<string>``; with
    ``of`` (the frame the column is in) a column that holds lists is taken as it is."""
    c = col_(col)
    if of is not None and isinstance(of.select(c).schema[0].dataType, ArrayType):
        return c.cast("array<string>")
    return F.from_json(c, "array<string>")


def fingerprint(col, n: int = 22) -> Column:
    """P25: the first n hex digits of sha256."""
    return F.substring(F.sha2(col_(col), 256), 1, n)


def to_bool(col) -> Column:
    """Truthy / falsy words (any case) → boolean; anything else is an error."""
    v = F.lower(col_(col))
    return (F.when(v.isin(*TRUE_WORDS), F.lit(True))
            .when(v.isin(*FALSE_WORDS), F.lit(False))
            .otherwise(F.raise_error(F.concat(F.lit("Boolean value expected: "), col_(col)))))


def rename_env(col, name) -> Column:
    """Replace every line starting with ``name:`` by ``name: <name>``."""
    return F.regexp_replace(col_(col), r"(?dm)^name:.*$", F.concat(F.lit("name: "), col_(name)))


def effective_commit(setup="environment_setup_commit", base="base_commit") -> Column:
    """The environment setup commit when present, else the base commit."""
    return F.coalesce(col_(setup), col_(base))


def import_error_log(content) -> Column:
    """some line mentions attribute/import and error/fail (case-insensitive)."""
    lines = F.split(F.lower(col_(content)), "\n", -1)
    return F.exists(lines, lambda line: (line.contains("attribute") | line.contains("import"))
                    & (line.contains("error") | line.contains("fail")))
