"""Path predicates (F15, F16, F23) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixfold.functions.text import col_

# Words that mark a test path, per rule.
TEST_SUBSTRINGS = ("test", "tests", "e2e", "testing")
TEST_WORDS = ("test", "tests", "testing")
TEST_DIRS = ("test", "tests")

# Changed-file suffixes that are not test targets (note "csv" has no dot).
NON_TEST_EXTS = (".json", ".png", "csv", ".txt", ".md", ".jpg", ".jpeg", ".pkl", ".yml",
                 ".yaml", ".toml")


def is_test_path(path, rule: str = "substring") -> Column:
    """F15, four distinct rules:

    * ``substring`` — the path contains one of test/tests/e2e/testing (so
      ``latest.py`` counts);
    * ``word`` — a whole lower-cased word after splitting on space, ``_``,
      ``/`` and ``.`` is test/tests/testing;
    * ``prefix`` — some path segment starts with ``test``;
    * ``dir`` — some directory segment is exactly ``test`` or ``tests``.
    """
    p = col_(path)
    if rule == "substring":
        cond = F.lit(False)
        for w in TEST_SUBSTRINGS:
            cond = cond | p.contains(w)
        return cond
    if rule == "word":
        words = F.split(F.lower(p), r" |_|/|\.", -1)
        return F.arrays_overlap(words, F.array(*[F.lit(w) for w in TEST_WORDS]))
    segs = F.split(p, "/", -1)
    if rule == "prefix":
        return F.exists(segs, lambda s: s.startswith("test"))
    if rule == "dir":
        dirs = F.slice(segs, 1, F.size(segs) - 1)
        return F.exists(dirs, lambda s: s.isin(*TEST_DIRS))
    raise ValueError(f"unknown rule {rule!r}")


def keeps_test_target(path) -> Column:
    """a changed file is a test target unless it ends with a non-test suffix."""
    p = col_(path)
    cond = F.lit(False)
    for ext in NON_TEST_EXTS:
        cond = cond | p.endswith(ext)
    return ~cond


def is_python_source(path, instance_id=None, keep_tests_for: str = "pytest") -> Column:
    """F16: ``.py`` files; test files (prefix rule) are dropped except for
    instances of the repository family whose id starts with ``keep_tests_for``."""
    p = col_(path)
    keep_tests = F.lit(False) if instance_id is None else col_(instance_id).startswith(keep_tests_for)
    return p.endswith(".py") & (keep_tests | ~is_test_path(p, "prefix"))
