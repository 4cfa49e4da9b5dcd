"""Named extension points (U1–U5): document encoders, prompt templates,
tokenizers, log-parser rules per repository and named filter predicates.
Each is plain data or a function table; adding an entry needs no change to
the operators that look names up here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixfold.functions import criteria as C
from fixfold.functions import logs as L
from fixfold.functions.prompts import TEMPLATES

# Document encoders (DataFrame of files → DataFrame with ``contents``).
ENCODERS = {
    "file_name_and_contents": lambda files: _encode(files, "file_name_and_contents"),
    "file_name_and_docstrings": lambda files: _encode(files, "docstrings"),
}


def _encode(files: DataFrame, style: str) -> DataFrame:
    from fixfold.operators.code import encode_documents

    return encode_documents(files, style)


# Prompt templates (data, not code).
PROMPT_TEMPLATES = TEMPLATES

# Tokenizers: name → (text Column → array<int> Column).
TOKENIZERS = {}


def register_tokenizer(name: str, fn=None, column_fn=None) -> None:
    """Register a tokenizer: either a JVM-side column function or a Python
    ``str -> list[int]`` callable (wrapped as an Arrow pandas UDF)."""
    if column_fn is None:
        from fixfold.operators.context import pandas_tokenizer

        udf = pandas_tokenizer(fn)
        column_fn = lambda c: udf(c)
    TOKENIZERS[name] = column_fn


def _words(c: Column) -> Column:
    from fixfold.operators.context import token_ids

    return token_ids(c)


TOKENIZERS["words"] = _words

# U4: log parser rule per repository.
LOG_RULES = dict(L.REPO_RULES)


def register_repo_rule(repo: str, rule: str) -> None:
    if rule not in {"pytest", "options", "rewrite", "ansi", "mixed", "framed", "verbose"}:
        raise ValueError(f"unknown rule {rule!r}")
    LOG_RULES[repo] = rule


def rules_frame(spark) -> DataFrame:
    """The current repository → rule table (small literal data: broadcastable)."""
    return spark.createDataFrame(sorted(LOG_RULES.items()), "repo string, rule string")


# Named row predicates for filter cascades (each a Column over instance columns).
PREDICATES = {
    "statement_long_enough": lambda: ~C.max_words(F.col("problem_statement"), 40),
    "statement_without_links": lambda: ~C.contains_hyperlink(F.col("problem_statement"), F.col("repo")),
    "statement_without_commit_hash": lambda: ~C.contains_commit_hash(F.col("problem_statement")),
    "statement_without_images": lambda: ~C.contains_image(F.col("problem_statement")),
    "test_patch_without_match_arg": lambda: ~C.contains_match_arg(F.col("test_patch")),
    "has_tests": lambda: C.has_tests(),
    "valid_instance": lambda: C.valid_instance(),
}


def with_predicates(df: DataFrame, names: list[str]) -> DataFrame:
    """Add one boolean column per named predicate (for ``curate.cascade_counts``)."""
    return df.select("*", *[PREDICATES[n]().alias(n) for n in names])
