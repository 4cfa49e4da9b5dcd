"""Prompt text from retrieved files.

Per-instance work is bounded by the instance's own k hits: greedy packing is
an ``aggregate`` fold over the ranked hit array of one row (a running sum is
wrong — a skipped file adds nothing and later smaller files may still fit),
and bundles gather only the files that row keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixfold.functions.criteria import WORD
from fixfold.functions.prompts import TEMPLATES
from fixfold.functions.text import col_


def add_line_numbers(text) -> Column:
    """``"{n} {line}"`` for every line, numbered from 1."""
    return F.array_join(F.transform(F.split(col_(text), "\n", -1),
                                    lambda l, i: F.concat((i + 1).cast("string"), F.lit(" "), l)), "\n")


def file_block(path, contents, numbered: bool = True) -> Column:
    """One ``[start of f] … [end of f]`` block."""
    body = add_line_numbers(contents) if numbered else col_(contents)
    return F.concat(F.lit("[start of "), col_(path), F.lit("]\n"), body, F.lit("\n[end of "), col_(path),
                    F.lit("]\n"))


def strip_newlines(c) -> Column:
    return F.regexp_replace(col_(c), r"^\n+|\n+$", "")


def code_bundle(files: DataFrame, key: str = "qid", path: str = "docid", contents: str = "contents",
                numbered: bool = True, name: str = "code_text") -> DataFrame:
    """Per key, its files sorted by path, each wrapped in start/end
    markers, outer newlines stripped."""
    blocks = files.select(key, F.struct(F.col(path).alias("p"),
                                        file_block(F.col(path), F.col(contents), numbered).alias("b")).alias("x"))
    return blocks.groupBy(key).agg(strip_newlines(F.array_join(F.transform(
        F.array_sort(F.collect_list("x")), lambda x: x["b"]), "")).alias(name))


def token_ids(text) -> Column:
    """P22 default tokenizer: word tokens, each mapped to a stable integer id
    (the first 24 bits of its md5) — JVM-side and reproducible anywhere."""
    words = F.regexp_extract_all(col_(text), F.lit(f"{WORD}+"), 0)
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int"))


def token_count(text) -> Column:
    return F.size(F.regexp_extract_all(col_(text), F.lit(f"{WORD}+"), 0))


def pandas_tokenizer(fn, return_type: str = "array<int>"):
    """P22 pluggable form: wrap any ``str -> list[int]`` tokenizer as an Arrow
    ``pandas_udf``; the tokenizer object is created once per Python worker."""
    import pandas as pd

    def _tok(s):
        return s.map(lambda t: None if t is None else list(fn(t)))

    # real (not postponed) annotations: they select the Series → Series form
    _tok.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(_tok, return_type)


def pick_readmes(files: DataFrame, group: str = "corpus", path: str = "docid",
                 shortest: bool = True) -> DataFrame:
    """Files whose base name starts with ``readme`` (any case); with
    ``shortest`` only the one with the shortest name per group (ties: path)."""
    base = F.element_at(F.split(F.col(path), "/", -1), -1)
    r = files.where(F.lower(base).startswith("readme"))
    if not shortest:
        return r
    best = r.groupBy(group).agg(F.min_by(F.col(path), F.struct(F.length(base), F.col(path))).alias(path))
    return r.join(best, [group, path], "left_semi")


def pack_context(hits: DataFrame, sizes: DataFrame, base: DataFrame, budget: int,
                 key: str = "qid") -> DataFrame:
    """Walk each instance's hits in rank order and keep a file when the
    running total plus its size stays *below* the budget; otherwise skip it and
    go on.  ``sizes`` ([corpus,] docid, size) per file (a path occurs in many corpora), ``base`` (key, base) per instance.
    Returns (key, files array<string> in rank order, total)."""
    same = [c for c in ("corpus", key, "docid") if c in hits.columns and c in sizes.columns]
    h = hits.join(sizes, same).select(
        key, F.struct("rank", "docid", "size").alias("x"))
    arr = h.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    j = base.join(arr, key, "left").withColumn("xs", F.coalesce("xs", F.array().cast(arr.schema["xs"].dataType)))
    init = F.struct(F.col("base").cast("long").alias("total"), F.array().cast("array<string>").alias("keep"))
    folded = F.aggregate(
        F.col("xs"), init,
        lambda acc, x: F.when(acc["total"] + x["size"] < budget,
                              F.struct((acc["total"] + x["size"]).alias("total"),
                                       F.array_append(acc["keep"], x["docid"]).alias("keep")))
        .otherwise(acc))
    return j.select(key, folded["keep"].alias("files"), folded["total"].alias("total"))


def render_prompt(df: DataFrame, template: str) -> Column:
    """The template's parts joined by newlines (column parts read from df)."""
    parts = [F.coalesce(F.col(p[1]), F.lit("")) if isinstance(p, tuple) else F.lit(p)
             for p in TEMPLATES[template]]
    return F.concat_ws("\n", *parts)


def training_labels(x, y) -> list[Column]:
    """P21 train form: ``ids = x + y[:-1]``, ``labels = [-100]*(len(x)-1) + y``."""
    xs, ys = col_(x), col_(y)
    ids = F.concat(xs, F.slice(ys, 1, F.greatest(F.size(ys) - 1, F.lit(0))))
    labels = F.concat(F.array_repeat(F.lit(-100), F.greatest(F.size(xs) - 1, F.lit(0))), ys)
    return [ids.alias("input_ids"), labels.alias("labels")]


def eval_labels(x, y) -> list[Column]:
    """P21 test form: inputs and labels unshifted."""
    return [col_(x).alias("input_ids"), col_(y).alias("labels")]


def edit_excerpt(files: DataFrame, hunks: DataFrame, key: str = "instance_id", path: str = "path",
                 contents: str = "contents", context_lines: int = 15) -> DataFrame:
    """An edits-only code view.  For every hunk of a file: its numbered
    source lines with ``context_lines`` of context on both sides (clamped to the
    file), ``...`` marking skipped text before and after; blocks of one file in
    hunk order inside ``[start of f] … [end of f]``; files in path order.
    ``hunks``: (key, path, hunk_idx, src_start, src_len)."""
    numbered = files.select(key, path, F.split(add_line_numbers(F.col(contents)), "\n", -1).alias("nl"))
    j = hunks.join(numbered, [key, path])
    n = F.size("nl")
    start = F.greatest(F.col("src_start") - 1 - context_lines, F.lit(0))
    end = F.least(F.col("src_start") - 1 + F.col("src_len") + context_lines, n)
    block = F.concat(F.when(start > 0, F.lit("...\n")).otherwise(F.lit("")),
                     F.array_join(F.slice("nl", start + 1, F.greatest(end - start, F.lit(0))), "\n"), F.lit("\n"),
                     F.when(end < n, F.lit("...\n")).otherwise(F.lit("")))
    per_file = j.groupBy(key, path).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("hunk_idx", block.alias("b")))), lambda x: x["b"]), "").alias("body"))
    ftext = F.concat(F.lit("[start of "), F.col(path), F.lit("]\n"), strip_newlines(F.col("body")),
                     F.lit("\n[end of "), F.col(path), F.lit("]\n"))
    return per_file.groupBy(key).agg(strip_newlines(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), ftext.alias("t")))), lambda x: x["t"]), ""))
        .alias("code_text"))
