"""Unified-diff jobs: explode, classify, split, renumber, minimise.

A patch is one row: one walk numbers its lines by file and hunk, then they are
aggregated per hunk and per file.  Nothing is parsed twice: every diff-based
predicate reads the same hunk/file tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixfold.functions.text import col_

DEV_NULL = "/dev/null"
HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
_HEADER = re.compile(HUNK_HEADER, re.ASCII).match
_LINES_AT_ONCE = 1 << 15


def _scan(patch: str, lenient: bool):
    """(line, file_idx, hunk_idx, kind) of each line, in one walk that carries what the open hunk still has to come."""
    lines = patch.split("\n")
    has_git = any(x.startswith("diff --git ") for x in lines)
    kinds = {"+": "added", "-": "removed", " ": "context"}
    file = hunk = before = after = 0  # lines still to come on either side
    for line, following in zip(lines, [*lines[1:], ""]):
        if has_git:
            starts = line.startswith("diff --git ")
        else:
            starts = line.startswith("--- ") and following.startswith("+++ ") and (lenient or not (before or after))
        first = line[:1]
        if starts:
            file, hunk, before, after = file + 1, 0, 0, 0
        elif line.startswith("@@ "):
            hunk += 1
            m = _HEADER(line)
            before, after = (int(m[2] or 1), int(m[4] or 1)) if m else (0, 0)
            yield line, file, hunk, "hunk"
            continue
        else:
            before -= before > 0 and first not in ("+", "\\")
            after -= after > 0 and first not in ("-", "\\")
        yield line, file, hunk, kinds.get(first, "other") if hunk else "header"


def patch_lines(df: DataFrame, keys, patch: str = "patch", lenient: bool = False) -> DataFrame:
    """X1 (line level): (keys, pos, line, file_idx, hunk_idx, kind).

    ``kind`` is one of: header, hunk, added, removed, context, other.  A file
    starts at ``diff --git``; a patch without such lines starts files at
    ``--- `` followed by ``+++ `` outside of a hunk.  A hunk starts at ``@@``;
    lines before the first hunk of a file are its header.  ``lenient`` is for
    patches whose hunk headers are wrong (X4, X5): the file's two lines open it
    wherever they stand.

    Each patch is walked once in an Arrow batch, in time linear in its lines (a fold in
    column functions copies its output for every line, a window shuffles all
    lines); no shuffle, so groupings combine lines before they send them."""
    keys = list(keys)
    d = df.where(F.col(patch).isNotNull()).select(*keys, F.col(patch).cast("string").alias("_patch"))
    schema = T.StructType([d.schema[k] for k in keys] + [
        T.StructField("pos", T.IntegerType()), T.StructField("line", T.StringType()), T.StructField("file_idx", T.LongType()),
        T.StructField("hunk_idx", T.LongType()), T.StructField("kind", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            found: list[tuple] = []
            for i, text in enumerate(b.column(len(keys))):
                for pos, x in enumerate(_scan(text.as_py(), lenient)):
                    rows.append(i)
                    found.append((pos, *x))
                if len(rows) >= _LINES_AT_ONCE or i + 1 == b.num_rows:
                    at = pa.array(rows, pa.int64())
                    columns = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(k).take(at) for k in range(len(keys))]
                        + [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
                        names=schema.names)
                    rows, found = [], []

    return d.mapInArrow(run, schema)


def patch_hunks(lines: DataFrame, keys) -> DataFrame:
    """X1 (hunk level): header numbers and recounted added/removed/context lines."""
    keys = list(keys)
    h = lines.where((F.col("file_idx") > 0) & (F.col("hunk_idx") > 0))
    hdr = F.when(F.col("kind") == "hunk", F.col("line"))
    agg = h.groupBy(*keys, "file_idx", "hunk_idx").agg(
        F.max(hdr).alias("header"),
        F.count_if(F.col("kind") == "added").alias("added"),
        F.count_if(F.col("kind") == "removed").alias("removed"),
        F.count_if((F.col("kind") == "context")
                   | ((F.col("kind") == "other") & (F.col("line") != ""))).alias("context"),
    )

    def num(i, default=None):
        g = F.regexp_extract(F.col("header"), HUNK_HEADER, i)
        v = F.when(g != "", g.try_cast("long"))
        return F.coalesce(v, F.lit(default)) if default is not None else v

    return agg.select(*keys, "file_idx", "hunk_idx",
                      num(1).alias("src_start"), num(2, 1).alias("src_len"),
                      num(3).alias("tgt_start"), num(4, 1).alias("tgt_len"),
                      "added", "removed", "context")


def _joined(keep: Column) -> Column:
    """The kept lines of a group, in the order of the patch."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "line")))), lambda x: x["line"]), "\n")


def patch_files(lines: DataFrame, keys, text: str | None = None) -> DataFrame:
    """X1 (file level): paths, change kind (added / removed / modified), hunk and
    line counts; ``text`` names a column for the file's part of the patch."""
    keys = list(keys)
    f = lines.where(F.col("file_idx") > 0)
    line = F.col("line")
    hdr = F.col("kind") == "header"
    src = F.max(F.when(hdr & line.startswith("--- "),
                       F.regexp_replace(F.substr(line, F.lit(5)), r"^a/", "")))
    tgt = F.max(F.when(hdr & line.startswith("+++ "),
                       F.regexp_replace(F.substr(line, F.lit(5)), r"^b/", "")))
    git = F.max(F.when(hdr & line.startswith("diff --git "), line))
    agg = f.groupBy(*keys, "file_idx").agg(
        src.alias("source"), tgt.alias("target"), git.alias("git_line"),
        F.bool_or(hdr & line.startswith("new file mode")).alias("new_mode"),
        F.bool_or(hdr & line.startswith("deleted file mode")).alias("deleted_mode"),
        F.max("hunk_idx").alias("n_hunks"),
        F.count_if(F.col("kind") == "added").alias("added"),
        F.count_if(F.col("kind") == "removed").alias("removed"),
        *([_joined(~((F.col("kind") == "other") & (line == ""))).alias(text)] if text else []),
    )
    git_path = F.regexp_extract(F.col("git_line"), r" b/(.*)$", 1)
    path = F.coalesce(F.when(F.col("target") != DEV_NULL, F.col("target")),
                      F.when(F.col("source") != DEV_NULL, F.col("source")),
                      F.when(git_path != "", git_path))
    change = (F.when((F.col("source") == DEV_NULL) | F.col("new_mode"), F.lit("added"))
              .when((F.col("target") == DEV_NULL) | F.col("deleted_mode"), F.lit("removed"))
              .otherwise(F.lit("modified")))
    return agg.select(*keys, "file_idx", path.alias("path"), change.alias("change"),
                      "n_hunks", "added", "removed", *([text] if text else []))


def patch_stats(files: DataFrame, keys) -> DataFrame:
    """Per patch: the counts behind F8, F10, F11 and F12 in one aggregate."""
    keys = list(keys)
    mod = F.col("change") == "modified"
    return files.groupBy(*keys).agg(
        F.bool_or(~mod).alias("has_added_or_removed"),
        F.sum(F.col("added") + F.col("removed")).alias("changed_lines"),
        F.count_if(mod).alias("modified_files"),
        F.sum(F.when(mod, F.col("n_hunks")).otherwise(F.lit(0))).alias("modified_hunks"),
    )


def max_code_lines(stats: DataFrame, n: int = 25) -> Column:
    """at most n added+removed lines."""
    return F.col("changed_lines") <= n


def max_files(n: int = 1) -> Column:
    """at most n modified files (only *modified* files count)."""
    return F.col("modified_files") <= n


def max_hunks(n: int = 3) -> Column:
    """between 1 and n hunks over modified files."""
    return (F.col("modified_hunks") >= 1) & (F.col("modified_hunks") <= n)


def modified_files(patch) -> Column:
    """Paths after ``--- a/`` in order of appearance, distinct."""
    return F.array_distinct(F.regexp_extract_all(col_(patch), F.lit(r"(?dm)^--- a/(.*)$"), 1))


def oracle_files(lines: DataFrame, keys) -> DataFrame:
    """(keys, files) — the distinct source files of a patch (a new file's is
    ``/dev/null``), cut after the first ``a/``, sorted."""
    keys = list(keys)
    src = lines.where((F.col("kind") == "header") & F.col("line").startswith("--- "))
    name = F.regexp_replace(F.substr("line", F.lit(5)), r"^.*?a/", "")
    return src.groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias("files"))


def split_patch(lines: DataFrame, keys) -> DataFrame:
    """Per patch, the text of non-test files (fix part) and of test files
    (test part), each in original order.  A file is a test file when its path
    contains one of the test words (F15 substring rule).  Path and text come from
    one grouping, and a patch's lines are sent once, to the task that joins them."""
    from fixfold.functions.paths import is_test_path

    keys = list(keys)
    files = patch_files(lines.repartition(*keys), keys, text="text").withColumn("is_test", is_test_path(F.col("path"), "substring"))
    part = lambda t: F.array_join(F.transform(
        F.array_sort(F.collect_list(F.when(t, F.struct("file_idx", "text")))),
        lambda x: F.concat(x["text"], F.lit("\n"))), "")
    return files.groupBy(*keys).agg(part(~F.col("is_test")).alias("fix_patch"),
                                    part(F.col("is_test")).alias("test_patch"))


def renumber_hunks(hunks: DataFrame, keys) -> DataFrame:
    """Recounted lengths (context+removed / context+added) and
    ``tgt_start = src_start + Σ (added − removed) of earlier hunks in the file``."""
    keys = list(keys)
    w = Window.partitionBy(*keys, "file_idx").orderBy("hunk_idx") \
        .rowsBetween(Window.unboundedPreceding, -1)
    delta = F.coalesce(F.sum(F.col("added") - F.col("removed")).over(w), F.lit(0))
    return hunks.select(*keys, "file_idx", "hunk_idx", "src_start",
                        (F.col("context") + F.col("removed")).alias("new_src_len"),
                        (F.col("src_start") + delta).alias("new_tgt_start"),
                        (F.col("context") + F.col("added")).alias("new_tgt_len"))


FULL_HUNK = r"^@@\s+-(\d+),(\d+)\s+\+(\d+),(\d+)\s+@@(.*)$"


def _hunk_arrays(lines: DataFrame, keys) -> DataFrame:
    """One row per file header (``hunk_idx`` 0) and hunk, from one grouping.

    Header rows: ``src`` and ``tgt``, the lines ``--- a/`` and ``+++ b/``, and
    ``diff_line`` only when it directly precedes ``--- a/``.  Hunks: the start ``a``, the
    ``rest`` after the header's closing ``@@`` and the ``body`` lines (a trailing empty
    line that ends the patch is not part of the body)."""
    keys = list(keys)
    w = Window.partitionBy(*keys)
    line, hdr = F.col("line"), F.col("kind") == "header"
    l = lines.withColumn("_last", F.max("pos").over(w)).withColumn("_next", F.lead("line", 1, "").over(w.orderBy("pos")))
    in_body = (F.col("file_idx") > 0) & (F.col("hunk_idx") > 0) & (F.col("kind") != "hunk") \
        & ~((F.col("pos") == F.col("_last")) & (line == ""))
    g = l.groupBy(*keys, "file_idx", "hunk_idx").agg(
        F.max(F.when(F.col("kind") == "hunk", line)).alias("head"),
        F.transform(F.array_sort(F.collect_list(F.when(in_body, F.struct("pos", "line")))), lambda x: x["line"]).alias("body"),
        F.max(F.when(hdr & line.startswith("--- a/"), line)).alias("src"),
        F.max(F.when(hdr & line.startswith("+++ b/"), line)).alias("tgt"),
        F.max(F.when(hdr & line.startswith("diff") & F.col("_next").startswith("--- a/"), line)).alias("diff_line"))
    a = F.when(F.col("file_idx") > 0, F.regexp_extract("head", FULL_HUNK, 1).try_cast("long"))
    return g.select("*", a.alias("a"), F.regexp_extract("head", FULL_HUNK, 5).alias("rest"))


def _file_texts(hunks: DataFrame, keys, hunk_text: Column, end: str) -> DataFrame:
    """Files with both header lines, and the texts of their full hunks in order, ended by ``end``."""
    texts = F.when(F.col("a").isNotNull(), F.struct("hunk_idx", hunk_text.alias("t")))
    g = hunks.groupBy(*keys, "file_idx").agg(
        F.max("src").alias("src"), F.max("tgt").alias("tgt"), F.max("diff_line").alias("diff_line"),
        F.transform(F.array_sort(F.collect_list(texts)), lambda x: x["t"]).alias("_h"))
    # a file without hunks has none, not an empty text
    return g.where(F.col("src").isNotNull() & F.col("tgt").isNotNull()).withColumn(
        "hunks", F.when(F.size("_h") > 0, F.array_join("_h", end)))


def _counts(ls):
    """(context, added, removed) of hunk lines: ± by first character, the rest context."""
    sub = F.size(F.filter(ls, lambda x: x.startswith("-")))
    add = F.size(F.filter(ls, lambda x: x.startswith("+")))
    return F.size(ls) - sub - add, add, sub


def repair_patch(lines: DataFrame, keys) -> DataFrame:
    """Keep each file's headers (the ``diff`` line only when it directly
    precedes ``--- a/``), drop other header junk and files without ``--- a/``,
    rewrite every full hunk header with recounted lengths and
    ``post_start = pre_start + Σ earlier deltas`` in the file (X3).
    (keys, repaired)."""
    keys = list(keys)
    h = _hunk_arrays(lines, keys)
    # counted on the body as text without its outer newlines (blank lines between files are no context)
    ctx, add, sub = _counts(F.split(F.regexp_replace(F.array_join("body", "\n"), r"^\n+|\n+$", ""), "\n", -1))
    h = h.withColumn("pre_len", ctx + sub).withColumn("post_len", ctx + add)
    wf = Window.partitionBy(*keys, "file_idx").orderBy("hunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("post", F.col("a") + F.coalesce(F.sum(F.when(F.col("a").isNotNull(), F.col("post_len") - F.col("pre_len"))).over(wf), F.lit(0)))
    htext = F.array_join(F.concat(F.array(F.concat(
        F.lit("@@ -"), F.col("a").cast("string"), F.lit(","), F.col("pre_len").cast("string"), F.lit(" +"),
        F.col("post").cast("string"), F.lit(","), F.col("post_len").cast("string"), F.lit(" @@"), F.col("rest"))),
        F.col("body")), "\n")
    ftext = _file_texts(h, keys, htext, "\n").select(
        *keys, "file_idx", F.concat_ws("\n", "diff_line", "src", "tgt", "hunks").alias("t"))
    return ftext.groupBy(*keys).agg(F.concat(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("file_idx", "t"))), lambda x: x["t"]), "\n"), F.lit("\n")).alias("repaired"))


def minimal_patch(lines: DataFrame, keys) -> DataFrame:
    """Per hunk keep the lines from the first changed line to one line past
    the last changed line (trailing whitespace removed), move ``pre_start`` past
    the dropped leading context, recount and renumber (X3).  Files are emitted
    as their ``--- a/`` / ``+++ b/`` headers followed by the hunks.
    (keys, minimal)."""
    from fixfold.functions.text import PY_WS

    keys = list(keys)
    h = _hunk_arrays(lines, keys)
    seq = F.concat(F.array(F.col("rest")), F.col("body"), F.array(F.lit("")))
    n = F.size(seq)
    pm = lambda arr: F.transform(arr, lambda x: x.startswith("+") | x.startswith("-"))
    p_first = F.array_position(pm(seq), True)
    p_last_rev = F.array_position(pm(F.reverse(seq)), True)
    first_idx = F.when(p_first > 0, p_first - 1).otherwise(n)
    end = F.when(p_last_rev > 0, n - (p_last_rev - 1) + 1).otherwise(F.lit(1))
    length = F.greatest(F.least(end, n) - first_idx, F.lit(0))
    kept = F.transform(F.slice(seq, first_idx + 1, length), lambda x: F.regexp_replace(x, f"{PY_WS}+$", ""))
    h = h.withColumn("kept", F.when(first_idx < n, kept).otherwise(F.array().cast("array<string>")))
    h = h.withColumn("pre", F.col("a") + first_idx - 1)
    # counting view: the kept lines as text with outer newlines stripped, split again
    stripped = F.regexp_replace(F.array_join("kept", "\n"), r"^\n+|\n+$", "")
    cl = F.split(stripped, "\n", -1)
    ctx, add, sub = _counts(cl)
    h = h.withColumn("pre_len", ctx + sub).withColumn("post_len", ctx + add)
    wf = Window.partitionBy(*keys, "file_idx").orderBy("hunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("post", F.col("pre") + F.coalesce(F.sum(F.when(F.col("a").isNotNull(), F.col("post_len") - F.col("pre_len"))).over(wf), F.lit(0)))
    htext = F.concat(F.lit("@@ -"), F.col("pre").cast("string"), F.lit(","), F.col("pre_len").cast("string"),
                     F.lit(" +"), F.col("post").cast("string"), F.lit(","), F.col("post_len").cast("string"),
                     F.lit(" @@\n"), F.array_join("kept", "\n"), F.lit("\n"))
    ftext = _file_texts(h, keys, htext, "").select(
        *keys, "file_idx", F.concat(F.col("src"), F.lit("\n"), F.col("tgt"), F.lit("\n"),
                                    F.coalesce("hunks", F.lit(""))).alias("t"))
    return ftext.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("file_idx", "t"))), lambda x: x["t"]), "").alias("minimal"))
