"""Locate → excerpt → edit.

Model answers are parsed with column functions; locations become line spans
through equi-joins with a symbols table (and, for variables, the file's own
lines); span bookkeeping runs as windows partitioned by one instance's
locations or one file's spans — groups bounded by a single answer, never by
the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fixfold.functions.text import col_, strip

KINDS = ("function", "variable", "class", "method")


def fenced_list(text, sep: str = "\n") -> Column:
    """The first fenced block's items, split on ``sep``, empties dropped."""
    block = F.try_element_at(F.split(col_(text), "```", -1), F.lit(2))
    return F.filter(F.split(block, sep, -1), lambda x: x != "")


def top_files(arr, k: int = 5) -> Column:
    """L3: order-stable first k."""
    return F.slice(col_(arr), 1, k)


def parse_locations(answers: DataFrame, key: str = "instance_id", text: str = "answer") -> DataFrame:
    """(key, loc_pos, file, content) from a located-symbols answer: the
    first fenced block split on blank lines; a block's first line names the
    file (``#`` removed), the rest is its content."""
    blocks = answers.select(key, F.posexplode(fenced_list(F.col(text), "\n\n")).alias("loc_pos", "b"))
    lines = F.split(strip(F.col("b")), "\n", -1)
    return blocks.select(key, "loc_pos",
                         strip(F.replace(F.try_element_at(lines, F.lit(1)), F.lit("#"), F.lit(""))).alias("file"),
                         F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
                         .alias("content"))


def location_lines(locs: DataFrame, key: str = "instance_id") -> DataFrame:
    """Classify each content line: (key, loc_pos, file, line_pos, kind, name, cls).

    ``class:`` followed by ``method:`` lines only sets the class for them; a
    ``class:`` line not followed by a method line asks for the class itself."""
    ls = locs.where(F.col("file").endswith(".py")).select(
        key, "loc_pos", "file", F.posexplode(F.split("content", "\n", -1)).alias("line_pos", "line"))
    w = Window.partitionBy(key, "loc_pos").orderBy("line_pos")
    nxt = F.lead("line").over(w)
    line = F.col("line")

    def after(word):
        return strip(F.replace(line, F.lit(word + ":"), F.lit("")))

    kind = (F.when(line.startswith("function:"), F.lit("function"))
            .when(line.startswith("variable:"), F.lit("variable"))
            .when(line.startswith("class:") & (nxt.isNull() | ~F.coalesce(nxt, F.lit("")).startswith("method")),
                  F.lit("class"))
            .when(line.startswith("method:"), F.lit("method"))
            .when(line.startswith("class:"), F.lit("class_context")))
    name = (F.when(line.startswith("function:"), after("function"))
            .when(line.startswith("variable:"), after("variable"))
            .when(line.startswith("class:"), after("class"))
            .when(line.startswith("method:"), after("method")))
    ls = ls.select(key, "loc_pos", "file", "line_pos", kind.alias("kind"), name.alias("name"))
    wc = w.rowsBetween(Window.unboundedPreceding, 0)
    ls = ls.withColumn("cls", F.last(F.when(F.col("kind") == "class_context", F.col("name")), ignorenulls=True)
                       .over(wc))
    return ls.where(F.col("kind").isin(*KINDS))


def resolve_locations(lines: DataFrame, symbols: DataFrame, file_lines: DataFrame,
                      key: str = "instance_id") -> DataFrame:
    """Spans (key, loc_pos, file, line_pos, sub, start, end):
    function/class by name, method by (class, name), variable = each file line
    containing ``name=`` or ``name =`` → that line and the two after it.

    Variables meet postings of the lines: what stands before each ``=`` of a line is
    posted by its last one, two and three characters, a variable looks up its own
    last ones.  So it meets the lines that assign to a name of this ending, never all of its file."""
    sym = symbols.select(key, F.col("path").alias("file"), "kind", "cls", "name", "start", "end")
    named = lines.where(F.col("kind").isin("function", "class"))
    a = named.join(sym.drop("cls"), [key, "file", "kind", "name"]).select(
        key, "loc_pos", "file", "line_pos", F.col("start").alias("sub"), "start", "end")
    meth = lines.where(F.col("kind") == "method")
    b = meth.join(sym.where(F.col("kind") == "method").drop("kind"), [key, "file", "cls", "name"]).select(
        key, "loc_pos", "file", "line_pos", F.col("start").alias("sub"), "start", "end")
    var = lines.where(F.col("kind") == "variable")
    tails = F.array_distinct(F.concat(*[F.regexp_extract_all(F.col("text"), F.lit(f"(?s)(?=(.{{{n}}}) ?=)"), 1) for n in (1, 2, 3)]))
    posted = file_lines.select(key, F.col("path").alias("file"), "line_no", "text").where(F.contains("text", F.lit("="))) \
        .select("*", F.explode(tails).alias("tail"))
    c = var.withColumn("tail", F.substr("name", F.greatest(F.length("name") - 2, F.lit(1)))).join(posted, [key, "file", "tail"]).where(
        F.col("text").contains(F.concat(F.col("name"), F.lit("="))) |
        F.col("text").contains(F.concat(F.col("name"), F.lit(" =")))).select(
        key, "loc_pos", "file", "line_pos", F.col("line_no").alias("sub"),
        F.col("line_no").alias("start"), (F.col("line_no") + 2).alias("end"))
    return a.unionByName(b).unionByName(c)


def kept_locations(spans: DataFrame, locs: DataFrame, n: int = 5, key: str = "instance_id") -> DataFrame:
    """Locations are taken in order and the walk stops right after the
    location that makes more than ``n`` productive ones (productive = produced
    a span); only ``.py`` locations take part.  Returns the kept (key, loc_pos)."""
    prod = spans.select(key, "loc_pos").distinct().withColumn("p", F.lit(1))
    lp = locs.where(F.col("file").endswith(".py")).select(key, "loc_pos").distinct() \
        .join(prod, [key, "loc_pos"], "left")
    w = Window.partitionBy(key).orderBy("loc_pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.coalesce("p", F.lit(0))).over(w), F.lit(0))
    return lp.withColumn("before", before).where(F.col("before") <= n).select(key, "loc_pos")


def drop_contained(spans: DataFrame, key: str = "instance_id") -> DataFrame:
    """Per file, spans in start order (ties: original order); a span inside
    an earlier kept span is dropped.  Exact as a running max: a span is dropped
    iff some earlier span ends at or after its end."""
    w = Window.partitionBy(key, "file").orderBy("start", "loc_pos", "line_pos", "sub") \
        .rowsBetween(Window.unboundedPreceding, -1)
    prev_end = F.max("end").over(w)
    return spans.withColumn("_pe", prev_end).where(F.col("_pe").isNull() | (F.col("end") > F.col("_pe"))) \
        .drop("_pe")


def span_text(spans: DataFrame, locs: DataFrame, file_lines: DataFrame, key: str = "instance_id") -> DataFrame:
    """Per instance, for each located ``.py`` file (order of first mention)
    a ``#file`` heading and the text of each kept span (start order), joined
    the way the repair prompt expects."""
    files = locs.where(F.col("file").endswith(".py")).groupBy(key, "file").agg(F.min("loc_pos").alias("first"))
    fl = file_lines.select(key, F.col("path").alias("file"), "line_no", "text")
    # each span becomes its own line numbers, so the join is an equi-join whose
    # output is exactly the printed lines (no span × whole-file pairs)
    each = spans.select("*", F.explode(F.sequence("start", "end")).alias("line_no"))
    sl = each.join(fl, [key, "file", "line_no"])
    chunk = sl.groupBy(key, "file", "start", "loc_pos", "line_pos", "sub").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]),
                     "\n").alias("t"))
    per_file = chunk.groupBy(key, "file").agg(F.array_sort(F.collect_list(
        F.struct("start", "loc_pos", "line_pos", "sub", "t"))).alias("chunks"))
    body = files.join(per_file, [key, "file"], "left").select(
        key, "file", "first",
        F.concat(F.lit("\n#"), F.col("file"),
                 F.coalesce(F.array_join(F.transform("chunks", lambda c: F.concat(
                     F.lit("\n\n\n"), c["t"])), ""), F.lit(""))).alias("part"))
    return body.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "part"))),
                                                          lambda x: x["part"]), "\n").alias("code_content"))


def with_content(paths: DataFrame, files: DataFrame, key: str = "instance_id") -> DataFrame:
    """File contents for the requested paths (inner equi-join)."""
    return paths.join(files, [key, "path"])


EDIT_SPLIT = ">>>>>>> REPLACE"


def parse_edits(answers: DataFrame, files: DataFrame, key: str = "instance_id", attempt: str = "attempt",
                text: str = "answer") -> DataFrame:
    """search/replace blocks of an answer → (key, attempt, edit_pos, file,
    original, modified).  Blocks: split on the python fence, cut at the closing
    fence, split on the replace marker, stripped, empties dropped; line 1 names
    the file (``#`` removed), line 2 is skipped, the rest must hold exactly one
    ``=======``.  Blank searches and unknown files are dropped."""
    comps = F.split(F.col(text), "```python", -1)
    parts = F.flatten(F.transform(comps, lambda c: F.split(F.substring_index(c, "```", 1), EDIT_SPLIT, -1)))
    parts = F.filter(F.transform(parts, lambda r: strip(r)), lambda r: r != "")
    ex = answers.select(key, attempt, F.posexplode(parts).alias("edit_pos", "r"))
    lines = F.split("r", "\n", -1)
    rest = F.array_join(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    ex = ex.select(key, attempt, "edit_pos",
                   strip(F.replace(F.try_element_at(lines, F.lit(1)), F.lit("#"), F.lit(""))).alias("file"),
                   F.split(rest, "=======", -1).alias("comp"))
    ok = ex.where(F.size("comp") == 2).select(
        key, attempt, "edit_pos", "file", F.col("comp")[0].alias("original"), F.col("comp")[1].alias("modified"))
    ok = ok.where(strip(F.col("original")) != "")
    return ok.join(files.select(key, F.col("path").alias("file")).distinct(), [key, "file"], "left_semi")


def apply_edits(edits: DataFrame, files: DataFrame, key: str = "instance_id",
                attempt: str = "attempt") -> DataFrame:
    """X6 (text part): per (key, attempt, file) fold the edits in order over the
    file text — every occurrence of the stripped search text replaced by the
    stripped replacement.  (key, attempt, file, old, new)."""
    grouped = edits.groupBy(key, attempt, "file").agg(F.array_sort(F.collect_list(
        F.struct("edit_pos", strip(F.col("original")).alias("o"), strip(F.col("modified")).alias("m")))).alias("es"))
    j = grouped.join(files.select(key, F.col("path").alias("file"), F.col("text").alias("old")), [key, "file"])
    new = F.aggregate("es", F.col("old"), lambda t, e: F.replace(t, e["o"], e["m"]))
    return j.select(key, attempt, "file", "old", new.alias("new"))


def edit_diff(applied: DataFrame, key: str = "instance_id", attempt: str = "attempt") -> DataFrame:
    """X6 (diff part): unified diff of old vs new per file (Python ``difflib``, a
    row at a time on Arrow batches; unchanged files are not sent), joined per
    (key, attempt) in file order, then the first attempt whose diff is non-empty
    wins per key."""
    import difflib

    import pandas as pd

    def diff(old: str, new: str, f: str) -> str:
        body = difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{f}", f"b/{f}")
        # a last line without a line feed is marked, or the next line would run into it
        body = [x if x.endswith("\n") else x + "\n\\ No newline at end of file\n" for x in body]
        return f"diff --git a/{f} b/{f}\n" + "".join(body)

    def run(batches):
        for pdf in batches:
            parts = [diff(o or "", n or "", f) for o, n, f in zip(pdf.pop("old"), pdf.pop("new"), pdf["file"])]
            yield pdf.assign(part=pd.Series(parts, index=pdf.index, dtype=object))

    changed = applied.select(key, attempt, "file", "old", "new").where(~F.col("old").eqNullSafe(F.col("new")))
    schema = StructType([*(StructField(c, applied.schema[c].dataType) for c in (key, attempt, "file")),
                         StructField("part", StringType())])
    d = changed.mapInPandas(run, schema).groupBy(key, attempt).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("file", "part"))), lambda x: x["part"]), "").alias("model_patch"))
    return d.groupBy(key).agg(F.min_by("model_patch", attempt).alias("model_patch"), F.min(attempt).alias(attempt))
