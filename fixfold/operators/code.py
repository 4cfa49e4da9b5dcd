"""Source-code jobs.

Python parsing uses the standard-library ``ast`` inside ``mapInPandas`` — one
file per row, Arrow batches per task; everything else (tree listings, graph
closure) is joins, explodes and aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType



def _skeleton(src: str, keep_constant: bool = True) -> str:
    """Skeleton of one file: top-level classes, functions and (optionally)
    single-target assignments; function bodies become ``...``; class docstrings
    are removed.  Unparsable text is returned unchanged."""
    import ast

    try:
        tree = ast.parse(src)
    except (SyntaxError, ValueError):
        return src
    lines = src.split("\n")

    def seg(a, b):  # 1-based inclusive line range
        return lines[a - 1:b]

    def func(node, out):
        first = min([d.lineno for d in node.decorator_list] + [node.lineno])
        body0 = node.body[0].lineno
        head = seg(first, body0 - 1) if body0 > node.lineno else [lines[node.lineno - 1].split(":")[0] + ":"]
        out.extend(head)
        indent = " " * (node.body[0].col_offset if body0 > node.lineno else node.col_offset + 4)
        out.append(indent + "...")

    out: list[str] = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            func(node, out)
        elif isinstance(node, ast.ClassDef):
            first = min([d.lineno for d in node.decorator_list] + [node.lineno])
            body0 = node.body[0].lineno
            out.extend(seg(first, body0 - 1) if body0 > node.lineno else [lines[node.lineno - 1]])
            for st in node.body:
                if isinstance(st, ast.Expr) and isinstance(st.value, ast.Constant) and isinstance(st.value.value, str):
                    continue
                if isinstance(st, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    func(st, out)
                else:
                    out.extend(seg(st.lineno, st.end_lineno))
        elif keep_constant and isinstance(node, ast.Assign):
            out.extend(seg(node.lineno, node.end_lineno))
    return "\n".join(out) + "\n"


def code_skeleton(files: DataFrame, text: str = "text", name: str = "skeleton") -> DataFrame:
    """Add the skeleton of each file's text (``mapInPandas`` + ``ast``)."""
    schema = StructType(files.schema.fields + [StructField(name, StringType())])

    def run(batches):
        for pdf in batches:
            pdf[name] = [None if t is None else _skeleton(t) for t in pdf[text]]
            yield pdf

    return files.mapInPandas(run, schema)


def _docstrings(path: str, src: str) -> str:
    """X8 style 2: the path then the docstrings of the module, classes and
    functions; the whole text when it does not parse."""
    import ast

    try:
        tree = ast.parse(src)
    except (SyntaxError, ValueError):
        return f"{path}\n{src}"
    parts = [path]
    for node in ast.walk(tree):
        if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            d = ast.get_docstring(node)
            if d:
                parts.append(d)
    return "\n".join(parts)


def encode_documents(files: DataFrame, style: str = "file_name_and_contents",
                     path: str = "path", text: str = "text") -> DataFrame:
    """Searchable document text per file: path + contents (JVM-side), or
    path + docstrings (``ast`` in ``mapInPandas``)."""
    if style == "file_name_and_contents":
        return files.withColumn("contents", F.concat_ws("\n", F.col(path), F.col(text)))
    schema = StructType(files.schema.fields + [StructField("contents", StringType())])

    def run(batches):
        for pdf in batches:
            pdf["contents"] = [_docstrings(p, t or "") for p, t in zip(pdf[path], pdf[text])]
            yield pdf

    return files.mapInPandas(run, schema)


def _imports(src: str) -> list[tuple[str, int]]:
    import ast

    try:
        tree = ast.parse(src)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in ast.iter_child_nodes(tree):
        if isinstance(node, ast.Import):
            out.extend((a.name, 0) for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            out.append((node.module, node.level))
    return out


def import_edges(files: DataFrame, key: str = "instance_id", path: str = "path", text: str = "text",
                 part: int = 2000) -> DataFrame:
    """(key, src, dst): a file imports every ``.py`` file of the directory
    its import names (relative imports drop ``level`` trailing components).

    Module names come from ``ast`` in ``mapInPandas``.  A directory matches a
    module when its path ends with the module's components; every directory is
    exploded into its component suffixes (as many as its depth) so matching is
    an equi-join, and the first matching directory in path order is used.  The edges
    are as many as importers times files of a directory; they are made in parts
    (``_all_pairs``) from distinct rows, so they need no shuffle of their own."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for k, p, t in zip(pdf[key], pdf[path], pdf[text]):
                for mod, level in _imports(t or ""):
                    comps = mod.split(".")
                    if level > 0:
                        comps = comps[:-level] if level < len(comps) else []
                    if comps:
                        rows.append((k, p, "/".join(comps)))
            yield pd.DataFrame(rows, columns=[key, "src", "suffix"])

    key_type = files.schema[key].dataType.simpleString()
    mods = files.select(key, path, text).mapInPandas(run, f"{key} {key_type}, src string, suffix string")
    py = files.where(F.col(path).endswith(".py")).select(
        key, F.col(path).alias("dst"), F.regexp_replace(F.col(path), r"/?[^/]*$", "").alias("dir"))
    dirs = py.select(key, "dir").distinct()
    comps = F.split(F.col("dir"), "/", -1)
    suffixes = dirs.where(F.col("dir") != "").select(
        key, "dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(comps)),
                                          lambda i: F.array_join(F.slice(comps, i, F.size(comps)), "/")))
        .alias("suffix"))
    first = mods.distinct().join(suffixes, [key, "suffix"]).groupBy(key, "src", "suffix").agg(F.min("dir").alias("dir"))
    return _all_pairs(first.select(key, "dir", "src").distinct(), py.select(key, "dir", "dst").distinct(),
                      [key, "dir"], "src", "dst", part).select(key, "src", "dst")


def _all_pairs(left: DataFrame, right: DataFrame, keys: list, a: str, b: str, part: int) -> DataFrame:
    """``left`` join ``right`` on ``keys``, where a key may have many rows on both sides.

    The output is as large as it must be, but no task gets a whole key: each side is
    dealt by a hash into parts of about ``part`` rows of the key, and a task joins one
    part of the left with one of the right.  A row is copied once for each part of the
    other side, so the copies are few beside the pairs that they make."""
    def parts(df, name):
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias(name))

    n = parts(left, "_m").join(parts(right, "_n"), keys)

    def deal(c, of):
        return F.pmod(F.xxhash64(c), F.col(of)).cast("int")

    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    x = left.join(n, keys).select(*keys, a, deal(a, "_m").alias("_i"), every("_n").alias("_j"))
    y = right.join(n, keys).select(*keys, b, deal(b, "_n").alias("_j"), every("_m").alias("_i"))
    return x.join(y, [*keys, "_i", "_j"])


def _contracted(step: DataFrame, written) -> tuple[DataFrame, DataFrame | None]:
    """Nodes with edges both ways are merged, again and again until none are left: the
    graph of the merged nodes (node, dst) and (node, label) of the nodes that were merged.

    Each node takes the label of the neighbour (or itself) that is least by a hash;
    nodes of one label reach each other, so whatever reaches one of them reaches all."""
    labels, k = None, 0
    while True:
        mutual = written(step.where("node != dst").join(step.select(F.col("dst").alias("node"), F.col("node").alias("dst")),
                                                        ["node", "dst"]), f"mutual{k}")
        if mutual.isEmpty():
            return step, labels
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)), F.col(c).alias("l"))
        to = mutual.groupBy("node").agg(F.min(F.least(rank("node"), rank("dst"))).alias("r")).select("node", F.col("r.l").alias("label"))
        to = written(to.where("node != label"), f"label{k}")

        def relabelled(df, c):
            return df.join(to.select(F.col("node").alias(c), F.col("label").alias("_to")), c, "left").withColumn(
                c, F.coalesce("_to", c)).drop("_to")

        step = written(relabelled(relabelled(step, "node"), "dst").where("node != dst").distinct(), f"step{k}")
        if labels is None:
            labels = to
        else:
            later = relabelled(labels, "label")
            labels = written(later.unionByName(to.join(labels, "node", "left_anti")), f"labels{k}")
        k += 1


def reachable(edges: DataFrame, roots: DataFrame, growth: int = 4) -> DataFrame:
    """(root, node) for every node reachable from a root (the root itself
    included), cycle-safe.

    First nodes with edges both ways are merged (``_contracted``): the closure is made
    for the merged nodes alone and spelled out at the end, by two joins.
    Then path lengths are doubled: level k holds the pairs of nodes that a walk of
    2^k edges joins, as long as a level is made of at most ``growth`` times as many
    walks as there are edges.  Last come sweeps: a sweep takes its new (root, node) pairs
    through all levels, the longest first, so it covers every walk of up to 2^levels - 1
    edges, and afterwards one edge further; what was not visited before is
    the next sweep's.  A chain of n edges takes about 2 log2(n) rounds, a dense
    graph of small diameter a few sweeps with few levels.  Visited pairs are met
    once a sweep, not once a round.

    Levels, sweeps and visited pairs are parquet tables in the shared checkpoint
    folder, so a lost executor never replays earlier rounds.  Null ends lead nowhere.
    """
    from fixfold.streaming.jobs import scratch

    spark = edges.sparkSession
    base = scratch(spark, "closure")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    step = written(edges.select(F.col("src").alias("node"), F.col("dst")).where("node is not null and dst is not null")
                   .distinct(), "edges")
    step, labels = _contracted(step, written)
    levels, most, whole = [step], growth * step.count(), False
    while True:
        last = levels[-1]
        if last.isEmpty():
            levels.pop()
            whole = True  # no walk is longer than one sweep takes it
            break
        if len(levels) > 1 and len(levels) >= most.bit_length():  # no shortest path is longer than the edges
            break
        # how many walks the next level joins, counted per middle node before they are made
        into, out = last.groupBy(F.col("dst").alias("mid")).count(), last.groupBy(F.col("node").alias("mid")).count()
        walks = into.join(out.withColumnRenamed("count", "n"), "mid").agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0
        if walks > most:
            break
        far = last.select(F.col("node"), F.col("dst").alias("mid")).join(
            last.select(F.col("node").alias("mid"), "dst"), "mid").select("node", "dst").distinct()
        levels.append(written(far, f"level{len(levels)}"))
    starts = roots.select("root").distinct()
    if labels is not None:
        starts = written(starts.join(labels.withColumnRenamed("node", "root"), "root", "left").select(
            "root", F.coalesce("label", "root").alias("label")), "starts")
        roots = starts.select(F.col("label").alias("root"))
    new = written(roots.select(F.col("root"), F.col("root").alias("node")).distinct(), "sweep0")
    visited, sweeps = new, 0
    while levels:
        sweeps += 1
        found = new
        for k, level in enumerate(reversed(levels)):
            further = found.join(level, "node").select("root", F.col("dst").alias("node"))
            found = written(found.unionByName(further).distinct(), f"sweep{sweeps}-{k}")
        found = written(found.join(visited, ["root", "node"], "left_anti"), f"found{sweeps}") if sweeps > 1 else found
        visited = written(visited.unionByName(found).distinct(), f"visited{sweeps}") if sweeps > 1 else found
        if whole:
            break
        further = found.unionByName(new).join(step, "node").select("root", F.col("dst").alias("node")).distinct()
        new = written(further.join(visited, ["root", "node"], "left_anti"), f"sweep{sweeps}")
        if new.isEmpty():
            break
        visited = visited.unionByName(new)
    if labels is None:
        return visited
    own = labels.select(F.col("label").alias("node")).distinct().join(labels, "node", "left_anti")
    members = labels.select(F.col("label").alias("node"), F.col("node").alias("member")).unionByName(
        own.select("node", F.col("node").alias("member")))
    pairs = visited.withColumnRenamed("root", "label").join(members, "node", "left").select(
        "label", F.coalesce("member", "node").alias("node"))
    return starts.join(pairs, starts["label"].eqNullSafe(pairs["label"])).select("root", "node")


def tree_listing(files: DataFrame, key: str = "instance_id", path: str = "path") -> DataFrame:
    """X11: the repository tree as text: every directory (``name/``) and file,
    four spaces per depth, in path order (components compared one by one);
    dotted names that are not ``.py`` and ``test``/``tests`` directories are
    left out together with everything under them."""
    segs = F.split(F.col(path), "/", -1)
    items = files.select(key, F.posexplode(F.transform(F.sequence(F.lit(1), F.size(segs)),
                                                       lambda i: F.slice(segs, 1, i))).alias("depth", "parts")) \
        .distinct()
    leaf = items.join(files.select(key, segs.alias("parts")).withColumn("is_file", F.lit(True)),
                      [key, "parts"], "left")
    is_file = F.coalesce(F.col("is_file"), F.lit(False))
    hidden = lambda s: (s.contains(".") & ~s.contains(".py")) | s.isin("test", "tests")
    shown = leaf.where(~F.exists("parts", hidden))
    name = F.element_at("parts", -1)
    line = F.concat(F.repeat(F.lit(" "), F.col("depth") * 4), name, F.when(is_file, F.lit("")).otherwise(F.lit("/")))
    return shown.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("parts").alias("p"), line.alias("l")))),
        lambda x: x["l"]), "\n").alias("tree"))


def skeleton_bundle(skeletons: DataFrame, key: str = "instance_id", path: str = "path",
                    skeleton: str = "skeleton") -> DataFrame:
    """P20: ``\\n### File: f ###\\n<skeleton>\\n`` per located file, in path order."""
    block = F.concat(F.lit("\n### File: "), F.col(path), F.lit(" ###\n"), F.col(skeleton), F.lit("\n"))
    return skeletons.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), block.alias("b")))),
        lambda x: x["b"]), "").alias("file_skeleton"))
