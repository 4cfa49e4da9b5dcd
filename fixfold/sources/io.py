"""Readers and writers for task sets, predictions, result trees and source
trees (S1–S15).  Every reader returns a lazy DataFrame with a declared schema;
nothing is read on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fixfold.functions.text import strip
from fixfold.session import ensure_checkpoint_dir

# The string fields of a task instance.
INSTANCE_FIELDS = ("repo", "instance_id", "base_commit", "patch", "test_patch", "problem_statement",
                   "hints_text", "created_at", "version", "FAIL_TO_PASS", "PASS_TO_PASS",
                   "environment_setup_commit")
INSTANCE_SCHEMA = StructType([StructField(f, StringType()) for f in INSTANCE_FIELDS])

PREDICTION_SCHEMA = StructType([StructField("instance_id", StringType()),
                                StructField("model_name_or_path", StringType()),
                                StructField("model_patch", StringType())])

# Column order of a text dataset split; missing values become "".
SPLIT_COLUMNS = ("instance_id", "text", "repo", "base_commit", "problem_statement", "hints_text", "created_at",
                 "patch", "test_patch", "version", "FAIL_TO_PASS", "PASS_TO_PASS", "environment_setup_commit")

BINARY_PLACEHOLDER = "[BINARY DATA FILE]"


def read_instances(spark: SparkSession, path: str, schema: StructType = INSTANCE_SCHEMA) -> DataFrame:
    """``.jsonl``/``.jsonl.all`` = one JSON object per line, ``.json`` = one
    array; any other suffix is an error.  List-valued test fields arrive as
    their JSON text (P24 turns them into arrays)."""
    if path.endswith(".jsonl") or path.endswith(".jsonl.all"):
        return spark.read.schema(schema).json(path)
    if path.endswith(".json"):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    raise ValueError(f"unsupported instance file {path!r}: expected .json, .jsonl or .jsonl.all")


def read_split(spark: SparkSession, root: str, split: str, aliases: dict | None = None) -> DataFrame:
    """One split of a dataset stored as parquet partitioned by ``split``;
    a dataset alias maps to its folder; an unknown split is an error naming
    the known ones (the distinct split values — a handful of rows)."""
    root = (aliases or {}).get(root, root)
    df = spark.read.parquet(root)
    out = df.where(F.col("split") == split)
    if out.isEmpty():  # only then the names are read
        known = sorted(r["split"] for r in df.select("split").distinct().collect())
        raise ValueError(f"unknown split {split!r}; available: {', '.join(known)}")
    return out


def read_predictions(spark: SparkSession, path: str, instances: DataFrame | None = None) -> DataFrame:
    """S3: ``gold`` (the instances' own patches), ``.json`` (an array) or
    ``.jsonl``; a repeated id keeps its last row (file path order, then row
    order inside the file)."""
    if path == "gold":
        if instances is None:
            raise ValueError("gold predictions need the instances")
        from fixfold.operators.grading import gold_predictions
        return gold_predictions(instances)
    if path.endswith(".jsonl"):
        df = spark.read.schema(PREDICTION_SCHEMA).json(path)
    elif path.endswith(".json"):
        df = spark.read.schema(PREDICTION_SCHEMA).option("multiLine", True).json(path)
    else:
        raise ValueError('predictions path must be "gold", .json, or .jsonl')
    df = df.withColumn("_order", F.struct(F.col("_metadata.file_path").alias("f"),
                                          F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")))
    last = df.groupBy("instance_id").agg(F.max_by(F.struct(*PREDICTION_SCHEMA.fieldNames()), "_order").alias("p"))
    return last.select("p.*")


def read_many(spark: SparkSession, pattern: str, schema: StructType | None = None) -> DataFrame:
    """All JSON-lines files matching a glob, with each row's source file."""
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.json(pattern).withColumn("source_file", F.col("_metadata.file_path"))


def read_result_tree(spark: SparkSession, root: str) -> DataFrame:
    """``root/<run>/<model>/<instance>/{patch.diff, report.json}`` →
    (run_id, model, instance_id, patch, resolved): instances that have both
    files; the patch is stripped, ``resolved`` read from the report."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root) \
        .withColumn("path", F.col("_metadata.file_path"))
    key = r".*/([^/]+)/([^/]+)/([^/]+)/(patch\.diff|report\.json)$"
    f = files.select(F.regexp_extract("path", key, 1).alias("run_id"), F.regexp_extract("path", key, 2).alias("model"),
                     F.regexp_extract("path", key, 3).alias("instance_id"),
                     F.regexp_extract("path", key, 4).alias("kind"), F.col("value"))
    patch = f.where(F.col("kind") == "patch.diff").select("run_id", "model", "instance_id",
                                                          strip(F.col("value")).alias("patch"))
    rep = f.where(F.col("kind") == "report.json").select(
        "run_id", "model", "instance_id",
        F.from_json("value", "map<string, struct<resolved: boolean>>").alias("r"))
    rep = rep.select("run_id", "model", "instance_id",
                     F.coalesce(F.element_at("r", F.col("instance_id"))["resolved"], F.lit(False)).alias("resolved"))
    return patch.join(rep, ["run_id", "model", "instance_id"])


def read_patch_files(spark: SparkSession, pattern: str, model: str) -> DataFrame:
    """One text file per prediction; the id is the file name without
    ``.diff``/``.patch``; rows whose text holds no diff header are kept and
    flagged ``malformed``."""
    f = spark.read.option("wholetext", True).text(pattern).withColumn("path", F.col("_metadata.file_path"))
    name = F.regexp_extract("path", r"([^/]+?)(\.diff|\.patch|\.txt)?$", 1)
    return f.select(name.alias("instance_id"), F.lit(model).alias("model_name_or_path"),
                    F.col("value").alias("model_patch"),
                    (~F.col("value").rlike(r"(?m)^(diff --git |--- )")).alias("malformed"))


def read_source_tree(spark: SparkSession, root: str, include_tests: bool = False) -> DataFrame:
    """S9 + S10: every ``*.py`` under ``root`` with its path relative to root and
    its text; bytes that are not valid UTF-8 become the binary placeholder.
    Test files (word rule) are left out unless ``include_tests``."""
    from fixfold.functions.paths import is_test_path

    b = spark.read.format("binaryFile").option("pathGlobFilter", "*.py") \
        .option("recursiveFileLookup", True).load(root)
    import re

    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    df = b.select(rel.alias("path"), decode_content(F.col("content")).alias("text"))
    return df if include_tests else df.where(~is_test_path(F.col("path"), "word"))


def decode_content(content) -> "F.Column":
    """Bytes → text.  A byte-order mark names the encoding; else valid UTF-8;
    else, without a NUL byte, a single-byte encoding (ISO-8859-1, which maps
    every byte); other texts with a NUL byte, and UTF-16 with surrogate pairs or
    an odd length, are the binary placeholder."""
    s = content.cast("string")
    head = F.hex(F.substring(content, 1, 3))
    nul = F.position(F.lit(b"\0"), content) > 0
    size = F.octet_length(content)
    # UTF-16 units that stand in pairs may be malformed, and decoding them an error; one walk over the units
    unit = "(?:[0-9A-F]{4})*?"
    paired = F.when(head.startswith("FF"), F.hex(content).rlike(f"^FFFE{unit}[0-9A-F]{{2}}D[89A-F]")).otherwise(
        F.hex(content).rlike(f"^FEFF{unit}D[89A-F]"))
    return (F.when(head == "EFBBBF", F.substring(content, 4, F.octet_length(content)).cast("string"))
            .when(F.substring(head, 1, 4).isin("FFFE", "FEFF") & (size % 2 == 0) & ~paired, F.decode(content, "UTF-16"))
            .when(F.is_valid_utf8(s) & ~nul, s)
            .when(nul, F.lit(BINARY_PLACEHOLDER))
            .otherwise(F.decode(content, "ISO-8859-1")))


def flatten_structure(structures: DataFrame, key: str = "instance_id", text: str = "structure") -> tuple[DataFrame, DataFrame]:
    """A repository structure (nested JSON: directories map names to
    children, a file is an object with exactly ``classes``, ``functions`` and
    ``text``) → ``files(key, path, text array<string>)`` and
    ``symbols(key, path, kind, cls, name, start, end)``.

    Each level is one explode of the current directories' JSON maps; the
    loop runs once per tree level until no directory is left; each level is
    checkpointed, so no level is parsed twice."""
    ensure_checkpoint_dir(structures.sparkSession)
    leaf_keys = F.array_sort(F.map_keys(F.from_json(F.col("v"), "map<string,string>")))
    level = structures.select(key, F.lit("").alias("prefix"), F.col(text).alias("v"))
    files = None
    while True:
        ent = level.select(key, "prefix", F.explode(F.from_json("v", "map<string,string>")).alias("name", "v"))
        ent = ent.withColumn("path", F.when(F.col("prefix") == "", F.col("name"))
                             .otherwise(F.concat_ws("/", "prefix", "name")))
        is_obj = F.col("v").startswith("{")
        is_leaf = is_obj & (leaf_keys == F.array(F.lit("classes"), F.lit("functions"), F.lit("text")))
        leaves = ent.where(is_leaf).select(key, "path", "v")
        files = leaves if files is None else files.unionByName(leaves)
        level = ent.where(is_obj & ~is_leaf).select(key, F.col("path").alias("prefix"), "v").checkpoint()
        if level.isEmpty():
            break
    file_schema = ("struct<text: array<string>, functions: array<struct<name: string, start_line: int, "
                   "end_line: int>>, classes: array<struct<name: string, start_line: int, end_line: int, "
                   "methods: array<struct<name: string, start_line: int, end_line: int>>>>>")
    parsed = files.select(key, "path", F.from_json("v", file_schema).alias("f"))
    out_files = parsed.select(key, "path", F.col("f.text").alias("text"))
    fn = parsed.select(key, "path", F.explode("f.functions").alias("s")).select(
        key, "path", F.lit("function").alias("kind"), F.lit(None).cast("string").alias("cls"),
        F.col("s.name").alias("name"), F.col("s.start_line").alias("start"), F.col("s.end_line").alias("end"))
    cl = parsed.select(key, "path", F.explode("f.classes").alias("c"))
    cls = cl.select(key, "path", F.lit("class").alias("kind"), F.lit(None).cast("string").alias("cls"),
                    F.col("c.name").alias("name"), F.col("c.start_line").alias("start"),
                    F.col("c.end_line").alias("end"))
    meth = cl.select(key, "path", F.col("c.name").alias("cls"), F.explode("c.methods").alias("m")).select(
        key, "path", F.lit("method").alias("kind"), "cls", F.col("m.name").alias("name"),
        F.col("m.start_line").alias("start"), F.col("m.end_line").alias("end"))
    return out_files, fn.unionByName(cls).unionByName(meth)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line."""
    df.write.mode(mode).json(path)


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The fixed split columns in order (a missing column → ""), written
    partitioned by split."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c)
            for c in SPLIT_COLUMNS]
    df.select(*cols, "split").write.mode(mode).partitionBy("split").parquet(path)
