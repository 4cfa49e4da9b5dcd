"""Registered queries of readers, writers and call helpers: each writes frames of
the driver tables to the shared folder and reads them with the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixfold.operators import environment as EN
from fixfold.functions.text import PY_WS
from fixfold.operators import infer as I
from fixfold.operators import versions as VE
from fixfold.operators.curate import write_dual
from fixfold.plans.views_sql import with_views
from fixfold.sources import adapters as A
from fixfold.sources import io as S
from fixfold.sources.tables import Tables
from fixfold.streaming.jobs import scratch

QUERIES = {}
ORACLE = {}


def q_read_instances(spark, sf):
    """Instances written as JSON lines and read with the instance schema."""
    path = scratch(spark, "instances") + ".jsonl"
    S.write_jsonl(A.instances(spark, sf).select("instance_id", "repo", "problem_statement", "patch", "test_patch"), path)
    return S.read_instances(spark, path).select("instance_id", "repo", "problem_statement", "patch", "version")


def q_read_split(spark, sf):
    """A dataset of two splits, one of them read back by an alias."""
    path = scratch(spark, "splits")
    i = A.instances(spark, sf).select("instance_id", "repo", "patch", F.when(
        F.col("pull_number") % 3 == 0, "test").otherwise("train").alias("split"))
    S.write_splits(i, path)
    return S.read_split(spark, "mine", "test", {"mine": path}).select("instance_id", "repo", "patch", "version", "split")


def q_read_predictions(spark, sf):
    """S3: a prediction file in which every id stands twice; the later row counts."""
    path = scratch(spark, "predictions") + ".jsonl"
    p = Tables(spark, sf).customer.select(F.col("c_custkey").cast("string").alias("instance_id"),
                                          F.lit("m").alias("model_name_or_path"))
    old, new = (p.withColumn("model_patch", F.concat(F.lit(t), F.col("instance_id"))) for t in ("old ", "new "))
    both = old.withColumn("k", F.lit(0)).unionByName(new.withColumn("k", F.lit(1)))
    both.repartition(4, "instance_id").sortWithinPartitions("k").drop("k").write.json(path)
    return S.read_predictions(spark, path)


def q_read_many(spark, sf):
    """Shards read by a glob, each row with its source file."""
    path = scratch(spark, "shards")
    c = Tables(spark, sf).customer.select("c_custkey", (F.col("c_custkey") % 5).alias("shard"))
    c.write.partitionBy("shard").json(path)
    return S.read_many(spark, path + "/*/*.json", "c_custkey long").select(
        "c_custkey", F.regexp_extract("source_file", r"shard=(\d+)", 1).alias("shard"))


def q_flatten_structure(spark, sf):
    """The modules of an instance as a nested structure, flattened again."""
    f = A.code_files(spark, sf)
    parts = F.split("path", "/")
    leaf = F.to_json(F.struct(F.array().cast("array<string>").alias("classes"), F.array().cast("array<string>").alias("functions"),
                              F.split("text", "\n", -1).alias("text")))
    nested = F.aggregate(F.reverse(parts), leaf, lambda acc, name: F.concat(
        F.lit("{"), F.to_json(F.array(name)).substr(F.lit(2), F.length(F.to_json(F.array(name))) - 2), F.lit(":"), acc, F.lit("}")))
    files, _ = S.flatten_structure(f.select("instance_id", nested.alias("structure")))
    return files.select("instance_id", "path", F.array_join("text", "\n").alias("text"))


def q_write_dual(spark, sf):
    """All valid instances, and those with tests, read back from the two files."""
    path = scratch(spark, "dual")
    write_dual(A.instances(spark, sf), path)
    a = spark.read.schema("instance_id string").json(path + ".all").withColumn("file", F.lit("all"))
    return a.unionByName(spark.read.schema("instance_id string").json(path).withColumn("file", F.lit("tests")))


def q_replace_packages(spark, sf):
    """requirement lines of each customer."""
    c = Tables(spark, sf).customer.select("c_custkey", F.concat(
        F.lit("  pkg"), (F.col("c_custkey") % 7).cast("string"), F.lit("\n\n"), F.lower("c_mktsegment"), F.lit(" \n")).alias("requirements"))
    return EN.replace_packages(c)


def q_parse_kv(spark, sf):
    """Call arguments written as ``k=v`` pairs."""
    c = Tables(spark, sf).customer
    text = F.concat(F.lit("n="), F.col("c_custkey").cast("string"), F.lit(",on="), F.when(F.col("c_custkey") % 2 == 0, "True").otherwise("False"),
                    F.lit(",none=None,seg="), F.col("c_mktsegment"))
    kv = c.select("c_custkey", I.parse_kv(text).alias("kv"))
    return kv.select("c_custkey", *[F.col("kv")[k].alias(k) for k in ("n", "on", "none", "seg")])


def _answers(spark, sf):
    """I1 on every conversation turn; texts of a length divisible by eleven always fail."""
    def fn(texts):
        if any(len(t) % 11 == 0 for t in texts):
            raise ValueError("refused")
        return [t[:7] for t in texts]

    c = Tables(spark, sf).conversations
    return I.complete(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("call_id"), "text"), fn, "text", "call_id", retries=1)


def q_complete(spark, sf):
    return _answers(spark, sf).select("call_id", "output", "error")


def q_fail_budget(spark, sf):
    """I3 over the calls of I1."""
    return I.fail_budget(_answers(spark, sf))


def q_decode_content(spark, sf):
    """Document texts as bytes of three encodings, decoded again."""
    d, k = Tables(spark, sf).documents, F.col("doc_id") % 3
    raw = (F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
           .otherwise(F.encode("text", "UTF-16")))
    return d.select("doc_id", S.decode_content(raw).alias("text"))


def q_clean_requirements(spark, sf):
    """each document's lines as a requirements file that includes another one."""
    d = Tables(spark, sf).documents
    main = d.select("doc_id", F.lit("requirements.txt").alias("file"),
                    F.concat(F.lit("# pinned\n-r dev.txt\n"), "text", F.lit("\n  -e .\n-r none.txt")).alias("text"))
    dev = d.select("doc_id", F.lit("dev.txt").alias("file"), F.concat(
        F.lit("pkg=="), F.col("n_chars").cast("string"), F.lit("\n# no\n.[test]\nlast ")).alias("text"))
    return EN.clean_requirements(main.unionByName(dev), key="doc_id")


def q_spec_lookup(spark, sf):
    """The installation spec of each task's repository and version, where there is one."""
    t = Tables(spark, sf)
    tasks = t.customer.select(F.col("c_custkey").alias("instance_id"), F.col("c_nationkey").alias("repo"),
                              F.concat((F.col("c_custkey") % 7).cast("string"), F.lit(".0")).alias("version"))
    specs = t.nation.select(F.col("n_nationkey").alias("repo"), F.explode(F.sequence(F.lit(0), F.col("n_nationkey") % 6)).alias("v"), "n_name")
    specs = specs.select("repo", F.concat(F.col("v").cast("string"), F.lit(".0")).alias("version"),
                         F.concat(F.lit("pip install "), F.lower("n_name")).alias("install"))
    return VE.spec_lookup(tasks, specs).select("instance_id", "repo", "version", "install")


QUERIES.update({
    "decode_content": q_decode_content, "clean_requirements": q_clean_requirements, "spec_lookup": q_spec_lookup,
    "read_instances": q_read_instances, "read_split": q_read_split, "read_predictions": q_read_predictions,
    "read_many": q_read_many, "flatten_structure": q_flatten_structure, "write_dual": q_write_dual,
    "replace_packages": q_replace_packages, "parse_kv": q_parse_kv, "complete": q_complete, "fail_budget": q_fail_budget})

ORACLE["decode_content"] = f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 2 AND regexp_matches(text, '[\\x{{10000}}-\\x{{10FFFF}}]') THEN '{S.BINARY_PLACEHOLDER}'
                    WHEN doc_id % 3 = 0 AND contains(text, chr(0)) THEN '{S.BINARY_PLACEHOLDER}' ELSE text END AS text
FROM documents"""
_KEPT = " AND ".join(f"NOT starts_with(regexp_replace(l, '^{PY_WS}+', ''), '{p}')" for p in ("-r", *EN.EXCLUDED_PREFIXES))
ORACLE["clean_requirements"] = f"""
SELECT doc_id, 'pkg==' || n_chars || chr(10) || 'last ' || chr(10)
       || array_to_string(list_filter(string_split(text, chr(10)), lambda l: {_KEPT}), chr(10)) AS requirements
FROM documents"""
ORACLE["spec_lookup"] = """
SELECT c_custkey AS instance_id, c_nationkey AS repo, (c_custkey % 7) || '.0' AS version,
       CASE WHEN c_custkey % 7 <= c_nationkey % 6 THEN 'pip install ' || lower(n_name) END AS install
FROM customer JOIN nation ON n_nationkey = c_nationkey"""

_I = ["patches", "instances"]
ORACLE["read_instances"] = with_views(_I) + """
SELECT instance_id, repo, problem_statement, patch, CAST(NULL AS VARCHAR) AS version FROM instances"""
ORACLE["read_split"] = with_views(_I) + """
SELECT instance_id, repo, coalesce(patch, '') AS patch, '' AS version, 'test' AS split FROM instances WHERE pull_number % 3 = 0"""
ORACLE["read_predictions"] = """
SELECT CAST(c_custkey AS VARCHAR) AS instance_id, 'm' AS model_name_or_path, 'new ' || c_custkey AS model_patch FROM customer"""
ORACLE["read_many"] = "SELECT c_custkey, CAST(c_custkey % 5 AS VARCHAR) AS shard FROM customer"
ORACLE["flatten_structure"] = with_views(["code_lines", "code_files"]) + "\nSELECT instance_id, path, text FROM code_files"
ORACLE["write_dual"] = with_views(_I) + """
, v AS (SELECT * FROM instances WHERE coalesce(patch, '') <> '' AND coalesce(problem_statement, '') <> '')
SELECT instance_id, 'all' AS file FROM v
UNION ALL SELECT instance_id, 'tests' FROM v WHERE trim(coalesce(test_patch, ''), chr(32) || chr(9) || chr(10) || chr(13)) <> ''"""
_REPLACED = "CASE l " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EN.PACKAGE_REPLACEMENTS.items()) + " ELSE l END"
ORACLE["replace_packages"] = f"""
SELECT c_custkey, array_to_string(list_transform(['pkg' || (c_custkey % 7), lower(c_mktsegment)], lambda l: {_REPLACED}), chr(10))
       || chr(10) AS requirements FROM customer"""
ORACLE["parse_kv"] = """
SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS n, CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS "on",
       'null' AS "none", '"' || c_mktsegment || '"' AS seg FROM customer"""
ORACLE["complete"] = """
SELECT conv_id * 1000 + turn AS call_id, CASE WHEN length(text) % 11 <> 0 THEN substr(text, 1, 7) END AS output,
       CASE WHEN length(text) % 11 = 0 THEN 'ValueError: refused' END AS error FROM conversations"""
ORACLE["fail_budget"] = """
SELECT n_failed, n_failed >= 3 AS aborted FROM (SELECT count(*) FILTER (WHERE length(text) % 11 = 0) AS n_failed FROM conversations)"""
