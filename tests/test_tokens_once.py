"""The index tokenizes a text once; sizes are counted for the hits."""

import re

from pyspark.sql import functions as F

from fixfold.operators import retrieval as R
from fixfold.plans import retrieve_plans as RP


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_tokenized_once(spark):
    texts = ["Ab_c, dé-F  12", " x", "...", "", None, "İ ß̀Σ 漢字 ٣"]
    df = spark.createDataFrame([("c", str(k), t) for k, t in enumerate(texts)], "corpus string, docid string, contents string")
    old = F.regexp_extract_all(F.lower("contents"), F.lit(r"[\p{L}\p{N}_]+"), 0)
    for r in df.select(old.alias("a"), R.terms("contents").alias("b")).collect():
        assert r["a"] == r["b"]
    f = R.frequencies(df)
    assert {(r["docid"], r["dl"]) for r in f.collect()} == \
        {(r["docid"], r["n"]) for r in df.select("docid", F.size(old).alias("n")).where("n > 0").collect()}
    assert len(re.findall(r"regexp_extract_all|split\(", optimized(f))) == 1


def test_sizes_are_those_of_the_hits(spark, tmp_path):
    spark.createDataFrame([(i, f"a b {i}", "en", "web") for i in range(9)], "doc_id long, text string, lang string, source string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    hits = spark.createDataFrame([("en", "web/mod_3.py"), ("en", "web/mod_3.py"), ("de", "web/mod_4.py")], "corpus string, docid string")
    assert [r["docid"] for r in RP._sizes(spark, str(tmp_path), hits).collect()] == ["web/mod_3.py"]
