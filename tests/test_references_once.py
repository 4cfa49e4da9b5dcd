"""Issue references: a text is walked once, a plan reads what was written."""

from pyspark.sql import functions as F

from fixfold.operators import collect as CO
from fixfold.plans import collect_plans as CP


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_issue_references_walk_the_text_once(spark):
    texts = ["fixes #1, fixes #2 Closes  #3", "see #4 resolved\n#5 <!-- fixes #6 --> é fixes #7", "prefixes #8 fix #9 fix #10 fix #1x", "", None, "#3 fix#4"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    last = df.select("k", CO.issue_refs(F.col("t")).alias("r"))
    assert [r["r"] for r in last.orderBy("k").collect()] == [["2", "3"], ["5", "7"], ["1"], [], None, []]
    every = df.select("k", CO.issue_refs(F.col("t"), per_word=False).alias("r"))
    assert [r["r"] for r in every.orderBy("k").collect()] == [["1", "2", "3"], ["5", "7"], ["9", "10", "1"], [], None, []]
    assert optimized(last).count("regexp_extract_all") == 1


def test_collection_plans_read_the_references_written_once(spark, tmp_path):
    spark.createDataFrame([(i, f"t{i}\nbody fixes #{i % 3}", "en", "web", 10) for i in range(12)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, k, ("user", "assistant")[k % 2], f"c{i}{k}") for i in range(12) for k in range(4)],
                          "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("funnel", "hints_filter", "hints_before", "problem_statements"):
        df = CP.QUERIES[name](spark, str(tmp_path))
        assert "regexp_extract_all" not in optimized(df)
        assert df.count() == (1 if name == "funnel" else 12)
    assert CP.q_funnel(spark, str(tmp_path)).first()["n_read"] == 12
