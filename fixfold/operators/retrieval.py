"""BM25 retrieval and its evaluation.

Index: one postings table for every corpus at once — (corpus, term, salt,
docid, tf, dl, idf, avgdl), written bucketed by (corpus, term, salt).  Everything a score needs is in the posting, so a search joins its few
query terms with the buckets and the postings themselves are never shuffled.
``salt`` is a hash of the document: the postings of a term that occurs in most
documents lie in ``SALTS`` buckets instead of one.

Search: the distinct terms of each query join the postings on (corpus, term,
salt); scores are summed per (query, doc); the top k per query come from a
``row_number() <= k`` filter, which Spark plans as a partial group limit before
the shuffle, so a query with millions of candidate documents never sits whole
in one task.  There is one plan for all sizes and no cap on terms.

The analyser is a documented lower-case word tokenizer (``[\\p{L}\\p{N}_]+``),
so scores are this library's BM25 (k1=0.9, b=0.4, idf = ln(1 + (N-df+0.5)/(df+0.5))),
not a byte-for-byte copy of another engine's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixfold.functions.criteria import NOT_WORD
from fixfold.functions.text import col_

K1, B = 0.9, 0.4
README_PREFIX = "readme"


def terms(text) -> Column:
    """Lower-cased word tokens of a text: what lies between stretches of other characters."""
    return F.array_remove(F.split(F.lower(col_(text)), f"{NOT_WORD}+", -1), "")


#: Buckets over which the postings of one term are spread.
SALTS = 8


def _salt(docid: str) -> Column:
    return F.pmod(F.xxhash64(docid), F.lit(SALTS)).cast("int")


def frequencies(docs: DataFrame, corpus: str = "corpus", docid: str = "docid", contents: str = "contents") -> DataFrame:
    """(corpus, docid, dl, term, tf): documents are dealt as texts, the tokens are counted
    where they are and not sent.  (A plain explode would have the texts tokenized a second time
    before they are dealt, by the filter on the array's size that Spark derives from it.)"""
    toks = docs.select(corpus, docid, contents).repartition(corpus, docid).select(
        corpus, docid, terms(F.col(contents)).alias("t")).select(corpus, docid, F.size("t").alias("dl"), "t")
    return toks.select(corpus, docid, "dl", F.explode_outer("t").alias("term")) \
        .where(F.col("term").isNotNull()).groupBy(corpus, docid, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_index(docs: DataFrame, corpus: str = "corpus", docid: str = "docid",
               contents: str = "contents", buckets: int | None = None) -> dict[str, DataFrame]:
    """``postings``, ``corpus_stats`` and ``term_stats`` for all corpora.

    The corpus is tokenized once; term frequencies are written, the statistics
    are aggregates of that table, and the final postings carry them along.  The
    tables lie in the shared ``spark.checkpoint.dir`` folder; every later use
    reads them."""
    from fixfold.streaming.jobs import scratch

    spark = docs.sparkSession
    base = scratch(spark, "bm25-index")
    # the two large tables are packed closely, as they are as large as the texts
    frequencies(docs, corpus, docid, contents).write.option("compression", "zstd").parquet(f"{base}/frequencies")
    freq = spark.read.parquet(f"{base}/frequencies")
    doc_len = freq.select(corpus, docid, "dl").distinct()
    doc_len.groupBy(corpus).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")) \
        .write.parquet(f"{base}/corpus_stats")
    corpus_stats = spark.read.parquet(f"{base}/corpus_stats")
    freq.groupBy(corpus, "term").agg(F.count(F.lit(1)).alias("df")).join(corpus_stats, corpus) \
        .withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))) \
        .write.parquet(f"{base}/term_stats")
    term_stats = spark.read.parquet(f"{base}/term_stats")
    key = [corpus, "term", "salt"]
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = "bm25_" + base.rsplit("-", 1)[1]
    # the statistics are copied for each salt, so that one shuffle serves the join and the buckets
    each = term_stats.select(corpus, "term", "idf", "avgdl", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    (freq.withColumn("salt", _salt(docid)).repartition(n, *key).join(each, key)
     .write.bucketBy(n, *key).option("compression", "zstd").option("path", f"{base}/postings").saveAsTable(table))
    return {"postings": spark.table(table), "corpus_stats": corpus_stats, "term_stats": term_stats}


def truncate_query(text, max_terms: int | None = None) -> Column:
    """The query's distinct terms in order of first use, at most ``max_terms``."""
    t = F.array_distinct(terms(text))
    return t if max_terms is None else F.slice(t, 1, max_terms)


def _part(k1: float, b: float):
    tf = F.col("tf")
    return F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def bm25_search(index: dict[str, DataFrame], queries: DataFrame, k: int = 20,
                max_terms: int | None = None, qid: str = "qid", corpus: str = "corpus",
                text: str = "query", k1: float = K1, b: float = B) -> DataFrame:
    """R2: (qid, corpus, rank, docid, score) — the k best documents of the query's corpus.

    All query terms count; ``max_terms`` is the explicit truncation of R3."""
    toks = queries.select(qid, corpus, terms(F.col(text)).alias("t"),
                          truncate_query(F.col(text), max_terms).alias("kept"))
    # query term frequencies count every use of a kept term
    q = toks.select(qid, corpus, "kept", F.explode("t").alias("term")).where(F.array_contains("kept", F.col("term"))) \
        .groupBy(qid, corpus, "term").agg(F.count(F.lit(1)).alias("qtf"))
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    scores = q.join(index["postings"], [corpus, "term", "salt"]).groupBy(qid, corpus, "docid").agg(
        F.sum(_part(k1, b)).alias("score"))
    # ranks on the score rounded to 9 places so float summation order cannot flip ties
    w = Window.partitionBy(qid).orderBy(F.desc(F.round("score", 9)), "docid")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select(qid, corpus, "rank", "docid", "score")


def search_all(index: dict[str, DataFrame], queries: DataFrame, k: int = 20,
               qid: str = "qid", corpus: str = "corpus", text: str = "query") -> tuple[DataFrame, DataFrame]:
    """Hits for the queries whose corpus is indexed, and the skipped queries."""
    known = index["corpus_stats"].select(corpus)
    ok = queries.join(known, corpus, "left_semi")
    skipped = queries.join(known, corpus, "left_anti").select(qid, corpus)
    return bm25_search(index, ok, k, qid=qid, corpus=corpus, text=text), skipped


def hits_arrays(hits: DataFrame, qid: str = "qid") -> DataFrame:
    """Hits as one ``array<struct<docid, score>>`` per query, in rank order
    (k entries per query: bounded)."""
    return hits.groupBy(qid).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "docid", "score"))),
        lambda x: F.struct(x["docid"].alias("docid"), x["score"].alias("score"))).alias("hits"))


def recall_metrics(retrieved: DataFrame, gold: DataFrame, key: str = "qid",
                   rank: str = "rank", docid: str = "docid") -> DataFrame:
    """Mean recall, share with any gold file, share with all gold files.
    Instances without gold or without retrieved files are skipped; a leading
    README (first retrieved file) is not counted."""
    # rank of the first file rides along, so the retrieved rows are read once
    w = Window.partitionBy(key).orderBy(rank)
    r = retrieved.withColumn("_first", F.row_number().over(w) == 1).where(
        ~(F.col("_first") & F.lower(F.col(docid)).contains(README_PREFIX)))
    r = r.select(key, docid).distinct().withColumn("_r", F.lit(1))
    g = gold.select(key, docid).distinct().withColumn("_g", F.lit(1))
    n = r.join(g, [key, docid], "full_outer").groupBy(key).agg(
        F.count("_r").alias("n_ret"), F.count("_g").alias("n_gold"), F.count_if(
            F.col("_r").isNotNull() & F.col("_g").isNotNull()).alias("n_hit"))
    per = n.where("n_ret > 0 and n_gold > 0").select(key, (F.col("n_hit") / F.col("n_gold")).alias("recall"))
    return per.agg(F.round(F.avg("recall"), 6).alias("avg_recall"),
                   F.round(F.avg((F.col("recall") > 0).cast("double")), 6).alias("any_recall"),
                   F.round(F.avg((F.col("recall") == 1).cast("double")), 6).alias("all_recall"),
                   F.count(F.lit(1)).alias("n_evaluated"))


FILES_IN_TEXT = r"(?s)\[start of ([\w\.\-/]+)\]\n(?:.+?)\n\[end of \1\]"


def files_in_text(text) -> Column:
    """File names of the ``[start of X] … [end of X]`` blocks of a prompt."""
    return F.regexp_extract_all(col_(text), F.lit(FILES_IN_TEXT), 1)


#: Characters of a gram in the index of terms.
GRAM = 3


def _grams(term: Column, n: int) -> Column:
    """All stretches of ``n`` characters, in one walk over the term."""
    return F.regexp_extract_all(term, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)


def containing_docs(index: dict[str, DataFrame], docs: DataFrame, passages: DataFrame, pid: str = "qid",
                    passage: str = "text", corpus: str = "corpus") -> DataFrame:
    """(pid, docid, corpus) for documents of the passage's corpus whose text
    contains the whole passage.

    Exact without comparing every pair: a document that contains the passage
    contains each *interior* token of it (not the first or last, which may be
    cut from a longer word) as a token of its own, so each passage probes the
    postings of its rarest interior token.  A passage of one or two tokens
    probes those terms that its longest token is a part of: terms are found by
    the rarest of the part's grams (three characters, or all of a shorter part) in an
    index of the terms' grams, which grows with the terms' lengths.  A passage without
    tokens is looked for in every document of its corpus.  Containment is
    verified on the full texts in all cases."""
    toks = terms(F.col(passage))
    p = passages.where(F.col(passage).isNotNull()).select(pid, corpus, passage, toks.alias("_t"))
    ps = p.where(F.size("_t") >= 3).select(
        pid, corpus, passage, F.explode(F.slice("_t", 2, F.size("_t") - 2)).alias("term"))
    rare = ps.join(index["term_stats"].select(corpus, "term", "df"), [corpus, "term"]) \
        .groupBy(pid, corpus, passage).agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    short = p.where(F.size("_t").between(1, 2))
    longest = F.array_max(F.transform("_t", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    parts = short.select(pid, corpus, passage, longest.alias("part"))
    grams = index["term_stats"].select(corpus, "term", F.explode(F.array_distinct(
        F.concat(*[_grams(F.col("term"), n) for n in (1, 2, GRAM)]))).alias("gram"))
    size = F.least(F.length("part"), F.lit(GRAM))
    probes = parts.select("*", F.explode(F.array_distinct(
        F.when(size == 1, _grams(F.col("part"), 1)).when(size == 2, _grams(F.col("part"), 2))
        .otherwise(_grams(F.col("part"), GRAM)))).alias("gram"))
    counts = grams.join(probes.select(corpus, "gram").distinct(), [corpus, "gram"], "left_semi").groupBy(corpus, "gram").count()
    rarest = probes.join(counts, [corpus, "gram"]).groupBy(pid, corpus, passage, "part").agg(
        F.min_by("gram", F.struct("count", "gram")).alias("gram"))
    rare = rare.unionByName(rarest.join(grams, [corpus, "gram"]).where(F.contains("term", "part"))
                            .select(pid, corpus, passage, "term"))
    salted = rare.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cand = salted.join(index["postings"].select(corpus, "term", "salt", "docid"), [corpus, "term", "salt"]) \
        .select(pid, corpus, passage, "docid")
    found = cand.join(docs.select(corpus, "docid", "contents"), [corpus, "docid"])
    bare = p.where(F.size("_t") == 0).drop("_t").join(docs.select(corpus, "docid", "contents"), corpus)
    return found.unionByName(bare).where(F.contains(F.col("contents"), F.col(passage))) \
        .select(pid, "docid", corpus).distinct()
