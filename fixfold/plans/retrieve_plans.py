"""Registered queries for retrieval and prompt building, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixfold.functions import prompts as PR
from fixfold.functions.criteria import WORD
from fixfold.operators import context as CX
from fixfold.operators import retrieval as R
from fixfold.plans.views_sql import VIEWS, with_views
from fixfold.sources import adapters as A
from fixfold.sources.tables import Tables
from fixfold.streaming.jobs import scratch

QUERIES = {}
ORACLE = {}
K_HITS = 20
BUDGET = 6000


def _index(spark, sf):
    return R.bm25_index(A.corpus_docs(spark, sf))


def _hits(spark, sf, index=None):
    """Written, as plans read them more than once; made anew for every query, from its own tables."""
    path = scratch(spark, "bm25-hits")
    R.search_all(index or _index(spark, sf), A.search_queries(spark, sf), K_HITS)[0].write.parquet(path)
    return spark.read.parquet(path)


def _gold(spark, sf, index=None):
    q = A.search_queries(spark, sf).withColumnRenamed("query", "text")
    docs = A.corpus_docs(spark, sf)
    return R.containing_docs(index or _index(spark, sf), docs, q, pid="qid", passage="text", corpus="corpus")


def _readmes(spark, sf):
    docs = A.corpus_docs(spark, sf)
    rm = CX.pick_readmes(docs)
    q = A.search_queries(spark, sf).select("qid", "corpus")
    return CX.code_bundle(q.join(rm, "corpus"), "qid", name="readmes_text")


def _base(spark, sf):
    q = A.search_queries(spark, sf)
    rm = _readmes(spark, sf)
    b = q.join(rm, "qid", "left").withColumn("code_text", F.lit("")) \
        .withColumnRenamed("query", "problem_statement")
    return b.select("qid", CX.token_count(CX.render_prompt(b, "style-2")).alias("base"))


def _sizes(spark, sf, hits):
    """Of the documents that were hit: no other size is looked up."""
    d = A.corpus_docs(spark, sf).join(hits.select("corpus", "docid").distinct(), ["corpus", "docid"], "left_semi")
    return d.select("corpus", "docid", CX.token_count(CX.file_block(F.col("docid"), F.col("contents"))).alias("size"))


def _packed(spark, sf):
    hits = _hits(spark, sf)
    return CX.pack_context(hits, _sizes(spark, sf, hits), _base(spark, sf), BUDGET)


def _bundles(spark, sf):
    files = _packed(spark, sf).select("qid", F.explode("files").alias("docid"))
    files = files.join(A.search_queries(spark, sf).select("qid", "corpus"), "qid")
    return CX.code_bundle(files.join(A.corpus_docs(spark, sf), ["corpus", "docid"]), "qid")


def _prompt_inputs(spark, sf):
    q = A.search_queries(spark, sf).withColumnRenamed("query", "problem_statement")
    return q.join(_readmes(spark, sf), "qid", "left").join(_bundles(spark, sf), "qid", "left")


def q_bm25_index(spark, sf):
    return _index(spark, sf)["term_stats"].select("corpus", "term", "df", F.round("idf", 9).alias("idf"))


def q_bm25_search(spark, sf):
    return _hits(spark, sf).select("qid", "rank", "docid", F.round("score", 6).alias("score"))


def q_truncate_query(spark, sf):
    q = A.search_queries(spark, sf)
    return q.select("qid", F.array_join(R.truncate_query(F.col("query"), 16), " ").alias("terms"))


def q_search_skipped(spark, sf):
    _, skipped = R.search_all(_index(spark, sf), A.search_queries(spark, sf), K_HITS)
    return skipped


def q_containing_docs(spark, sf):
    return _gold(spark, sf).select("qid", "docid")


def q_recall_metrics(spark, sf):
    index = _index(spark, sf)
    return R.recall_metrics(_hits(spark, sf, index), _gold(spark, sf, index))


def q_with_hits(spark, sf):
    from fixfold.operators.joins import with_hits

    arr = R.hits_arrays(_hits(spark, sf))
    j = with_hits(A.search_queries(spark, sf), arr, 5, key="qid")
    return j.select("qid", F.size("hits").alias("n_hits"),
                    F.try_element_at("hits", F.lit(1))["docid"].alias("top_docid"))


def q_pick_readmes(spark, sf):
    return CX.pick_readmes(A.corpus_docs(spark, sf)).select("corpus", "docid")


def q_pack_context(spark, sf):
    p = _packed(spark, sf)
    return p.select("qid", F.array_join("files", ",").alias("files"), "total")


def q_code_bundle(spark, sf):
    return _bundles(spark, sf)


def _prompt_q(style):
    def q(spark, sf):
        df = _prompt_inputs(spark, sf)
        return df.select("qid", CX.render_prompt(df, style).alias("prompt"))
    return q


def q_files_in_text(spark, sf):
    p = _prompt_q("style-2")(spark, sf)
    return p.select("qid", F.array_join(R.files_in_text(F.col("prompt")), ",").alias("files"))


def q_add_line_numbers(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", CX.add_line_numbers(F.col("text")).alias("numbered"))


def _turn_pairs(spark, sf):
    c = Tables(spark, sf).conversations
    x = c.where(F.col("role") == "user").select("conv_id", "turn", CX.token_ids(F.col("text")).alias("x"))
    y = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), CX.token_ids(F.col("text")).alias("y"))
    return x.join(y, ["conv_id", "turn"])


def q_training_labels(spark, sf):
    p = _turn_pairs(spark, sf).select("conv_id", "turn", *CX.training_labels(F.col("x"), F.col("y")))
    return p.select("conv_id", "turn", F.array_join("input_ids", ",").alias("input_ids"),
                    F.array_join("labels", ",").alias("labels"))


def q_eval_labels(spark, sf):
    p = _turn_pairs(spark, sf).select("conv_id", "turn", *CX.eval_labels(F.col("x"), F.col("y")))
    return p.select("conv_id", "turn", F.array_join("input_ids", ",").alias("input_ids"),
                    F.array_join("labels", ",").alias("labels"))


def q_tokenize(spark, sf):
    c = Tables(spark, sf).conversations
    return c.select("conv_id", "turn", F.size(CX.token_ids(F.col("text"))).alias("n_tokens"),
                    F.try_element_at(CX.token_ids(F.col("text")), F.lit(1)).alias("first_id"))


QUERIES.update({
    "bm25_index": q_bm25_index,
    "bm25_search": q_bm25_search,
    "truncate_query": q_truncate_query,
    "search_skipped": q_search_skipped,
    "containing_docs": q_containing_docs,
    "recall_metrics": q_recall_metrics,
    "with_hits": q_with_hits,
    "pick_readmes": q_pick_readmes,
    "pack_context": q_pack_context,
    "code_bundle": q_code_bundle,
    "prompt_style_2": _prompt_q("style-2"),
    "prompt_style_3": _prompt_q("style-3"),
    "prompt_full_file": _prompt_q("full_file_gen"),
    "files_in_text": q_files_in_text,
    "add_line_numbers": q_add_line_numbers,
    "training_labels": q_training_labels,
    "eval_labels": q_eval_labels,
    "tokenize": q_tokenize,
})

# ---------------------------------------------------------------- DuckDB twins

VIEWS["corpus_docs"] = """
corpus_docs AS (
  SELECT lang AS corpus,
         CASE WHEN doc_id % 50 = 0 THEN source || '/README_' || CAST(doc_id AS VARCHAR) || '.md'
              ELSE source || '/mod_' || CAST(doc_id AS VARCHAR) || '.py' END AS docid,
         text AS contents
  FROM documents)"""

VIEWS["search_queries"] = """
search_queries AS (
  SELECT item_id AS qid, CASE WHEN item_id % 9 = 0 THEN 'none' ELSE (['de', 'en', 'es', 'fr'])[item_id % 4 + 1] END AS corpus,
         text AS query
  FROM benchmark)"""

_TOK = f"{WORD}+"


def _numbered(c):
    return f"array_to_string(list_transform(string_split({c}, chr(10)), lambda l, i: CAST(i AS VARCHAR) || ' ' || l), chr(10))"


def _block(p, c):
    return f"('[start of ' || {p} || ']' || chr(10) || {_numbered(c)} || chr(10) || '[end of ' || {p} || ']' || chr(10))"


def _sql_lit(s):
    return "'" + s.replace("'", "''") + "'"


def _prompt_sql(style):
    parts = []
    for p in PR.TEMPLATES[style]:
        parts.append(f"coalesce({p[1]}, '')" if isinstance(p, tuple) else _sql_lit(p))
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


_BM25 = f"""
toks AS (SELECT corpus, docid, regexp_extract_all(lower(contents), '{_TOK}') AS t FROM corpus_docs),
doc_len AS (SELECT corpus, docid, len(t) AS dl FROM toks),
postings AS (SELECT corpus, term, docid, count(*) AS tf FROM (SELECT corpus, docid, unnest(t) AS term FROM toks) GROUP BY ALL),
cstats AS (SELECT corpus, count(*) AS n_docs, avg(dl) AS avgdl FROM doc_len GROUP BY corpus),
tstats AS (SELECT p.corpus, p.term, count(*) AS df, any_value(c.n_docs) AS n_docs, any_value(c.avgdl) AS avgdl,
                  ln(1 + (any_value(c.n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
           FROM postings p JOIN cstats c USING (corpus) GROUP BY p.corpus, p.term),
okq AS (SELECT * FROM search_queries WHERE corpus IN (SELECT corpus FROM cstats)),
qterms AS (SELECT DISTINCT qid, corpus, unnest(list_distinct(regexp_extract_all(lower(query), '{_TOK}'))) AS term FROM okq),
qtf AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '{_TOK}')) AS term FROM okq) GROUP BY ALL),
scores AS (
  SELECT q.qid, p.docid,
         sum(f.qtf * s.idf * p.tf * 1.9 / (p.tf + 0.9 * (1 - 0.4 + 0.4 * d.dl / s.avgdl))) AS score
  FROM qterms q JOIN qtf f USING (qid, term) JOIN tstats s USING (corpus, term)
  JOIN postings p USING (corpus, term) JOIN doc_len d USING (corpus, docid)
  GROUP BY q.qid, p.docid),
hits AS (
  SELECT * FROM (SELECT qid, docid, score,
                        row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, docid) AS rank
                 FROM scores) WHERE rank <= {K_HITS})"""

_GOLD = """
gold AS (
  SELECT DISTINCT q.qid, d.docid FROM search_queries q JOIN corpus_docs d ON d.corpus = q.corpus
  WHERE strpos(d.contents, q.query) > 0)"""

_PROMPT = f"""
readme_pick AS (
  SELECT corpus, arg_min(docid, (length(string_split(docid, '/')[-1]), docid)) AS docid
  FROM corpus_docs WHERE starts_with(lower(string_split(docid, '/')[-1]), 'readme') GROUP BY corpus),
readmes AS (
  SELECT q.qid, regexp_replace(string_agg({_block('r.docid', 'c.contents')}, '' ORDER BY r.docid), '^\\n+|\\n+$', '', 'g') AS readmes_text
  FROM search_queries q JOIN readme_pick r USING (corpus) JOIN corpus_docs c ON c.docid = r.docid GROUP BY q.qid),
base AS (
  SELECT qid, len(regexp_extract_all({_prompt_sql('style-2').replace('coalesce(problem_statement', 'coalesce(query').replace('coalesce(code_text', "coalesce(''")}, '{_TOK}')) AS base
  FROM search_queries LEFT JOIN readmes USING (qid)),
sizes AS (SELECT docid, len(regexp_extract_all({_block('docid', 'contents')}, '{_TOK}')) AS size FROM corpus_docs),
harr AS (SELECT qid, list({{'rank': rank, 'docid': h.docid, 'size': size}} ORDER BY rank) AS xs
         FROM hits h JOIN sizes s USING (docid) GROUP BY qid),
packed AS (
  SELECT b.qid, list_reduce(coalesce(xs, []), lambda acc, x: CASE WHEN acc.total + x.size < {BUDGET}
            THEN {{'total': acc.total + x.size, 'keep': list_append(acc.keep, x.docid)}} ELSE acc END,
            {{'total': CAST(b.base AS BIGINT), 'keep': []::VARCHAR[]}}) AS r
  FROM base b LEFT JOIN harr USING (qid)),
bundles AS (
  SELECT qid, regexp_replace(string_agg({_block('f.docid', 'c.contents')}, '' ORDER BY f.docid), '^\\n+|\\n+$', '', 'g') AS code_text
  FROM (SELECT qid, unnest(r.keep) AS docid FROM packed) f JOIN corpus_docs c USING (docid) GROUP BY qid),
pin AS (
  SELECT q.qid, q.query AS problem_statement, r.readmes_text, b.code_text
  FROM search_queries q LEFT JOIN readmes r USING (qid) LEFT JOIN bundles b USING (qid))"""

_RV = ["corpus_docs", "search_queries"]
ORACLE["bm25_index"] = with_views(_RV, _BM25) + "\nSELECT corpus, term, df, round(idf, 9) AS idf FROM tstats"
ORACLE["bm25_search"] = with_views(_RV, _BM25) + "\nSELECT qid, rank, docid, round(score, 6) AS score FROM hits"
ORACLE["truncate_query"] = with_views(_RV) + f"""
SELECT qid, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i)[1:16], ' ') AS terms
FROM (SELECT qid, regexp_extract_all(lower(query), '{_TOK}') AS t FROM search_queries)"""
ORACLE["search_skipped"] = with_views(_RV) + """
SELECT qid, corpus FROM search_queries WHERE corpus NOT IN (SELECT DISTINCT corpus FROM corpus_docs)"""
ORACLE["containing_docs"] = with_views(_RV, _GOLD) + "\nSELECT * FROM gold"
ORACLE["recall_metrics"] = with_views(_RV, _BM25, _GOLD) + """
, ret AS (
  SELECT DISTINCT h.qid, h.docid FROM hits h JOIN (SELECT qid, min(rank) AS f FROM hits GROUP BY qid) m USING (qid)
  WHERE NOT (h.rank = m.f AND contains(lower(h.docid), 'readme'))),
per AS (
  SELECT g.qid, coalesce(x.n_hit, 0) / g.n_gold AS recall
  FROM (SELECT qid, count(*) AS n_gold FROM gold GROUP BY qid) g
  JOIN (SELECT qid, count(*) AS n_ret FROM ret GROUP BY qid) r USING (qid)
  LEFT JOIN (SELECT qid, count(*) AS n_hit FROM ret JOIN gold USING (qid, docid) GROUP BY qid) x USING (qid))
SELECT round(avg(recall), 6) AS avg_recall, round(avg(CASE WHEN recall > 0 THEN 1.0 ELSE 0.0 END), 6) AS any_recall,
       round(avg(CASE WHEN recall = 1 THEN 1.0 ELSE 0.0 END), 6) AS all_recall, count(*) AS n_evaluated
FROM per"""
ORACLE["with_hits"] = with_views(_RV, _BM25) + """
SELECT q.qid, CASE WHEN x.n IS NULL THEN 0 ELSE least(x.n, 5) END AS n_hits, x.top_docid
FROM search_queries q LEFT JOIN (SELECT qid, count(*) AS n, arg_min(docid, rank) AS top_docid FROM hits GROUP BY qid) x
USING (qid)"""
ORACLE["pick_readmes"] = with_views(_RV, _PROMPT.split("readmes AS")[0].rstrip().rstrip(",")) + \
    "\nSELECT corpus, docid FROM readme_pick"
ORACLE["pack_context"] = with_views(_RV, _BM25, _PROMPT) + """
SELECT qid, array_to_string(r.keep, ',') AS files, r.total AS total FROM packed"""
ORACLE["code_bundle"] = with_views(_RV, _BM25, _PROMPT) + "\nSELECT qid, code_text FROM bundles"
ORACLE["prompt_style_2"] = with_views(_RV, _BM25, _PROMPT) + f"\nSELECT qid, {_prompt_sql('style-2')} AS prompt FROM pin"
ORACLE["prompt_style_3"] = with_views(_RV, _BM25, _PROMPT) + f"\nSELECT qid, {_prompt_sql('style-3')} AS prompt FROM pin"
ORACLE["prompt_full_file"] = with_views(_RV, _BM25, _PROMPT) + \
    f"\nSELECT qid, {_prompt_sql('full_file_gen')} AS prompt FROM pin"
ORACLE["files_in_text"] = with_views(_RV, _BM25, _PROMPT) + f"""
SELECT qid, array_to_string(list_filter(regexp_extract_all(p, '\\[start of ([\\w\\.\\-/]+)\\]\\n', 1),
                                        lambda f: contains(p, chr(10) || '[end of ' || f || ']')), ',') AS files
FROM (SELECT qid, {_prompt_sql('style-2')} AS p FROM pin)"""
ORACLE["add_line_numbers"] = "SELECT doc_id, " + _numbered("text") + " AS numbered FROM documents"

_IDS = f"list_transform(regexp_extract_all(@C@, '{_TOK}'), lambda w: CAST(('0x' || substr(md5(w), 1, 6)) AS INTEGER))"
_PAIRS = f"""
pairs AS (
  SELECT x.conv_id, x.turn, {_IDS.replace('@C@', 'x.text')} AS x, {_IDS.replace('@C@', 'y.text')} AS y
  FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1 AND y.role = 'assistant'
  WHERE x.role = 'user')"""
ORACLE["training_labels"] = "WITH " + _PAIRS.strip() + """
SELECT conv_id, turn, array_to_string(x || y[1:greatest(len(y) - 1, 0)], ',') AS input_ids,
       array_to_string(list_transform(range(greatest(len(x) - 1, 0)), lambda i: -100) || y, ',') AS labels
FROM pairs"""
ORACLE["eval_labels"] = "WITH " + _PAIRS.strip() + """
SELECT conv_id, turn, array_to_string(x, ',') AS input_ids, array_to_string(y, ',') AS labels FROM pairs"""
ORACLE["tokenize"] = f"""
SELECT conv_id, turn, len(t) AS n_tokens, t[1] AS first_id
FROM (SELECT conv_id, turn, {_IDS.replace('@C@', 'text')} AS t FROM conversations)"""
