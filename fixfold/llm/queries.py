"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixfold.llm import (byte_bpe, common, embed_dedup, language_id, near_dedup, packing, periodic_runs, pii, quality_model,
                         quality_rules, secret_scan, sentencepiece_fst, token_alignment, toxicity)


def tokenizer():
    """The encoder factory of the packing query (called in the tasks)."""
    import public_tokenizers as P

    return functools.partial(packing.byte_bpe_encoder, str(P.path("byte_bpe_50k.json")),
                             str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens, one row per piece."""
    return packing.pack_documents(common.documents(spark, sf_dir), tokenizer())


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.ToxicityModel:
    """Learned from the labels outside fold 0 of 5 and the texts of ``docs``."""
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.fit(docs.select("doc_id", "text"), labels.where(common.fold_of(F.col("doc_id"), 5) != 0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity_model(spark, sf_dir, docs), score_col="score")
    return scored.select("doc_id", (common.fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose five-word shingles agree at 0.85 or more, as components."""
    return near_dedup.near_duplicates(common.documents(spark, sf_dir).select("doc_id", "text"), percent=85)


def span_digest(found: DataFrame, spans: str, kinds: tuple[str, ...]) -> DataFrame:
    """Per document: counts and digest of the base findings, and all spans."""
    base = F.filter(spans, lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in kinds],
                        F.sha2(common.span_list(base), 256).alias("base_sha256"),
                        common.span_list(F.col(spans)).alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: counts and digest of the base findings, and all spans."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return span_digest(pii.scan_documents(docs, pii.fit(docs)), "pii_spans", pii.KINDS)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts and digest of the base findings, and all spans."""
    found = secret_scan.scan_documents(common.documents(spark, sf_dir).select("doc_id", "text"))
    return span_digest(found, "secret_spans", secret_scan.KINDS)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, encoded and decoded: their number, the ids' checksum, and whether the text came back."""
    import public_tokenizers as P

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return sentencepiece_fst.round_trip(docs, str(P.path("piece_bpe_32k.model"))).drop("text")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside fold 0 of 5."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality_model.fit(docs, labels.where(common.fold_of(F.col("doc_id"), 5) != 0))
    scored = quality_model.score_documents(docs, model, score_col="score")
    return scored.select("doc_id", (common.fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document, against references of all documents."""
    docs = common.documents(spark, sf_dir)
    measured = common.checkpointed(docs.select(
        "doc_id", "lang", quality_rules.features(F.col("text")).alias("features")))  # no texts
    references = quality_rules.fit_references(measured)
    judged = measured.select("doc_id", quality_rules.judgement(F.col("features"), references).alias("r"))
    return judged.select("doc_id", "r.n_words", "r.word_chars", "r.n_symbols", "r.n_dup_lines",
                         "r.n_repeat_words", "r.base_failed", "r.kept",
                         F.round("r.class_distance", 4).alias("class_distance"),
                         F.round("r.word_distance", 4).alias("word_distance"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a cosine of 0.9 or more, as link counts and components."""
    return embed_dedup.near_duplicates(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the text and lang of those outside fold 1 of 3.

    The contract wants a learned language for every text with a letter, so nothing is rejected here."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = common.fold_of(F.col("doc_id"), 3) == 1
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs.select("doc_id", "text"), model, reject_below=0.0).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the ranks and decoded again: number and digest of the ids, digest of the bytes."""
    import public_tokenizers as P

    coded = byte_bpe.round_trip(common.documents(spark, sf_dir).select("doc_id", "text"),
                                str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers over every document aligned, with corpus-wide counts of the linked id pairs."""
    import public_tokenizers as P

    one = functools.partial(token_alignment.byte_level_side, str(P.path("byte_bpe_50k.json")),
                            str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    two = functools.partial(token_alignment.piece_side, str(P.path("piece_bpe_32k.model")))
    linked = token_alignment.link_documents(
        common.documents(spark, sf_dir), one, two, width=32_000,
        groups_as=lambda g: F.when(g == "", F.lit("")).otherwise(F.sha2(g, 256)))
    return linked.withColumnRenamed("groups", "groups_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, with periodic tails written into a tenth of them."""
    docs = periodic_runs.repeat_tails(common.documents(spark, sf_dir).select("doc_id", "text"))
    found = periodic_runs.find_runs(docs).withColumn("best", periodic_runs.longest_run(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(periodic_runs.run_lines(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_secrets": op5_secrets,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality": op7_quality,
    "op8_quality_rules": op8_quality_rules,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_language": op10_language,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_token_alignment": op12_token_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Queries that SQL can express.
ORACLE: dict[str, str] = {}
