"""The corpus pipeline (part of the ``fixfold.llm`` subpackage).

Raw documents to packed training sequences in five stages: toxic documents go,
documents that fail the quality rules go, one document of each near-duplicate
group stays, secrets are masked, and what is left is packed.  Each stage takes
and returns documents; it works on all that the one before has kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixfold.llm import near_dedup, packing, quality_rules, secret_scan, toxicity
from fixfold.llm.queries import tokenizer, toxicity_model
from fixfold.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    return toxicity.drop_toxic(docs, toxicity_model(spark, sf_dir, docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence rules reject go."""
    return quality_rules.keep_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) stays."""
    return near_dedup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, plain or encoded, are replaced by a mark; ``n_chars`` follows."""
    masked = secret_scan.redact_documents(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, one row per piece, with the token ids."""
    return packing.pack_documents(docs, tokenizer(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table.

    Each stage's documents are written to the shared checkpoint folder and read
    again, so no stage repeats the work of the ones before.
    """
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokens, decoding and learned scores are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
