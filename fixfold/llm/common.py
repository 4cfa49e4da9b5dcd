"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixfold.session import ensure_checkpoint_dir

#: Words of a text: runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: ASCII A-Z to a-z and nothing else (``str.lower`` also changes other letters).
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder the cluster names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds), F.lit(0))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices: Python objects of few rows at a time, however long the texts of a batch are."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def map_rows(df: DataFrame, columns: list[str], make, fields: list[tuple[str, str]]) -> DataFrame:
    """Append ``fields`` computed from ``columns`` row by row in Arrow batches.

    ``make()`` runs once per task and returns ``fn(list, list, ...) -> list of
    tuples`` (one tuple per row, in the order of ``fields``).  The input columns
    stay unchanged, and null integers stay exact (no pandas round trip).
    ``fields`` must not clash with the columns of ``df``.
    """
    taken = {c.lower() for c in df.columns}
    if clash := [n for n, _ in fields if n.lower() in taken]:
        raise ValueError(f"columns already present: {clash}")
    added = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    schema = T.StructType(df.schema.fields + added.fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    types = [f.type for f in to_arrow_schema(added)]
    names = [n for n, _ in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in slices(batches):
            out = fn(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns))
            cols = list(zip(*out)) if out else [()] * len(names)
            arrays = list(b.columns) + [pa.array(list(c), type=t) for c, t in zip(cols, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names + names)

    return df.mapInArrow(run, schema)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of an array of span structs, comma-joined in its order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores in front until it clashes with no column."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted
