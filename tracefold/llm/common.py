"""Small Spark helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracefold.session import cut  # noqa: F401  (written, re-read tables cut the lineage)

#: Stands for a null id wherever ids are compared: below every other id.
NO_ID = -(1 << 63)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, id, tag, text): ``id`` orders documents, ``(id, tag)`` names equal rows.

    A null ``doc_id`` counts as the smallest id; ``tag`` hashes the text, so repeated
    ids with different texts stay apart and repeated rows get equal results.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tag"),
        F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"))


def binary(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts as bytes, null as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"))


def crc_fold(folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (the agreed hold-out rule)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type)
              for n, c in ((f.name, columns[f.name]) for f in schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def in_parts(batches: Iterator[pa.RecordBatch], column: str,
             limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``limit`` bytes of a binary column (one row at least)."""
    from tracefold.llm.textcore import column_bytes, pieces
    for batch in batches:
        _, offsets = column_bytes(batch.column(column))
        for first, last in pieces(offsets, limit):
            yield batch.slice(first, last - first)


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of equal keys together; the rows come sorted by numeric keys without nulls."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        named = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((named[1:] != named[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if held and last != tuple(named[s]):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            last = tuple(named[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
