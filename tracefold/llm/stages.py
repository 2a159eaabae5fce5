"""Operators applied to a documents table as a whole: rows in, rows of the same columns out.

A row travels as one struct column beside the keys an operator needs, so extra columns of any
name pass through unchanged.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tracefold.llm import bpe, decontaminate, line_dedup, minhash_dedup, quality
from tracefold.llm.common import NO_ID


def carried(docs: DataFrame) -> DataFrame:
    """(row, id, tag): the row as a struct, with the keys that operators answer by."""
    return docs.select(F.struct("*").alias("row"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tag"))


def good_quality(docs: DataFrame, labels: DataFrame,
                 settings: quality.Settings = quality.Settings()) -> DataFrame:
    """Rows that the quality classifier does not reject; all rows when it has no labels."""
    model = quality.fit(docs, labels, settings)
    ddl = f"row {docs.select(F.struct('*').alias('row')).schema['row'].dataType.simpleString()}"

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            plain = pa.RecordBatch.from_arrays(
                [row.field(row.type.get_field_index(n)).cast(t) for n, t in
                 (("text", pa.binary()), ("source", pa.string()), ("lang", pa.string()))],
                names=["text", "source", "lang"])
            for first, last, text, page in quality.views(plain):
                keep = model.score(text, page)[2] >= settings.reject
                yield pa.RecordBatch.from_arrays(
                    [row.slice(first, last - first).filter(pa.array(keep))], names=["row"])

    return docs.select(F.struct("*").alias("row")).mapInArrow(run, ddl).select("row.*")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """Rows with their repeated long lines dropped; ``n_chars`` follows the text."""
    ddl = f"row {docs.select(F.struct('*').alias('row')).schema['row'].dataType.simpleString()}, kept string"

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            texts = row.field(row.type.get_field_index("text")).cast(pa.binary()).to_pylist()
            kept = [t if b is None else line_dedup.kept_text(t or b"", b)[2]
                    for t, b in zip(texts, batch.column("dropped").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "kept"])

    bitmaps = line_dedup.drop_bitmaps(docs).hint("shuffle_hash")
    changed = carried(docs).join(bitmaps, ["id", "tag"], "left").select("row", "dropped").mapInArrow(run, ddl)
    return changed.select(*[
        F.col("kept").alias("text") if c == "text" else
        F.coalesce(F.length("kept"), F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else
        F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Rows of the documents that near-duplicate detection keeps; of equal rows one."""
    found = minhash_dedup.minhash_dedup(docs).where("kept").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "tag", "grouped").distinct()
    first = F.row_number().over(W.partitionBy("id", "tag").orderBy(F.lit(1)))
    return (carried(docs).join(found.hint("shuffle_hash"), ["id", "tag"]).withColumn("nth", first)
            .where((F.col("nth") == 1) | ~F.col("grouped")).select("row.*"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows without a span of the benchmark."""
    hit = (decontaminate.benchmark_hits(docs, benchmark).where(F.col("hits").isNotNull())
           .select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "tag").distinct())
    return carried(docs).join(hit.hint("shuffle_hash"), ["id", "tag"], "left_anti").select("row.*")


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): token ids of each text and what they decode to."""
    return bpe.round_trip(docs, path)
