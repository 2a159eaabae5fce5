"""Ingestion of new uploads into the store.

Stored rows lie in buckets by the first digits of their hash, each file with a Bloom filter on
the hash.  A batch looks into the buckets of its own hashes only, and there reads one column.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tracefold.functions.bytes import byte_entropy
from tracefold.operators.features import content_hash
from tracefold.operators.identity import identify, route
from tracefold.session import cut
from tracefold.sources.files import file_name, wanted

INGEST_SCHEMA = ("sha256 string, path string, name string, size bigint, file_type string, "
                 "category string, route string, entropy double, status string, "
                 "stream string, batch_id bigint, bucket string")
#: First digits of the hash that name a bucket; rows without a hash have one of their own.
DIGITS = 2
NO_HASH = "none"
BLOOM = {"parquet.bloom.filter.enabled#sha256": "true", "parquet.bloom.filter.expected.ndv#sha256": "20000"}


def read_upload_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = (spark.readStream.format("binaryFile").schema(schema)
             .option("recursiveFileLookup", "true").load(folder))
    return files.select("path", file_name(F.col("path")).alias("name"),
                        F.col("length").alias("size"), "content").where(wanted(F.col("name")))


def analysed(batch: DataFrame) -> DataFrame:
    """Hash, type, route and entropy of a batch; the content itself goes no further."""
    return (route(identify(batch.withColumn("sha256", content_hash(F.col("content")))))
            .withColumn("entropy", F.round(byte_entropy("content"), 4)).drop("content"))


def new_rows(found: DataFrame, known: DataFrame) -> DataFrame:
    """Analysed rows whose content is not known, the first path of each content.

    A file without content, null or empty, is recorded as failed.
    """
    firsts = (found.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("path").alias("path"))
              .join(known.select("sha256").distinct(), "sha256", "left_anti"))
    rows = found.join(firsts, ["sha256", "path"], "left_semi").unionByName(found.where("sha256 IS NULL"))
    own = ["bucket"] if "bucket" in found.columns else []
    return rows.select(
        "sha256", "path", "name", "size", "file_type", "category", "route", "entropy",
        F.when(F.coalesce("size", F.lit(0)) == 0, "failed").otherwise("completed").alias("status"), *own)


def analyse_new(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Identified rows of a batch whose content is not in the store.

    Only hashes meet the store.  Everything read from the content is found before the hashes
    are joined, so the content itself stays where it is.
    """
    return new_rows(analysed(batch), known)


def bucketed(rows: DataFrame, digits: int = DIGITS) -> DataFrame:
    return rows.withColumn("bucket", F.coalesce(F.substring("sha256", 1, digits), F.lit(NO_HASH)))


def known_rows(spark: SparkSession, store: str, buckets: list[str], stream: str, batch_id: int) -> DataFrame:
    """Stored rows of the given buckets, but for those that this batch or a later one wrote."""
    again = (F.col("stream") == stream) & (F.col("batch_id") >= batch_id)
    return read_store(spark, store).where(F.col("bucket").isin(buckets) & ~again)


def ingest_batch(batch: DataFrame, store: str, stream: str, batch_id: int, digits: int = DIGITS) -> list[str]:
    """Store the new uploads of a batch; the buckets that were looked into.

    The batch owns the folder of its stream and number and overwrites it, so a repeated batch
    writes the same rows again instead of doubling them.  A store keeps to one ``digits``.
    """
    spark = batch.sparkSession
    found = cut(bucketed(analysed(batch), digits))
    buckets = [r[0] for r in found.select("bucket").distinct().collect()]  # at most 16 ** DIGITS + 1
    rows = new_rows(found, known_rows(spark, store, buckets, stream, batch_id))
    (rows.repartition("bucket").sortWithinPartitions("bucket", "sha256").write.options(**BLOOM)
     .mode("overwrite").partitionBy("bucket").parquet(f"{store}/stream={stream}/batch_id={batch_id}"))
    return buckets


def ingest_stream(uploads: DataFrame, store: str, checkpoint: str,
                  available_now: bool = True) -> StreamingQuery:
    """Store every new upload once.

    The stream is known by the id that Spark keeps in the checkpoint: a new checkpoint never
    writes into the folders of an earlier one.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"]
        ingest_batch(batch, store, stream, batch_id)

    writer = uploads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """Stored rows; a store without batches is empty."""
    try:
        return spark.read.schema(INGEST_SCHEMA).option("basePath", store).parquet(store)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INGEST_SCHEMA)
