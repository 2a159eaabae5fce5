"""File listings, dataset statistics and batch summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracefold import rules
from tracefold.operators.identity import suffix
from tracefold.operators.ordering import number_rows


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def wanted(name: Column, extensions: list[str] | None = None) -> Column:
    """Visible files that are no graph output, optionally of given extensions."""
    ext = suffix(name)
    keep = ~F.startswith(name, F.lit(".")) & ~ext.isin(rules.SKIPPED_SUFFIXES)
    if extensions:
        bare = [e.lower().lstrip(".") for e in extensions]
        keep = keep & F.regexp_replace(F.lower(ext), r"^\.", "").isin(bare)
    return keep


def read_files(spark: SparkSession, folder: str, recursive: bool = True,
               extensions: list[str] | None = None) -> DataFrame:
    """Content table of a folder; filtered listings never read skipped content."""
    files = (spark.read.format("binaryFile")
             .option("recursiveFileLookup", str(recursive).lower()).load(folder))
    listed = files.select("path", file_name(F.col("path")).alias("name"), "content",
                          F.col("length").alias("size"), "modificationTime")
    return listed.where(wanted(F.col("name"), extensions))


def scan_files(listing: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """The same filter over a listing table (path, name, size, ...)."""
    return listing.where(wanted(F.col("name"), extensions))


def number_files(files: DataFrame) -> DataFrame:
    """Stable index by sorted path, and its six-digit name."""
    keys = files.select("path")
    index = F.col("file_index").cast("string")
    return number_rows(keys, ["path"], None, "file_index").withColumn(
        "index_name", F.when(F.length(index) < 6, F.lpad(index, 6, "0")).otherwise(index))


def dataset_stats(listing: DataFrame) -> DataFrame:
    """Files and bytes by extension and in total (``ext`` is ``(all)``)."""
    visible = listing.where(~F.startswith("name", F.lit(".")))
    ext = F.lower(suffix(F.col("name")))
    return (visible.select(F.when(ext == "", "(none)").otherwise(ext).alias("ext"), "size")
            .rollup("ext").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
            .select(F.coalesce("ext", F.lit("(all)")).alias("ext"), "files", "bytes",
                    (F.col("bytes") / (1024 * 1024)).alias("megabytes")))


def top_extensions(listing: DataFrame, limit: int = 20) -> DataFrame:
    return (dataset_stats(listing).where(F.col("ext") != "(all)")
            .orderBy(F.desc("files"), "ext").limit(limit))


def batch_outcomes(results: DataFrame) -> DataFrame:
    """Success and error text per file; an empty graph is a failure."""
    missing, empty = F.col("num_nodes").isNull(), F.col("num_nodes") == 0
    error = F.coalesce("error", F.when(missing, "CPG generation returned None")
                       .when(empty, "Empty CPG (0 nodes)"))
    return results.select("path", error.alias("error"), error.isNull().alias("success"))


def batch_summary(results: DataFrame, elapsed_seconds: float | None = None) -> DataFrame:
    """Totals of a batch; failed paths with their errors are in
    :func:`batch_outcomes`, one row each."""
    totals = batch_outcomes(results).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"))
    if elapsed_seconds is None:
        return totals
    return totals.withColumn("files_per_second",
                             F.col("total") / F.lit(max(elapsed_seconds, 0.001)))
