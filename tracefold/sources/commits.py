"""Folders of Parquet files that become visible by a small manifest written last.

Every write goes to a folder of its own version; a commit lists the folders that hold a table
from then on, so readers see whole commits only, a lost executor or a failed job leaves the
last commit as it was, and a write whose token is known already is not added twice.  Tables
dealt into buckets are replaced bucket by bucket: a commit names new folders for the touched
buckets and keeps the others.  One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64
MANIFEST = "kind string, bucket int, version string, token string"


def bucket_of(*keys: str, buckets: int = BUCKETS) -> Column:
    """Bucket of the first key that is not null."""
    return F.pmod(F.xxhash64(F.coalesce(*keys)), F.lit(buckets)).cast("int")


def last_commit(spark: SparkSession, root: str) -> tuple[int, list[tuple]]:
    """Number and entries (kind, bucket, version, token) of the last commit; 0 and none at first.

    One entry per bucket and per append: the list grows with commits, never with rows.
    """
    try:
        table = spark.read.schema(f"{MANIFEST}, commit long").option("basePath", f"{root}/commits").json(
            f"{root}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, []
    number = table.agg(F.max("commit")).first()[0]
    rows = table.where(F.col("commit") == number).select("kind", "bucket", "version", "token").collect()
    return number or 0, [tuple(r) for r in rows]


def commit(spark: SparkSession, root: str, number: int, entries: list[tuple]) -> None:
    """Write commit ``number``; fails when another writer was there first."""
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("errorifexists").json(
        f"{root}/commits/commit={number}")


def new_version() -> str:
    return uuid.uuid4().hex


def written_buckets(spark: SparkSession, folder: str) -> list[int]:
    """Buckets that a partitioned write made; at most as many as there are buckets."""
    return [r[0] for r in spark.read.parquet(folder).select("bucket").distinct().collect()]


def read_kind(spark: SparkSession, root: str, kind: str, schema: str, entries: list[tuple],
              buckets: list[int] | None = None) -> DataFrame:
    """Committed rows of one table, of some buckets or of all; other folders are not opened."""
    folders = [f"{root}/{kind}/version={version}" + ("" if bucket is None else f"/bucket={bucket}")
               for name, bucket, version, _ in entries
               if name == kind and (buckets is None or bucket is None or bucket in buckets)]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/{kind}").parquet(*folders)


def append(rows: DataFrame, root: str, kind: str, token: str | None = None) -> bool:
    """Add rows to a table; False when ``token`` was committed before (a repeated batch)."""
    spark = rows.sparkSession
    number, entries = last_commit(spark, root)
    if token is not None and any(e[0] == kind and e[3] == token for e in entries):
        return False
    version = new_version()
    rows.write.parquet(f"{root}/{kind}/version={version}")
    commit(spark, root, number + 1, [*entries, (kind, None, version, token)])
    return True
