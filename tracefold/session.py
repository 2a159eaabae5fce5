"""Session construction and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Binary content goes to Arrow tasks in byte-bounded batches, so a run of
    # large files cannot build one huge batch.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8,
                  memory: str = "12g") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("tracefold")
               .config("spark.sql.shuffle.partitions", str(partitions))
               .config("spark.driver.memory", memory))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tracefold-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before "
                           "running iterative operators on a cluster")


#: Whether shuffle files go when the query that wrote them has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the queries run inside go when these end.

    Otherwise they stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read on from there.

    Results that must not change when a task is retried (partition ids, loop
    frontiers) go through this, so a lost executor costs one re-read.  A written
    table also has a known size, so later joins are planned on real numbers.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def among(df: DataFrame, keys: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of ``df`` whose ``key`` occurs in ``keys``, a table of that column alone.

    A semi join stays above a projection over a window; an IN predicate goes down to the scan
    when windows and aggregates below it are by the key, so other groups are not sorted at all.
    """
    return df.where(F.col(key).isin(keys.select(key)))


def cut_counted(df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
    """:func:`cut`, and the number of written rows (meeting ``condition``).

    The count reads the written table, so nothing is computed twice.  (A metric
    observed during the write would leave a manager in the session that the
    models of ``pyspark.ml`` cannot be shipped with.)
    """
    table = cut(df)
    return table, (table if condition is None else table.where(condition)).count()


def shuffle_partitions(spark: SparkSession) -> int:
    """The configured number of shuffle partitions.

    Given to a repartition it is kept: adaptive execution would merge them into as many tasks as
    there are cores, whose rows, and so memory, grow with the table.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_bucketed(df: DataFrame, keys: list[str], buckets: int | None = None,
                 placed: bool = False) -> DataFrame:
    """:func:`cut` into buckets by ``keys``: joins on them read the table without a shuffle.

    The number of buckets is that of shuffle partitions, so rows that are shuffled by the
    same keys meet the table as it lies; each bucket is one file, written by one task.
    ``placed`` rows come repartitioned by the keys already and are not moved again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    count = buckets or shuffle_partitions(spark)
    name = f"cut_{uuid.uuid4().hex}"
    rows = df if placed else df.repartition(count, *keys)
    with shuffles_dropped(spark):
        (rows.write.format("parquet").bucketBy(count, *keys)
         .option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}").saveAsTable(name))
    return spark.table(name)


def without(df: DataFrame, pieces: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys are in none of the bucketed ``pieces``; only ``df`` is shuffled."""
    for piece in pieces:
        df = df.join(piece.select(*keys).hint("merge"), keys, "left_anti")
    return df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for costly row work on an input with few partitions.

    A table of many files has more partitions than cores and stays as it is.
    ``df`` has to be a plain scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores, key)
