"""Content as rows of bounded size: (file_id, chunk, offset, n, bytes).

A chunk owns ``n`` bytes from ``offset`` and carries up to ``overlap`` bytes of what follows, so
that patterns and windows that cross a border are seen once, where they begin.  Files larger
than one cell can hold exist in this form only.
"""

from __future__ import annotations

from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracefold.session import cut_bucketed
from tracefold.sources.files import file_name, wanted

CHUNK = 1 << 20
OVERLAP = 512
CHUNK_SCHEMA = "file_id long, chunk long, offset long, n long, bytes binary"


def ranges(sized: DataFrame, size: int) -> DataFrame:
    """One row per chunk of every file of ``sized`` (a column ``size``); an empty file has one."""
    last = F.greatest(F.ceil(F.col("size") / size) - 1, F.lit(0))
    return sized.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))) \
        .withColumn("offset", F.col("chunk") * size) \
        .withColumn("n", F.least(F.col("size") - F.col("offset"), F.lit(size)).cast("long"))


def chunked(files: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of a content table (file_id, content); null content counts as empty.  No shuffle."""
    content = F.coalesce("content", F.expr("unhex('')"))
    part = F.expr(f"substring(content, cast(offset + 1 as int), cast(n + {overlap} as int))")
    rows = files.select("file_id", content.alias("content"), F.octet_length(content).cast("long").alias("size"))
    return ranges(rows, size).select("file_id", "chunk", "offset", "n", part.alias("bytes"))


def opened(path: str) -> tuple[FileSystem, str]:
    """File system and place of a path as Spark gives it (``file:/x``, ``hdfs://host/x``, ...)."""
    if path.startswith("file:"):
        return LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(quote(path, safe=":/"))


def read_chunks(spark: SparkSession, folder: str, size: int = CHUNK, overlap: int = OVERLAP,
                extensions: list[str] | None = None) -> DataFrame:
    """(path, chunk, offset, n, bytes) of the files of a folder, of any length.

    Spark lists the files and deals out ranges; every task reads its ranges through Arrow's
    file systems, so no file is ever one value.
    """
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
              .select("path", F.col("length").alias("size")).where(wanted(file_name(F.col("path")), extensions)))
    parts = ranges(listed, size).repartition("path", "chunk").select("path", "chunk", "offset", "n")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, place = opened(row["path"])
                with system.open_input_file(place) as file:
                    file.seek(row["offset"])
                    content = file.read(row["n"] + overlap)
                yield pa.RecordBatch.from_pylist([{**row, "bytes": content}], schema=schema)

    schema = pa.schema([("path", pa.string()), ("chunk", pa.int64()), ("offset", pa.int64()), ("n", pa.int64()),
                        ("bytes", pa.binary())])
    return parts.mapInArrow(run, CHUNK_SCHEMA.replace("file_id long", "path string"))


def chunk_store(chunks: DataFrame) -> DataFrame:
    """Chunks written once in buckets: later, byte ranges come to the content and not the other way."""
    return cut_bucketed(chunks, ["file_id", "chunk"])
