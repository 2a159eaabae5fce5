"""Token ids in ORC files: stripes, run-length encoded integers, indexes, Bloom filters.

Texts are range-partitioned and sorted by document once, encoded in that order and written
as they come, one file per range.  Each stripe holds a row index and a Bloom filter on
``doc_id``, so a reader opens stripes in parallel and skips those without a wanted document.
Every row knows its place in its file; the places of files are a sum over one row per file.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tracefold.llm.bpe import token_path
from tracefold.llm.common import keyed
from tracefold.llm.pretokens import Encoder
from tracefold.session import ensure_checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"
END = 0
OPTIONS = {"compression": "zstd", "orc.stripe.size": str(16 << 20), "orc.create.index": "true",
           "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id",
           "orc.bloom.filter.fpp": "0.01"}


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    return Encoder(lambda found: [e.ids for e in library.encode_batch_fast(found, add_special_tokens=False)],
                   spaced=True, special=special)


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int | None = END) -> None:
    """Write (doc_id, ids, n_tokens, file, place) in ascending ``doc_id`` order as ORC files.

    Null and empty texts hold the end id alone; null ids come first; rows sharing an id stay
    next to each other.  An empty table gives files without rows.
    """
    file = path or token_path(TOKENIZER)

    def run(batches):
        part, place = TaskContext.get().partitionId(), 0
        coder = encoder(file)
        for batch in batches:
            for first, last, ids, counts in coder.encode(batch.column("text")):
                if end is not None:
                    ids = np.insert(ids, np.cumsum(counts), end)
                    counts = counts + 1
                offsets = np.concatenate([[0], np.cumsum(counts)])
                n = last - first
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32())),
                     pa.array(counts, pa.int64()), pa.array(np.full(n, part, np.int32)),
                     pa.array(place + offsets[:-1], pa.int64())],
                    names=["doc_id", "ids", "n_tokens", "file", "place"])
                place += int(offsets[-1])

    ordered = (keyed(docs).repartitionByRange("id", "tag").sortWithinPartitions("id", "tag")
               .select("doc_id", "text"))
    (ordered.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, file int, place long")
     .write.options(**OPTIONS).orc(folder))


def read_tokens(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before."""
    rows = spark.read.schema("doc_id long, ids array<int>, n_tokens long, file int, place long").orc(folder)
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    bases = sizes.select("file", (F.sum("size").over(W.orderBy("file")) - F.col("size")).alias("base"))
    return rows.join(F.broadcast(bases), "file").select(  # one row per file
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


def token_rows(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from written files.

    Null and empty texts hold the end id alone; null ids come first, rows sharing an id next to
    each other in the order of their text's hash; very long texts are encoded in stretches; an
    empty table gives no rows, columns other than ``doc_id`` and ``text`` are ignored.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, path)

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            offsets = ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"),
                 pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, folder).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
