"""Line dedup: hash ranges with secondary order, streamed, answered by bitmaps.

Every long line becomes a row (128-bit key hash, document, position).  The rows are
range-partitioned by (key, document descending) and sorted; one pass streams each
partition, so the first document met for a key is the one that keeps it.  Because the
range also runs over the document, a key that fills a third of the table is spread over
many partitions; a partition then decides all inner keys alone, and only the two keys at
its edges wait for a summary of one row per edge (two rows per partition, so its size is
bounded by the number of partitions).  Documents get back one compressed bitmap of lines.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tracefold.llm.common import batch_of, cut, keyed, signed

#: Code points a line needs to be compared, and documents that must hold it.
MIN_CHARS = 40
MIN_DOCS = 5
BLANK = b" \t\n\x0b\x0c\r"

LINES = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("id", pa.int64()),
                   ("tag", pa.int64()), ("pos", pa.int32())])
DECIDED = pa.schema([("kind", pa.int8()), ("hi", pa.int64()), ("lo", pa.int64()),
                     ("part", pa.int32()), ("docs", pa.int64()), ("first", pa.int64()),
                     ("id", pa.int64()), ("tag", pa.int64()), ("pos", pa.int32())])
DROP, PENDING, EDGE = 0, 1, 2


def line_rows(min_chars: int):
    """Rows of the lines that are long enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            keys, counts, places = [], [], []
            for text in batch.column("text").to_pylist():
                before = len(keys)
                if len(text) >= min_chars:
                    for pos, line in enumerate(text.split(b"\n")):
                        if len(line) < min_chars:
                            continue
                        key = line.strip(BLANK).lower()  # bytes: A-Z only
                        if len(key) < 4 * min_chars and len(
                                key if key.isascii() else key.decode("utf-8", "replace")) < min_chars:
                            continue
                        keys.append(digest(key))
                        places.append(pos)
                counts.append(len(keys) - before)
            pairs = np.frombuffer(b"".join(keys), dtype=">u8").astype(np.uint64).reshape(-1, 2)
            yield batch_of(LINES, hi=signed(pairs[:, 0].copy()), lo=signed(pairs[:, 1].copy()),
                           id=np.repeat(batch.column("id").to_numpy(), counts),
                           tag=np.repeat(batch.column("tag").to_numpy(), counts),
                           pos=np.array(places, dtype=np.int32))
    return run


class Run:
    """The key that was last seen in a partition, with the state the stream needs."""

    def __init__(self, first: int, inner: bool):
        self.first, self.inner = first, inner  # inner: it began inside this partition
        self.docs, self.last = 0, None
        self.held: list[np.ndarray] = []       # rows while fewer than min_docs documents are known


def decide(min_docs: int):
    """Stream sorted rows: drops of inner keys, pending rows and summaries of edge keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key: tuple[int, int] | None = None
        state: Run | None = None

        def rows(kind: int, table: np.ndarray, first) -> pa.RecordBatch:
            n = len(table)
            return batch_of(DECIDED, kind=np.full(n, kind, np.int8), hi=table[:, 0], lo=table[:, 1],
                            part=np.full(n, part, np.int32), docs=np.zeros(n, np.int64),
                            first=np.broadcast_to(first, n).copy(), id=table[:, 2],
                            tag=table[:, 3], pos=table[:, 4].astype(np.int32))

        def edge() -> pa.RecordBatch:
            return batch_of(DECIDED, kind=[EDGE], hi=[key[0]], lo=[key[1]], part=[part],
                            docs=[state.docs], first=[state.first], id=[0], tag=[0], pos=[0])

        def extend(table: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Rows of the current key, in order."""
            ids = table[:, 2]
            new = np.count_nonzero(ids[1:] != ids[:-1]) + int(ids[0] != state.last or not state.docs)
            state.docs, state.last = state.docs + new, ids[-1]
            if not state.inner:
                yield rows(PENDING, table, state.first)
                return
            state.held.append(table)
            if state.docs >= min_docs:
                for held in state.held:
                    drop = held[held[:, 2] != state.first]
                    if len(drop):
                        yield rows(DROP, drop, state.first)
                state.held = []

        began = False
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch.column(c).to_numpy().astype(np.int64)
                              for c in ("hi", "lo", "id", "tag", "pos")], axis=1)
            change = np.flatnonzero((table[1:, 0] != table[:-1, 0]) | (table[1:, 1] != table[:-1, 1])) + 1
            starts = np.concatenate([[0], change])
            ends = np.concatenate([change, [len(table)]])
            begin = 0
            if key == (table[0, 0], table[0, 1]):
                yield from extend(table[:ends[0]])
                begin = 1
            if begin == len(starts):
                continue
            if state is not None and not state.inner:
                yield edge()
            last = len(starts) - 1
            if not began and begin == 0 and last > 0:  # the first key of the partition ends here
                key, state = (table[0, 0], table[0, 1]), Run(table[0, 2], False)
                yield from extend(table[:ends[0]])
                yield edge()
                begin = 1
            inner = table[starts[begin]:starts[last]] if begin < last else table[:0]
            if len(inner):
                heads = starts[begin:last] - starts[begin]
                fresh = np.concatenate([[True], inner[1:, 2] != inner[:-1, 2]])
                fresh[heads] = True
                docs = np.add.reduceat(fresh.astype(np.int64), heads)
                if (docs >= min_docs).any():
                    size = np.diff(np.concatenate([heads, [len(inner)]]))
                    first = np.repeat(inner[heads, 2], size)
                    drop = np.repeat(docs >= min_docs, size) & (inner[:, 2] != first)
                    if drop.any():
                        yield rows(DROP, inner[drop], first[drop])
            key = (table[starts[last], 0], table[starts[last], 1])
            state = Run(table[starts[last], 2], began or last > 0)
            began = True
            yield from extend(table[starts[last]:])
        if state is not None:
            for held in state.held:
                yield rows(PENDING, held, state.first)
            yield edge()
    return run


def pack(positions: list[int]) -> bytes:
    """Compressed bitmap of the dropped lines."""
    bits = np.zeros(max(positions) + 1, dtype=np.uint8)
    bits[positions] = 1
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack(bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).astype(bool)


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, tag, dropped): compressed bitmap of dropped lines, for documents that lose any."""
    text = keyed(docs)
    lines = cut(text.select("id", "tag", "text").mapInArrow(
        line_rows(min_chars), "hi long, lo long, id long, tag long, pos int"))
    streamed = (lines.repartitionByRange("hi", "lo", F.desc("id"))
                .sortWithinPartitions("hi", "lo", F.desc("id"), "tag", "pos")
                .mapInArrow(decide(min_docs), "kind byte, hi long, lo long, part int, docs long, "
                            "first long, id long, tag long, pos int"))
    decided = cut(streamed)
    edges = decided.where(F.col("kind") == EDGE)
    totals = edges.groupBy("hi", "lo").agg(F.sum("docs").alias("total"),
                                           F.max("first").alias("keeper"))
    pending = (decided.where(F.col("kind") == PENDING)
               .join(F.broadcast(totals), ["hi", "lo"])  # two rows per partition at most
               .where((F.col("total") >= min_docs) & (F.col("id") != F.col("keeper"))))
    drops = (decided.where(F.col("kind") == DROP).select("id", "tag", "pos")
             .unionByName(pending.select("id", "tag", "pos")))

    def bitmaps(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("tag"),
                 pa.array([pack(p) for p in batch.column("places").to_pylist()], pa.binary())],
                names=["id", "tag", "dropped"])

    # The lines of one document are bounded by its text, so a list per document is too.
    return (drops.groupBy("id", "tag").agg(F.collect_list("pos").alias("places"))
            .mapInArrow(bitmaps, "id long, tag long, dropped binary"))


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """Lines before dropping, lines dropped, and the text that stays."""
    if bitmap is None:
        return text.count(b"\n") + 1, 0, text
    lines, drop = text.split(b"\n"), unpack(bitmap)
    kept = [line for i, line in enumerate(lines) if i >= len(drop) or not drop[i]]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): documents without their repeated long lines.

    A key is a line without blanks at its ends and with A-Z in lower case.  Keys of
    ``min_chars`` code points in ``min_docs`` documents stay only in the largest doc_id.
    Null and empty texts are one empty line; a null doc_id counts as the smallest; rows
    that share a doc_id count as one document; every input row comes back.
    """
    def answer(batches):
        for batch in batches:
            got = [kept_text(t, b) for t, b in zip(batch.column("text").to_pylist(),
                                                   batch.column("dropped").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()),
                 pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())],
                names=["doc_id", "n_lines", "n_dropped", "text"])

    return (with_bitmaps(docs, min_chars, min_docs)
            .mapInArrow(answer, "doc_id long, n_lines long, n_dropped long, text binary"))


def with_bitmaps(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Keyed documents with their bitmap; the few bitmaps are the hashed side, texts only stream."""
    bitmaps = drop_bitmaps(docs, min_chars, min_docs)
    return keyed(docs).join(bitmaps.hint("shuffle_hash"), ["id", "tag"], "left")


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Counts and SHA-256 of the kept text per document, as :func:`line_dedup` leaves it.

    Null and empty texts are one empty line; a null ``doc_id`` counts as the smallest id; very
    long texts are one row; repeated rows are answered each; an empty table gives no rows.
    """
    def answer(batches):
        for batch in batches:
            got = [kept_text(t, b) for t, b in zip(batch.column("text").to_pylist(),
                                                   batch.column("dropped").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()),
                 pa.array([g[1] for g in got], pa.int64()),
                 pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return (with_bitmaps(docs, min_chars, min_docs)
            .mapInArrow(answer, "doc_id long, n_lines long, n_dropped long, kept_sha256 string"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents)),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= {MIN_CHARS}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (
  SELECT l.doc_id, l.pos, l.line, r.k IS NOT NULL AND l.doc_id <> r.keeper AS dropped
  FROM lines l LEFT JOIN repeated r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(dropped::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
