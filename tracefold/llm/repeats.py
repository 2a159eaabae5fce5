"""Removal of byte strings that repeat across documents, by prefix-free parsing.

Rolling-hash triggers cut the corpus into phrases: the smallest 20-byte hash of every
50-byte window is a trigger, so each window holds one, and equal windows hold it at the
same place.  What surrounds a trigger (30 bytes before, 50 from it on) is a dictionary
entry: it contains every window of that trigger.  The parse of a document is its sequence
of entries.  Two sorted exchanges replace the suffix array of the whole corpus:

1. Parse: trigger occurrences are sorted by (trigger, entry).  An entry that also occurs
   in a smaller document is removed whole.  Triggers with one entry, or in one document,
   are done; that is nearly all of the text.
2. Dictionary: the remaining entries (one occurrence each) give their windows, that is the
   50-byte prefixes of the suffixes starting there, and these are sorted the same way.

Only equality of 50-byte prefixes matters, so the order used is that of their hashes.
Sorting runs on packed blocks; before each exchange a task keeps one occurrence per key
and batch (that of its smallest document), so a passage in a third of all documents sends
one record per batch, and buckets are ranges of a hash.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tracefold.llm.common import batch_of, cut, in_parts, keyed, partitions
from tracefold.llm.textcore import PIECE, U64, column_bytes, lists, mix, pieces, prefix_hash, slice_hash

#: Length of a repeated string, of a trigger, and triggers' positions in a window.
LENGTH = 50
TRIGGER = 20
PLACES = LENGTH - TRIGGER + 1
#: Bytes of text whose occurrences are combined before they are sent.
PART = 8 << 20
#: Bytes looked at in one numpy pass (about forty times as much memory).
PASS = PIECE // 2
WHOLE, ASK, WINDOW = 0, 1, 2  # entry removed whole; entry to look into; window removed

SENT = pa.schema([("bucket", pa.int32()), ("block", pa.binary()), ("kind", pa.int8()),
                  ("id", pa.int64()), ("tag", pa.int64()), ("places", pa.list_(pa.int32()))])
SENT_DDL = "bucket int, block binary, kind byte, id long, tag long, places array<int>"
FOUND = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("tag", pa.int64()),
                   ("places", pa.list_(pa.int32()))])
FOUND_DDL = "kind byte, id long, tag long, places array<int>"


def chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """(first row, slice, row offsets in it, shift, first and last window start to look at).

    A text longer than a piece is cut into overlapping slices, so memory stays bounded.
    """
    for first, last in pieces(offsets, PASS):
        o = offsets[first:last + 1]
        if o[-1] - o[0] <= 2 * PASS:
            yield first, data[o[0]:o[-1]], o - o[0], 0, 0, int(o[-1] - o[0])
            continue
        for s in range(0, int(o[-1] - o[0]) - LENGTH + 1, PASS):
            low = max(0, s - PLACES)
            high = min(int(o[-1] - o[0]), s + PASS + 2 * LENGTH)
            yield (first, data[o[0] + low:o[0] + high], np.array([0, high - low]), low,
                   s - low, s - low + PASS)


def window_triggers(d: np.ndarray, o: np.ndarray, low: int, high: int):
    """Prefix hashes, window starts, the trigger position of each, and trigger hashes."""
    sums = prefix_hash(d)
    at = np.arange(max(0, len(d) - TRIGGER + 1))
    hashes = slice_hash(sums, at, at + TRIGGER)
    bits = U64((1 << 22) - 1)  # positions within a slice; the first of equal hashes wins
    best, size = (hashes & ~bits) | at.astype(np.uint64), 1
    while size * 2 <= PLACES:
        best = np.minimum(best[:max(0, len(best) - size)], best[size:])
        size *= 2
    if size < PLACES:
        best = np.minimum(best[:max(0, len(best) - (PLACES - size))], best[PLACES - size:])
    ends = np.zeros(len(d) + 1, np.int32)
    ends[o[1:-1]] += 1
    before = np.cumsum(ends)  # row number of each byte, plus empty rows
    starts = np.arange(low, min(high, len(best)))
    starts = starts[before[starts] == before[starts + LENGTH - 1]]
    return sums, starts, (best[starts] & bits).astype(np.int64), hashes


def parse(text: pa.Array):
    """(trigger, entry, row, position) of every trigger occurrence."""
    data, offsets = column_bytes(text)
    out = []
    for first, d, o, shift, low, high in chunks(data, offsets):
        sums, _, places, hashes = window_triggers(d, o, low, high)
        at = np.unique(places)
        row = np.searchsorted(o, at, "right") - 1
        left, right = np.maximum(o[row], at - PLACES + 1), np.minimum(o[row + 1], at + LENGTH)
        entry = slice_hash(sums, left, right) ^ ((at - left).astype(np.uint64) * U64(0xA24BAED4963EE407))
        out.append((mix(hashes[at]), mix(entry), row + first, at - o[row] + shift))  # minima are not even
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (
        np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def look_into(text: pa.Array, asked: list[np.ndarray]):
    """(window hash, row, start) of the windows whose trigger was asked for."""
    data, offsets = column_bytes(text)
    out = []
    for first, d, o, shift, low, high in chunks(data, offsets):
        wanted = np.zeros(len(d) + 1, dtype=bool)
        for row in range(len(o) - 1):
            at = asked[first + row] - shift + o[row]
            wanted[at[(at >= o[row]) & (at < o[row + 1])]] = True
        sums, starts, places, _ = window_triggers(d, o, low, high)
        starts = starts[wanted[places]]
        row = np.searchsorted(o, starts, "right") - 1
        out.append((slice_hash(sums, starts, starts + LENGTH), row + first, starts - o[row] + shift))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (
        np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def per_document(ids: np.ndarray, tags: np.ndarray, places: np.ndarray):
    """The places of each document as one list row."""
    order = np.lexsort((places, tags, ids))
    ids, tags, places = ids[order], tags[order], places[order]
    heads = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])) \
        if len(ids) else np.zeros(0, np.int64)
    return ids[heads], tags[heads], lists(places.astype(np.int32),
                                          np.diff(np.concatenate([heads, [len(ids)]])), pa.int32())


def encode(key, entry, ids, tags, places) -> bytes:
    """One block of occurrences, sorted by document and position; hashes stay as they are."""
    order = np.lexsort((places, tags, ids))
    ids, tags, places = ids[order], tags[order], places[order]
    heads = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]))
    small = np.concatenate([np.diff(np.concatenate([heads, [len(ids)]])).astype(np.uint32),
                            np.diff(places, prepend=0).astype(np.int64).astype(np.uint32)])
    packed = zstandard.ZstdCompressor(level=1).compress(
        np.diff(ids[heads], prepend=0).tobytes() + tags[heads].tobytes()
        + np.ascontiguousarray(small.view(np.uint8).reshape(-1, 4).T).tobytes())
    hashes = key[order].tobytes() + (b"" if entry is None else entry[order].tobytes())
    return struct.pack("<III", len(ids), len(heads), len(packed)) + packed + hashes


def decode(block: bytes, entries: bool):
    n, docs, size = struct.unpack_from("<III", block)
    raw = zstandard.ZstdDecompressor().decompress(block[12:12 + size])
    ids = np.cumsum(np.frombuffer(raw, np.int64, docs))
    tags = np.frombuffer(raw, np.int64, docs, 8 * docs)
    small = np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=16 * docs).reshape(4, -1).T)
    small = small.view(np.uint32).ravel()
    counts = small[:docs]
    places = np.cumsum(small[docs:].astype(np.int32), dtype=np.int64)
    body = np.frombuffer(bytes(block[12 + size:]), np.uint64)
    return (body[:n], body[n:] if entries else np.zeros(n, np.uint64),
            np.repeat(ids, counts), np.repeat(tags, counts), places)


def send(batch: pa.RecordBatch, key, entry, row, places, labels: np.ndarray,
         kind: int) -> Iterator[pa.RecordBatch]:
    """Blocks for the exchange, and what is already decided inside the batch."""
    ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
    same = key if entry is None else mix(key ^ mix(entry))
    owner = ids[row]
    order = np.lexsort((owner, same))
    heads = np.concatenate([[True], same[order][1:] != same[order][:-1]]) if len(order) else np.zeros(0, bool)
    least = owner[order][heads][np.cumsum(heads) - 1] if len(order) else owner
    again = np.zeros(len(order), bool)
    again[order] = owner[order] > least
    if again.any():
        i, t, p = per_document(owner[again], tags[row[again]], places[again])
        yield batch_of(SENT, bucket=labels[np.abs(i) % len(labels)].astype(np.int32),
                       block=pa.nulls(len(i), pa.binary()), kind=np.full(len(i), kind, np.int8),
                       id=i, tag=t, places=p)
    stay = np.flatnonzero(~again)
    bucket = (((key[stay] >> U64(32)) * U64(len(labels))) >> U64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    stay, bucket = stay[order], bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(stay) else []
    blocks, names = [], []
    for s, e in zip(heads, [*heads[1:], len(stay)]):
        part = stay[s:e]
        blocks.append(encode(key[part], None if entry is None else entry[part], owner[part],
                             tags[row[part]], places[part]))
        names.append(labels[bucket[s]])
    n = len(blocks)
    if n:
        yield batch_of(SENT, bucket=np.array(names, np.int32), block=pa.array(blocks, pa.binary()),
                       kind=np.zeros(n, np.int8), id=np.zeros(n, np.int64), tag=np.zeros(n, np.int64),
                       places=pa.nulls(n, pa.list_(pa.int32())))


def settle(entries: bool):
    """Sort the occurrences of a bucket range and tell documents what repeats."""
    def rows(kind, ids, tags, places):
        i, t, p = per_document(ids, tags, places)
        return batch_of(FOUND, kind=np.full(len(i), kind, np.int8), id=i, tag=t, places=p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            known = batch.filter(batch.column("block").is_null())
            if known.num_rows:
                yield known.select(["kind", "id", "tag", "places"])
            for block in batch.column("block").to_pylist():
                if block is not None:
                    got.append(decode(block, entries))
        if not got:
            return
        key, entry, ids, tags, places = (np.concatenate(x) for x in zip(*got))
        got.clear()
        order = np.argsort(key)  # most keys occur once and are done
        sorted_key = key[order]
        equal = sorted_key[1:] == sorted_key[:-1]
        order = order[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])]
        if not len(order):
            return
        order = order[np.lexsort((ids[order], entry[order], key[order]))]
        key, entry, ids, tags, places = key[order], entry[order], ids[order], tags[order], places[order]
        of_key = np.concatenate([[True], key[1:] != key[:-1]])
        of_entry = of_key | np.concatenate([[True], entry[1:] != entry[:-1]])
        least = ids[of_entry][np.cumsum(of_entry) - 1]
        again = ids > least
        if again.any():
            yield rows(WHOLE if entries else WINDOW, ids[again], tags[again], places[again])
        if entries:
            heads = np.flatnonzero(of_key)
            several = np.add.reduceat(of_entry.astype(np.int64), heads) > 1
            several &= np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads)
            ask = several[np.cumsum(of_key) - 1] & ~again
            if ask.any():
                yield rows(ASK, ids[ask], tags[ask], places[ask])
    return run


def exchange_labels(docs: DataFrame, count: int) -> np.ndarray:
    """One number per shuffle partition, so that equal hash ranges get a partition each."""
    spark = docs.sparkSession
    found = (spark.range(count * 24).select(F.col("id").cast("int").alias("n"))
             .groupBy(F.pmod(F.hash("n"), F.lit(count)).alias("p")).agg(F.min("n").alias("n"))
             .collect())  # one row per partition
    return np.array(sorted(r["n"] for r in found), dtype=np.int64)


def packed(text: DataFrame) -> DataFrame:
    """Texts compressed one by one: they are shuffled twice, and this halves what that writes."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array([pack(t) for t in batch.column("text").to_pylist()], pa.binary()))

    return text.mapInArrow(run, text.schema)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for whole in batches:
        for batch in in_parts(iter([whole]), "text", PART // 4):
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array([unpack(t) for t in batch.column("text").to_pylist()], pa.binary()))


def repeated_places(docs: DataFrame) -> DataFrame:
    """(id, tag, whole, window): triggers and windows to remove in each document that has any."""
    text = keyed(docs).select("id", "tag", "text")
    count = partitions(docs)
    labels = exchange_labels(docs, count)

    def first(batches):
        for batch in in_parts(batches, "text", PART):
            yield from send(batch, *parse(batch.column("text")), labels, WHOLE)

    def second(batches):
        for batch in in_parts(unpacked(batches), "text", PART):
            asked = [np.array(sorted({p for one in lists_ for p in one}), dtype=np.int64)
                     for lists_ in batch.column("asked").to_pylist()]
            key, row, places = look_into(batch.column("text"), asked)
            yield from send(batch, key, None, row, places, labels, WINDOW)

    parsed = cut(text.mapInArrow(first, SENT_DDL).repartition(count, "bucket")
                 .mapInArrow(settle(True), FOUND_DDL))
    asked = (parsed.where(F.col("kind") == ASK).groupBy("id", "tag")
             .agg(F.collect_list("places").alias("asked")))
    windows = cut(packed(text).join(asked.hint("shuffle_hash"), ["id", "tag"])
                  .mapInArrow(second, SENT_DDL).repartition(count, "bucket")
                  .mapInArrow(settle(False), FOUND_DDL))
    found = parsed.where(F.col("kind") == WHOLE).unionByName(windows)
    # All places of one document; bounded by the length of its text.
    return found.groupBy("id", "tag").agg(
        F.flatten(F.collect_list(F.when(F.col("kind") == WHOLE, F.col("places")))).alias("whole"),
        F.flatten(F.collect_list(F.when(F.col("kind") == WINDOW, F.col("places")))).alias("window"))


def removed_runs(n: int, whole: list[int] | None, window: list[int] | None) -> np.ndarray:
    """Maximal runs (start, end) of removed bytes of a text of ``n`` bytes."""
    at, starts = np.array(whole or [], np.int64), np.array(window or [], np.int64)
    left = np.concatenate([np.maximum(at - PLACES + 1, 0), starts])
    right = np.concatenate([np.minimum(at + LENGTH, n), starts + LENGTH])
    if not len(left):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(left)
    left, right = left[order], np.maximum.accumulate(right[order])
    fresh = np.concatenate([[True], left[1:] > right[:-1]])
    return np.stack([left[fresh], right[np.concatenate([fresh[1:], [True]])]], axis=1)


def remove_runs(text: bytes, runs: np.ndarray) -> bytes:
    if not len(runs):
        return text
    bounds = [0, *runs.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2]))


def without_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, text or kept_sha256).

    A byte goes when a 50-byte string covering it also starts in a document with a smaller
    doc_id; matches never cross documents and are judged on the input.  Null counts as an
    empty text, a null doc_id as the smallest id; rows sharing a doc_id do not remove from
    each other; every input row comes back.
    """
    last = "kept_sha256 string" if digest else "text binary"

    def answer(batches):
        for batch in unpacked(batches):
            got = []
            for text, whole, window in zip(*(batch.column(c).to_pylist() for c in ("text", "whole", "window"))):
                runs = removed_runs(len(text), whole, window)
                kept = remove_runs(text, runs)
                got.append((len(text), len(text) - len(kept), len(runs),
                            hashlib.sha256(kept).hexdigest() if digest else kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([g[i] for g in got], pa.int64()) for i in range(3)),
                 pa.array([g[3] for g in got], pa.string() if digest else pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", last.split()[0]])

    text = keyed(docs)
    return (packed(text).join(repeated_places(docs).hint("shuffle_hash"), ["id", "tag"], "left")
            .mapInArrow(answer, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}"))
