"""Benchmark decontamination by winnowing.

A span of ``span`` words holds ``span - k + 1`` word k-grams; the smallest of their hashes
(the last one on ties) is its fingerprint.  Equal spans have equal fingerprints wherever
they stand, so joining fingerprints of documents with those of the benchmark finds every
shared span.  Documents send a fingerprint only when it hits a bitmap of the benchmark
fingerprints; the bitmap has a fixed size, so what is broadcast does not grow, and false
hits fall out in the join.  Each hit carries the hash of the whole span around it (the
extension to full length), and the join is on fingerprint and span together, so a frequent
fingerprint never multiplies rows.  Spans in many documents are joined by salted keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracefold.llm.common import batch_of, cut, keyed, signed
from tracefold.llm.textcore import U64, column_bytes, grams, lists, mix, pieces, row_of, words

SPAN = 10
GRAM = 5
#: Bits of the fixed fingerprint bitmap (1 MB) and the salt that spreads frequent spans.
BITMAP_BITS = 23
SALTS = 16

SPANS = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())),
                   ("sizes", pa.list_(pa.int32())), ("prints", pa.list_(pa.int64())),
                   ("spans", pa.list_(pa.int64()))])
SPANS_DDL = ("row long, n_words long, starts array<int>, sizes array<int>, "
             "prints array<long>, spans array<long>")


def winnow(hashes: np.ndarray, span: int, k: int) -> np.ndarray:
    """Fingerprint of every span of ``span`` words, by the index of its first word."""
    small = grams(hashes, k)
    w = span - k + 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    best = np.full(n, ~U64(0))
    for j in range(w):  # the low bits make the last of equal k-grams win
        np.minimum(best, (small[j:j + n] & ~U64(63)) | U64(w - 1 - j), out=best)
    return mix(best & ~U64(63))  # minima are not even; slots and partitions should be


def slot(prints: np.ndarray) -> np.ndarray:
    return (prints >> U64(64 - BITMAP_BITS)).astype(np.int64)


def span_rows(span: int, k: int, shorter: list[int], bitmap: bytes | None, whole_items: bool):
    """One row per text with its spans (of benchmark items: all; of documents: bitmap hits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap, np.uint8)).astype(bool)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            ids = batch.column("row").to_numpy()
            for first, last in pieces(offsets):
                o = offsets[first:last + 1]
                hashes, bounds = words(data[o[0]:o[-1]], o - o[0])
                count, row = np.diff(bounds), row_of(bounds)
                found = []
                for size in [span, *shorter]:
                    spans = grams(hashes, size)
                    prints = winnow(hashes, span, k) if size == span else spans
                    if not len(spans):
                        continue
                    inside = row[:len(spans)] == row[size - 1:]
                    if whole_items and size < span:  # a short item is one span
                        inside &= count[row[:len(spans)]] == size
                    if table is not None:
                        inside &= table[slot(prints)]
                    at = np.flatnonzero(inside)
                    found.append((row[at], at - bounds[row[at]], np.full(len(at), size), prints[at], spans[at]))
                r, s, z, p, h = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 5
                order = np.argsort(r, kind="stable")
                per = np.bincount(r, minlength=last - first)
                yield batch_of(SPANS, row=ids[first:last], n_words=count.astype(np.int64),
                               starts=lists(s[order].astype(np.int32), per, pa.int32()),
                               sizes=lists(z[order].astype(np.int32), per, pa.int32()),
                               prints=lists(signed(p[order].astype(np.uint64)), per, pa.int64()),
                               spans=lists(signed(h[order].astype(np.uint64)), per, pa.int64()))
    return run


def unrolled(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.explode(F.arrays_zip("starts", "sizes", "prints", "spans")).alias("x")).select(
        "row", F.col("x.starts").alias("start"), F.col("x.sizes").alias("size"),
        F.col("x.prints").alias("print"), F.col("x.spans").alias("span"))


def bitmap_of(prints: DataFrame) -> bytes:
    """Fixed-size bitmap of the fingerprints; 2**BITMAP_BITS bits whatever the benchmark holds."""
    slots = (prints.select(F.shiftrightunsigned("print", 64 - BITMAP_BITS).cast("int").alias("s"))
             .groupBy(F.shiftright("s", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, s & 63)")).alias("bits")))
    bits = np.zeros(1 << BITMAP_BITS, dtype=np.uint8)
    for word, value in slots.collect():  # at most 2**(BITMAP_BITS - 6) rows
        at = np.flatnonzero((np.uint64(value & (1 << 64) - 1) >> np.arange(64, dtype=np.uint64)) & U64(1))
        bits[word * 64 + at] = 1
    return np.packbits(bits).tobytes()


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN,
                   k: int = GRAM) -> DataFrame:
    """(doc_id, tag, n_words, hits, items, unnamed): word ranges that benchmark items cover.

    ``hits`` lists (start, size) of the spans found and ``items`` the ids of the items.
    Rows with a null ``item_id`` hit like any other; ``unnamed`` says that one of them did,
    as ``items`` holds no null.
    Texts that are null or without words have no spans; an item shorter than ``span``
    words is one span of its own; repeated rows are answered each.
    """
    items = cut(benchmark.select(
        F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("string").alias("item"),
        F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text")))
    item_spans = cut(unrolled(items.select("row", "text").mapInArrow(
        span_rows(span, k, list(range(1, span)), None, True), SPANS_DDL))
        .join(items.select("row", "item"), "row")
        .select("item", "size", "print", "span").distinct())
    shorter = sorted(r["size"] for r in item_spans.where(F.col("size") < span)
                     .select("size").distinct().collect())  # below ``span`` values
    bitmap = bitmap_of(item_spans)

    # Spans held by the same items share a set number, so a document meets each set once.
    sets = item_spans.groupBy("print", "span", "size").agg(
        F.bit_xor(F.xxhash64("item")).alias("a"), F.bit_xor(F.xxhash64(F.lit(7), "item")).alias("b"),
        F.count("*").alias("c"))
    sets = cut(sets.withColumn("set", F.xxhash64("a", "b", "c")).select("print", "span", "size", "set"))
    members = item_spans.join(
        sets.groupBy("set").agg(F.min_by(F.struct("print", "span", "size"),
                                         F.struct("span", "print", "size")).alias("s"))
        .select("set", "s.*"), ["print", "span", "size"]).select("set", "item")

    source = keyed(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "tag", "text")
    tags = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), *SPANS])

    def with_ids(batches):
        inner = span_rows(span, k, shorter, bitmap, False)
        for batch in batches:
            at = 0
            for out in inner([batch]):
                part = batch.slice(at, out.num_rows)
                at += out.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tag"), *out.columns], schema=tags)

    found = cut(source.mapInArrow(with_ids, "doc_id long, tag long, " + SPANS_DDL))
    salted = unrolled(found.where(F.size("starts") > 0)).withColumn(
        "salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
    spread = sets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = cut(salted.join(spread, ["print", "span", "size", "salt"])
               .groupBy("row").agg(F.collect_list(F.struct("start", "size")).alias("hits"),
                                   F.collect_set("set").alias("sets")))
    per_doc = (hits.select("row", F.explode("sets").alias("set"))
               .join(members, "set").groupBy("row").agg(F.collect_set("item").alias("items"),
                                                   F.max(F.col("item").isNull()).alias("unnamed")))
    return (found.select("row", "doc_id", "tag", "n_words")
            .join(hits.select("row", "hits"), "row", "left").join(per_doc, "row", "left"))


def covered():
    """Number of words inside any hit: ranges are sorted and their fresh ends added up."""
    return F.aggregate(
        F.sort_array("hits"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["size"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(a["end"], x["start"]))
             ).cast("long").alias("n")),
        lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """Per document the words hit and the items found; see :func:`benchmark_hits`.

    As in the SQL, null item ids together count as one item in ``n_items`` and add nothing
    to the list behind ``items_sha256``.  Null and empty texts have no words; very long texts are
    read in whole; repeated rows are answered each; empty tables give no rows or no hits; columns
    other than ids and texts are ignored.
    """
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return benchmark_hits(docs, benchmark, span, k).select(
        "doc_id", "n_words", F.coalesce(covered(), F.lit(0)).cast("long").alias("n_hit"),
        (F.size(items) + F.coalesce(F.col("unnamed").cast("int"), F.lit(0))).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(items), ",").cast("binary"), 256).alias("items_sha256"),
        F.col("hits").isNotNull().alias("contaminated"))


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '{WORD}') AS w FROM benchmark),
bs AS (
  SELECT DISTINCT item_id, least(len(w), {SPAN}) AS z, w[i:i + least(len(w), {SPAN}) - 1] AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {SPAN - 1}, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT z FROM bs),
ds AS (
  SELECT doc_id, i, z, w[i:i + z - 1] AS s
  FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM dw, sizes WHERE len(w) >= z)),
hit AS (SELECT ds.doc_id, ds.i, ds.z, bs.item_id FROM ds JOIN bs ON ds.z = bs.z AND ds.s = bs.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + z)) AS p FROM (SELECT DISTINCT doc_id, i, z FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS l
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""
