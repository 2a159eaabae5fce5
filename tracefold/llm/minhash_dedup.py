"""Near-duplicate documents by improved consistent weighted sampling.

A document is the weighted set of its shingles of five words.  The weight is a TF-IDF:
1 + ln(tf), times an idf between 1 (in every document) and ``1 + IDF`` (in less than the
share ``RARE``).  Document frequencies are counted over all documents in a fixed number of
hash cells, so the table that tasks read never grows, and relative to the number of
documents, so it means the same at every size.

ICWS draws ``BANDS * ROWS`` samples per document; two documents agree on one with the
probability of their weighted Jaccard similarity.  Documents that share a band are compared
by their exact weighted Jaccard with a few leaders of the band; in each round those that are
not in one component yet meet new leaders, so a group of any size costs a few comparisons
per member.  When rounds stop joining members, the bands of those left over are held in blocks
of bounded size: a task bounds the similarity of each of them to all members by one matrix
product, computes it exactly where the bound reaches the threshold, and returns the links
that join groups.  No link between documents that share a band is lost, no pair becomes a
row, and a band of several blocks sends a text once per block of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tracefold.llm.common import cut, in_parts, keyed, partitions, runs_of, signed
from tracefold.llm.components import components
from tracefold.llm.textcore import U64, column_bytes, grams, lists, mix, pieces, row_of, words

SHINGLE, SIMILARITY = 5, 0.8
#: Leaders that a member of a band meets in one round.
LEADERS = 4
BANDS, ROWS = 16, 4
CELLS, RARE, IDF = 20, 1e-3, 0.25
CELL_BLOCK = 1 << 12
#: Members and bytes of text of a band held together; above either it is split into blocks.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Columns of a matrix product; what its single precision may lack.
COLUMNS, SLACK = 1 << 12, 1e-4
_rng = np.random.default_rng(91)
_POOL = 1 << 16
_R = _rng.gamma(2, 1, _POOL).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2, 1, _POOL)).astype(np.float32)
_BETA = _rng.random(_POOL).astype(np.float32)
_INV_R = (1 / _R).astype(np.float32)
_ODD = _rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * U64(2) + U64(1)


def shingles(data: np.ndarray, offsets: np.ndarray):
    """(hash, tf, bounds, digest): sorted distinct shingles per row, and two hashes of its words.

    A text of one to four words is one shingle; a text without words has none.
    """
    hashes, bounds = words(data, offsets)
    row, count = row_of(bounds), np.diff(bounds)
    grown = grams(hashes, SHINGLE)
    inside = row[:len(grown)] == row[SHINGLE - 1:] if len(grown) else np.zeros(0, bool)
    h, r = grown[inside], row[:len(grown)][inside]
    at = bounds[:-1]
    place = (np.arange(len(hashes)) - at[row]).astype(np.uint64)
    total, other = np.zeros((2, len(hashes) + 1), np.uint64)
    np.cumsum(mix(hashes + place * U64(0x9E3779B97F4A7C15)), out=total[1:])
    np.cumsum(mix(hashes ^ mix(place + U64(77))), out=other[1:])
    digest = (mix(total[bounds[1:]] - total[at] + count.astype(np.uint64)), mix(other[bounds[1:]] - other[at]))
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    h, r = np.concatenate([h, digest[0][short]]), np.concatenate([r, short])
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, bool)
    heads = np.flatnonzero(fresh)
    tf = np.diff(np.append(heads, len(h)))
    return h[heads], tf, np.searchsorted(r[heads], np.arange(len(offsets))), digest


def cell(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - CELLS)).astype(np.int64)


def frequency_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per cell, summed over the partition, in compressed blocks."""
    counts = np.zeros(1 << CELLS, np.int64)
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        for first, last in pieces(offsets):
            o = offsets[first:last + 1]
            h, _, _, _ = shingles(data[o[0]:o[-1]], o - o[0])
            counts += np.bincount(cell(h), minlength=1 << CELLS)
    yield from frequency_rows(counts.reshape(-1, CELL_BLOCK), range((1 << CELLS) // CELL_BLOCK))


def frequency_rows(blocks, names) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    found = [(n, pack(b.astype(np.int64).tobytes())) for n, b in zip(names, blocks) if b.any()]
    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()),
                                      pa.array([f[1] for f in found], pa.binary())], names=["block", "counts"])


def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for name, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            got = np.frombuffer(unpack(raw), np.int64)
            sums[name] = sums[name] + got if name in sums else got
    yield from frequency_rows(list(sums.values()), list(sums))


def idf_table(texts: DataFrame, n_docs: int) -> bytes:
    """Compressed float32 idf of every cell; 2**CELLS values whatever the corpus."""
    rows = (texts.select("text").mapInArrow(frequency_blocks, "block int, counts binary")
            .repartition("block").mapInArrow(add_blocks, "block int, counts binary").collect())
    counts = np.zeros(1 << CELLS, np.int64)
    for row in rows:
        counts[row["block"] * CELL_BLOCK:(row["block"] + 1) * CELL_BLOCK] = np.frombuffer(
            zstandard.ZstdDecompressor().decompress(bytes(row["counts"])), np.int64)
    share = np.clip(counts / max(n_docs, 1), RARE, 1)
    idf = (1 + IDF * np.log(share) / np.log(RARE)).astype(np.float32)
    return zstandard.ZstdCompressor(level=1).compress(idf.tobytes())


def unpacked(idf: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(idf), np.float32)


def weights(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)).astype(np.float32) * idf[cell(h)]


def bands(h: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Band hashes (row × band) of rows that all have shingles."""
    starts, n = bounds[:-1], len(bounds) - 1
    log_s = np.log(weight).astype(np.float32)
    row = row_of(bounds)
    out = np.zeros((n, BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        at = ((h * _ODD[k]) >> U64(48)).astype(np.int64)
        beta, r = _BETA[at], _R[at]
        t = np.floor(log_s * _INV_R[at] + beta)
        a = _LOG_C[at] - r * (t - beta + 1)
        least = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == least[row])
        first = hit[np.searchsorted(row[hit], np.arange(n))]  # the smallest hash on ties
        sample = mix(h[first] ^ (t[first].astype(np.int64).view(np.uint64) * U64(0xC2B2AE3D27D4EB4F)))
        out[:, k // ROWS] = mix(out[:, k // ROWS] * U64(3) + sample + U64(k))
    return out


def signatures(idf: bytes):
    """(id, tag, node, other, bands): two hashes of the words and the band hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = unpacked(idf)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for first, last in pieces(offsets, 1 << 19):
                o = offsets[first:last + 1]
                h, tf, bounds, digest = shingles(data[o[0]:o[-1]], o - o[0])
                size = np.diff(bounds)
                full = np.flatnonzero(size > 0)
                found = np.zeros((0, BANDS), np.uint64)
                if len(full):
                    found = bands(h, weights(h, tf, table), np.append(bounds[:-1][full], bounds[-1]))
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("tag"), pa.array(signed(digest[0]), pa.int64()),
                     pa.array(signed(digest[1]), pa.int64()),
                     lists(signed(found.ravel()), np.where(size > 0, BANDS, 0), pa.int64())],
                    names=["id", "tag", "node", "other", "bands"])
    return run


def jaccard(sides: list, n: int) -> np.ndarray:
    """Exact weighted Jaccard of ``n`` pairs; a side is (pair, shingle, weight) of its texts."""
    row, h, w = (np.concatenate([side[k] for side in sides]) for k in range(3))
    w = w.astype(np.float64)
    total = np.bincount(row, w, minlength=n)
    order = np.lexsort((h, row))
    row, h, w = row[order], h[order], w[order]
    both = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
    shared = np.bincount(row[1:][both], np.minimum(w[1:], w[:-1])[both], minlength=n)
    return np.divide(shared, total - shared, out=np.zeros(n), where=total > shared)


def similarity(idf: bytes):
    """(a, b, similarity): exact weighted Jaccard of the two texts of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = unpacked(idf)
        for whole in batches:
            for batch in in_parts(iter([whole]), "left", 1 << 20):
                sides = []
                for name in ("left", "right"):
                    data, offsets = column_bytes(batch.column(name))
                    h, tf, bounds, _ = shingles(data, offsets)
                    sides.append((row_of(bounds), h, weights(h, tf, table)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a"), batch.column("b"), pa.array(jaccard(sides, batch.num_rows))],
                    names=["a", "b", "similarity"])
    return run


def highest(h: np.ndarray, w: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Upper bounds of the similarity of texts ``left`` × ``right``: roots of products are no less than minima."""
    names, column, count = np.unique(h, return_inverse=True, return_counts=True)
    common = np.flatnonzero(count > 1)  # a shingle of one text is in no intersection
    to = np.full(len(names), -1)
    to[common] = np.arange(len(common))
    column, row, root = to[column], row_of(bounds), np.sqrt(w)
    order = np.argsort(column, kind="stable")
    order = order[np.searchsorted(column[order], 0):]
    column, row, root = column[order], row[order], root[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, len(common), COLUMNS):
        s, e = np.searchsorted(column, (first, first + COLUMNS))
        part = np.zeros((len(bounds) - 1, min(COLUMNS, len(common) - first)), np.float32)
        part[row[s:e], column[s:e] - first] = root[s:e]
        shared += part[left] @ part[right].T
    total = np.bincount(row_of(bounds), w, minlength=len(bounds) - 1).astype(np.float32)
    total = total[left][:, None] + total[right][None, :]
    shared = np.minimum(shared, total / 2)
    return shared / (total - shared)


def joining(idf: bytes, threshold: float):
    """Rows sorted by (band, first block, second block) → links (a, b) that join their groups.

    A pair is of interest when one of the two is open and their roots differ; of the links
    between the same groups one is enough.
    """
    def solve(table, node, root, is_open, side, data, offsets) -> tuple[list[int], list[int]]:
        parts = [shingles(data[o[0]:o[-1]], o - o[0]) for s, e in pieces(offsets) for o in [offsets[s:e + 1]]]
        h = np.concatenate([p[0] for p in parts])
        w = weights(h, np.concatenate([p[1] for p in parts]), table)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
        _, root = np.unique(root, return_inverse=True)
        parent = np.arange(root.max() + 1)
        # side 0: the band is whole or a block meets itself; sides 1 and 2: pairs across two blocks
        one, two = (np.flatnonzero(side != 2), np.flatnonzero(side == 2)) if side.any() else (np.arange(len(node)),) * 2
        found: tuple[list[int], list[int]] = ([], [])
        met = [(one[is_open[one]], two)]
        if side.any():
            met.append((two[is_open[two]], one))
        for left, right in met:
            if not len(left) or not len(right):
                continue
            x, y = np.nonzero(highest(h, w, bounds, left, right) >= threshold - SLACK)
            x, y = left[x], right[y]
            # Groups are joined batch by batch, so later pairs inside one need no exact similarity.
            while len(x):
                apart = parent[root[x]] != parent[root[y]]
                x, y = x[apart], y[apart]
                i, j = x[:256], y[:256]
                if not len(i):
                    break
                sides = []
                for k in (i, j):
                    at = np.concatenate([np.arange(bounds[m], bounds[m + 1]) for m in k])
                    sides.append((np.repeat(np.arange(len(k)), np.diff(bounds)[k]), h[at], w[at]))
                for m in np.flatnonzero(jaccard(sides, len(i)) >= threshold):
                    p, q = parent[root[i[m]]], parent[root[j[m]]]
                    if p != q:
                        parent[parent == max(p, q)] = min(p, q)
                        found[0].append(max(node[i[m]], node[j[m]]))
                        found[1].append(min(node[i[m]], node[j[m]]))
                x, y = x[256:], y[256:]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = unpacked(idf)
        for rows in runs_of(batches, ["band", "one", "two"]):
            if rows.num_rows > 1:
                column = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
                a, b = solve(table, column("node"), column("root"), column("open"), column("side"),
                             *column_bytes(rows.column("text")))
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def joined(members: DataFrame, texts: DataFrame, idf: bytes, threshold: float) -> DataFrame:
    """Links (a, b) between groups of ``members`` (band, node, root, open) that share a band."""
    sized = members.join(texts.select("node", F.octet_length("text").alias("bytes")), "node")
    blocks = sized.groupBy("band").agg(F.ceil(F.greatest(
        F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("block", o).alias("one"), F.greatest("block", o).alias("two"),
        F.when(o == F.col("block"), 0).when(F.col("block") < o, 1).otherwise(2).alias("side")))
    dealt = (members.join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
             .withColumn("m", F.explode(others)).select("band", "node", "root", "open", "m.*"))
    return cut(dealt.join(texts, "node").repartition(partitions(texts), "band", "one", "two")
               .sortWithinPartitions("band", "one", "two").mapInArrow(joining(idf, threshold), "a long, b long"))


def compared(pairs: DataFrame, texts: DataFrame, idf: bytes) -> DataFrame:
    """Exact similarity of node pairs (a, b); texts of other nodes are not moved on."""
    return cut(pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
               .join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
               .mapInArrow(similarity(idf), "a long, b long, similarity double"))


def smallest(members: DataFrame, turn: int) -> DataFrame:
    """(band, leader): LEADERS members of each band, others in every round.

    The smallest of LEADERS hash classes, one aggregate that combines before the shuffle.
    """
    order = F.xxhash64(F.lit(turn), F.col("node"))
    pick = [F.min_by("node", F.when(F.pmod(order, F.lit(LEADERS)) == k, order)).alias(f"l{k}") for k in range(LEADERS)]
    return (members.groupBy("band").agg(*pick)
            .select("band", F.explode(F.array_distinct(F.array(*[f"l{k}" for k in range(LEADERS)]))).alias("leader"))
            .where("leader IS NOT NULL"))


def near_groups(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(id, tag, group): documents with shingles and a number of their group."""
    text = keyed(docs)
    idf = idf_table(text, text.count())
    signed_docs = cut(text.mapInArrow(signatures(idf), "id long, tag long, node long, other long, bands array<long>"))
    nodes = cut(signed_docs.where(F.size("bands") > 0).groupBy("node", "other").agg(
        F.min(F.struct("id", "tag")).alias("of"), F.first("bands").alias("bands"))
        .select("node", "of.id", "of.tag", "bands"))
    entries = nodes.select("node", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band")
    in_band = cut(entries.join(shared, "band"))
    involved = in_band.select("node").distinct()
    texts = cut(text.join(nodes.join(involved, "node").select("id", "tag", "node").hint("shuffle_hash"), ["id", "tag"])
                .select("node", "text").dropDuplicates(["node"]))
    scores, roots, open_rows, before, turn = None, None, in_band, None, 0
    while True:
        turn += 1
        leaders = (in_band.join(open_rows.select("band").distinct(), "band") if turn > 1 else in_band)
        leaders = smallest(leaders, turn)
        pairs = (open_rows.join(leaders, "band").where("node <> leader").select(
            F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct())
        if roots is not None:
            pairs = (pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
                     .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
                     .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
                     .join(scores, ["a", "b"], "left_anti"))
        found = compared(cut(pairs), texts, idf)
        scores = found if scores is None else cut(scores.unionByName(found))
        roots = components(scores.where(F.col("similarity") >= threshold).select("a", "b"))
        placed = in_band.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
        main = placed.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(
            F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        open_rows = cut(placed.join(main, "band").where(F.col("root") != F.col("main")).select("band", "node", "root"))
        left = open_rows.count()
        if not left or (before is not None and left > 0.7 * before):
            break
        before = left
    if left:
        marked = open_rows.select("band", "node", F.lit(True).alias("open"))
        members = cut(placed.join(open_rows.select("band").distinct(), "band").join(marked, ["band", "node"], "left")
                      .select("band", "node", "root", F.coalesce("open", F.lit(False)).alias("open")))
        found = joined(members, texts, idf, threshold)
        roots = components(scores.where(F.col("similarity") >= threshold).select("a", "b").unionByName(found))
    return (signed_docs.where(F.size("bands") > 0).select("id", "tag", "node")
            .join(roots, "node", "left").select("id", "tag", F.coalesce("root", "node").alias("group")))


def minhash_dedup(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, tag, class_id, kept, grouped): one row per document with the smallest doc_id of its group.

    Links join documents of weighted Jaccard similarity ``threshold`` or more on shingles of
    five words; a text of fewer words is one shingle, texts without words link with nothing.
    A null doc_id counts as the smallest id but names no class of others' rows (class null).
    Exact copies are one node.  Of each group the smallest (doc_id, tag) stays; repeated equal
    rows are answered alike.  ``grouped`` tells whether the text has words.
    """
    groups = cut(near_groups(docs, threshold).distinct())
    best = groups.groupBy("group").agg(F.min(F.struct("id", "tag")).alias("best"))
    answer = groups.join(best, "group").select("id", "tag", "best")
    return (keyed(docs).select("doc_id", "id", "tag").join(answer, ["id", "tag"], "left")
            .select("doc_id", "tag",
                    F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(
                        F.when(F.col("best.id") != -(1 << 63), F.col("best.id"))).alias("class_id"),
                    (F.col("best").isNull() | ((F.col("best.id") == F.col("id"))
                                               & (F.col("best.tag") == F.col("tag")))).alias("kept"),
                    F.col("best").isNotNull().alias("grouped")))
