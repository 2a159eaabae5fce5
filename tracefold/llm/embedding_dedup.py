"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors are sorted into tables by the sides of a few projections each; ``tables`` follows
from the number of vectors so that a pair at the threshold meets in some table with the
wanted recall.  Inside a table entry, collisions are counted for each pair: a collision is a
projection on which the two lie within a window around each other.  Pairs that reach the
count, calibrated for the same recall, are verified by their cosine in double precision.

A pair is counted where it first meets, so no pairs are shuffled: entries give partial link
sums and, for the components, one link per vector to a member of its part of the entry.
Equal vectors are one class with a multiplicity.  A large entry is split into blocks and
every two blocks meet in a task of their own; small entries are counted many at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tracefold.llm.common import cut
from tracefold.llm.components import components

COSINE = 0.9
RECALL = 0.998
#: Projections counted per pair, half window in standard deviations of a pair at the threshold.
COUNTED, WINDOW = 48, 1.5
#: Members of a table entry handled together; above it the entry is split into blocks.
BLOCK = 1024
#: Entries of up to so many members are counted together, so many pairs in one numpy pass.
SMALL, PAIRS = 64, 1 << 16


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def needed_count(cosine: float, recall: float) -> tuple[float, int]:
    """Half window, and the collisions that a pair at ``cosine`` reaches with ``recall``."""
    distance = math.sqrt(2 - 2 * cosine)
    p = 2 * normal_cdf(WINDOW) - 1
    tail, need = 0.0, 0
    for k in range(COUNTED + 1):
        tail += math.comb(COUNTED, k) * p ** k * (1 - p) ** (COUNTED - k)
        if tail > 1 - recall:
            break
        need = k + 1
    return WINDOW * distance, need


def plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Projections per table and number of tables for ``n`` vectors."""
    bits = int(min(30, max(3, round(math.log2(max(n, 2) / 16)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, key, vec): valid vectors as doubles, with a key of their content."""
    valid = (F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
             & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
             & F.exists("embedding", lambda x: x != 0))

    def pack(batches):
        for batch in batches:
            rows = [np.asarray(v, np.float64) + 0.0 for v in batch.column("embedding").to_pylist()]
            with np.errstate(over="ignore"):
                raw = [(f if (f := r.astype(np.float32)).astype(np.float64).tobytes() == r.tobytes() else r).tobytes()
                       for r in rows]  # four bytes where they hold the value exactly
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([len(r) for r in rows], pa.int32()),
                 pa.array([xxhash.xxh3_128_digest(b) for b in raw], pa.binary()), pa.array(raw, pa.binary())],
                names=["vec_id", "dim", "key", "vec"])

    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                           F.col("embedding").cast("array<double>").alias("embedding"))
            .where(valid).mapInArrow(pack, "vec_id long, dim int, key binary, vec binary"))


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.array([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64) for r in raw], np.float64)
    x = x.reshape(len(raw), dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def code_rows(bits: int, tables: int):
    """(dim, node, n, vec, codes): the sides of every table as one block of numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            raw = batch.column("vec").to_pylist()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                side = (unit([raw[i] for i in rows], dim) @ directions(dim, bits * tables, 1) > 0)
                codes = (side.reshape(len(rows), tables, bits) << np.arange(bits)).sum(axis=2)
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("dim", "node", "n", "vec")),
                     pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32()))],
                    names=["dim", "node", "n", "vec", "codes"])
    return run


def entry(t):
    """Key of a table entry: vectors of one length that lie on the same sides."""
    return F.shiftleft(F.col("dim").cast("long"), 48) + F.shiftleft(t.cast("long"), 32) + F.col("code").cast("long")


def hooked(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest reachable index of every element after linking ``x`` and ``y``: hook, compress, repeat."""
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low != high
        x, y, low, high = x[apart], y[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    return root


def handled(codes: np.ndarray, t: int) -> np.ndarray | None:
    """Codes of the earlier table that holds most pairs of this entry together."""
    best, most = None, 0
    for earlier in range(min(t, 8)):
        together = (np.unique(codes[:, earlier], return_counts=True)[1].astype(np.int64) ** 2).sum()
        if together > most:
            best, most = codes[:, earlier], together
    return best


def code_block(codes: pa.Array, size: int) -> np.ndarray:
    return codes.flatten().to_numpy().reshape(size, -1)


def pairs_inside(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every two places of the same group, for groups of the given sizes one after the other."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    later = ends - np.arange(len(ends)) - 1
    x = np.repeat(np.arange(len(ends)), later)
    return x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later)


def pairs_of(window: float, need: int, cosine: float):
    """Rows sorted by (entry, first block, second block) → partial sums per vector."""
    def solve(t: int, node, n, codes, vec, side) -> pa.RecordBatch | None:
        size, dim = len(node), vec.shape[1]
        shadow = (vec @ directions(dim, COUNTED, 2)).astype(np.float32)
        sums, root = np.zeros(size, np.int64), np.arange(size)
        # side 0: the entry is whole, all pairs; sides 1 and 2: pairs across the two blocks
        whole = (side == 0).all()
        left = np.arange(size) if whole else np.flatnonzero(side != 2)
        right = left if whole else np.flatnonzero(side == 2)
        # Pairs that an earlier table holds were counted there: whole groups of them are passed over.
        group = handled(codes, t)
        if group is not None:
            left = left[np.argsort(group[left], kind="stable")]
            right = left if whole else right
        place = np.empty(size, np.int64)
        place[left] = np.arange(len(left))
        for s in range(0, len(left), 128):
            a = left[s:s + 128]
            r = right[s:] if whole else right
            if group is not None and group[a[0]] == group[a[-1]]:
                r = r[group[r] != group[a[0]]]
            hits = np.zeros((len(a), len(r)), np.int16)
            if len(r) <= 64:
                hits = (np.abs(shadow[a][:, None, :] - shadow[r][None, :, :]) <= window).sum(axis=2)
            else:
                for k in range(COUNTED):
                    hits += np.abs(shadow[a, k][:, None] - shadow[r, k][None, :]) <= window
            i, j = np.nonzero(hits >= need)
            i, j = a[i], r[j]
            if whole:
                once = place[i] < place[j]
                i, j = i[once], j[once]
            for q in range(0, len(i), 65536):
                x, y = i[q:q + 65536], j[q:q + 65536]
                good = np.einsum("ij,ij->i", vec[x], vec[y]) >= cosine
                x, y = x[good], y[good]
                root = hooked(root, x, y)
                if t:  # counted in the first table that holds both
                    first = ~(codes[x, :t] == codes[y, :t]).any(axis=1)
                    x, y = x[first], y[first]
                np.add.at(sums, x, n[y])
                np.add.at(sums, y, n[x])
        keep = np.flatnonzero((sums > 0) | (root != np.arange(size)))
        if not len(keep):
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(node[keep], pa.int64()), pa.array(sums[keep], pa.int64()),
             pa.array(node[root[keep]], pa.int64())], names=["node", "links", "root"])

    def solve_small(rows: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch | None:
        """Whole entries of vectors of one length, one after the other."""
        node, n, t = (rows.column(c).to_numpy() for c in ("node", "n", "t"))
        codes = code_block(rows.column("codes"), rows.num_rows)
        vec = unit(rows.column("vec").to_pylist(), int(rows.column("dim")[0].as_py()))
        shadow = (vec @ directions(vec.shape[1], COUNTED, 2)).astype(np.float32)
        sums, root = np.zeros(len(node), np.int64), np.arange(len(node))
        tables = np.arange(codes.shape[1])
        i, j = pairs_inside(sizes)
        for q in range(0, len(i), PAIRS):
            x, y = i[q:q + PAIRS], j[q:q + PAIRS]
            # counted in the first table that holds both
            first = ~((codes[x] == codes[y]) & (tables < t[x][:, None])).any(axis=1)
            x, y = x[first], y[first]
            near = (np.abs(shadow[x] - shadow[y]) <= window).sum(axis=1) >= need
            x, y = x[near], y[near]
            good = np.einsum("ij,ij->i", vec[x], vec[y]) >= cosine
            x, y = x[good], y[good]
            root = hooked(root, x, y)
            np.add.at(sums, x, n[y])
            np.add.at(sums, y, n[x])
        keep = np.flatnonzero((sums > 0) | (root != np.arange(len(node))))
        if not len(keep):
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(node[keep], pa.int64()), pa.array(sums[keep], pa.int64()),
             pa.array(node[root[keep]], pa.int64())], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            size = rows.num_rows
            if size > 1:
                column = lambda c: rows.column(c).combine_chunks()
                codes = code_block(column("codes"), size)
                out = solve(int(rows.column("t")[0].as_py()), rows.column("node").to_numpy(),
                            rows.column("n").to_numpy(), codes,
                            unit(column("vec").to_pylist(), int(rows.column("dim")[0].as_py())),
                            rows.column("side").to_numpy())
                if out is not None:
                    yield out

        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("entry", "one", "two")], axis=1)
            cuts = np.array([0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows])
            # The first and last entry of a batch may go on in others; whole small ones between them go together.
            sizes = np.diff(cuts)
            across = np.add.reduceat(batch.column("side").to_numpy() != 0, cuts[:-1]) > 0
            small = (sizes <= SMALL) & ~across
            small[[0, -1]] = False
            several = small & (sizes > 1)
            dims = batch.column("dim").to_numpy()[cuts[:-1]]
            for dim in np.unique(dims[several]):
                chosen = np.repeat(several & (dims == dim), sizes)
                out = solve_small(batch.filter(pa.array(chosen)), sizes[several & (dims == dim)])
                if out is not None:
                    yield out
            for k in np.flatnonzero(~small):
                s, e = int(cuts[k]), int(cuts[k + 1])
                if held and key != tuple(keys[s]):
                    yield from flush()
                key = tuple(keys[s])
                held.append(batch.slice(s, e - s))
        if held:
            yield from flush()
    return run


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links of cosine >= ``cosine`` and their components.

    Vectors that are null, zero or hold null or non-finite components link with nothing;
    vectors of different lengths never link; repeated rows are vectors of their own; a null
    vec_id is returned as its own row without links.
    """
    valid = cut(classes(vectors))
    groups = cut(valid.groupBy("dim", "key").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"),
                                                 F.first("vec").alias("vec")))
    count = groups.count()
    bits, tables = plan(count, cosine, recall)
    window, need = needed_count(cosine, recall)
    coded = cut(groups.select("dim", "node", "n", "vec").mapInArrow(
        code_rows(bits, tables), "dim int, node long, n long, vec binary, codes array<int>"))
    # Only keys are counted; the entries that need blocks go back to their vectors by table.
    narrow = coded.select("dim", "node", F.posexplode("codes").alias("t", "code")).select(
        "node", "t", entry(F.col("t")).alias("entry"))
    large = (narrow.groupBy("entry").count().where(F.col("count") > BLOCK)
             .select("entry", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    split = narrow.join(large.hint("shuffle_hash"), "entry").groupBy("node").agg(
        F.map_from_entries(F.collect_list(F.struct("t", "blocks"))).alias("split"))  # one per table at most
    sized = (coded.join(split.hint("shuffle_hash"), "node", "left")
             .select("dim", "node", "n", "vec", "codes", "split", F.posexplode("codes").alias("t", "code"))
             .withColumn("blocks", F.try_element_at("split", F.col("t"))).withColumn("entry", entry(F.col("t")))
             .withColumn("block", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("node"), "blocks"))
                         .otherwise(0).cast("int")))
    # A block meets itself (side 0) and, in an entry of several, each other block once.
    others = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda o: F.struct(
            F.least("block", o).alias("one"), F.greatest("block", o).alias("two"),
            F.when(o == F.col("block"), 0).when(F.col("block") < o, 1).otherwise(2).alias("side"))))
    met = (sized.withColumn("m", F.explode(others))
           .select("entry", "dim", "t", "node", "n", "codes", "vec", "m.one", "m.two", "m.side")
           .repartition("entry", "one", "two").sortWithinPartitions("entry", "one", "two"))
    partial = cut(met.mapInArrow(pairs_of(window, need, cosine), "node long, links long, root long"))
    sums = partial.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(partial.select(F.col("node").alias("a"), F.col("root").alias("b")))
    labelled = groups.select("dim", "key", "node", "n").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    labels = labelled.groupBy("root").agg(F.min("node").alias("component_id"))
    members = (labelled.join(labels, "root").join(sums, "node", "left")
               .select("dim", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    answered = valid.select("vec_id", "dim", "key").join(members, ["dim", "key"])
    counted = answered.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(counted, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
