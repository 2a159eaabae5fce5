"""Reaching definitions: which definition of a variable can be seen at a use.

Functions of bounded size, nearly all of them, are co-located by one shuffle and each is
solved in its task by passing bit sets of definitions along the successors.  Functions above
the bound are walked together: blocks that define nothing and have one predecessor are jumped
over by pointer doubling, so rounds grow with the logarithm of such stretches, and the walk
then visits only definitions and junctions.  Both ways give the same rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracefold.session import cut, cut_bucketed, cut_counted, without

SCOPE = ["graph_id", "func"]
#: Rows (variables per block, and edges) of a function that one task may hold.
FUNCTION_ROWS = 200_000


def reaching_definitions(uses: DataFrame, preds: DataFrame, max_rounds: int | None = None,
                         function_rows: int = FUNCTION_ROWS) -> DataFrame:
    """Blocks whose definition of a variable reaches an exposed use.

    A walk from a use goes over predecessors and stops at a block that defines the variable.
    ``uses`` is the result of ``def_use``; rows with a null in a key match nothing.
    """
    facts = cut(uses.where(F.col("is_defined") | F.col("is_exposed"))
                .select(*SCOPE, "block_id", "var", "is_defined", "is_exposed")
                .dropna(subset=[*SCOPE, "block_id", "var"]))
    edges = cut(preds.select(*SCOPE, "block_id", "pred_id").dropna().distinct())
    sizes = (facts.select(*SCOPE).unionByName(edges.select(*SCOPE))
             .groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n")))
    large, count = cut_counted(sizes.where(F.col("n") > function_rows).select(*SCOPE))
    if not count:
        return solved(facts, edges)
    part = lambda rows, how: rows.join(large, SCOPE, how)
    return solved(part(facts, "left_anti"), part(edges, "left_anti")).unionByName(
        walked(part(facts, "left_semi"), part(edges, "left_semi"), max_rounds))


# --- bounded functions ---------------------------------------------------------------------

def solve(facts: list[tuple], edges: list[tuple]) -> list[tuple]:
    """(var, def, use) of one function; a set of definitions is the bits of an integer."""
    successors = defaultdict(list)
    for block, pred in edges:
        successors[pred].append(block)
    defined, exposed = defaultdict(list), defaultdict(list)
    for block, var, is_defined, is_exposed in facts:
        if is_defined:
            defined[var].append(block)
        if is_exposed:
            exposed[var].append(block)
    out = []
    for var, uses in exposed.items():
        defs = defined.get(var, ())
        stops, seen = set(defs), defaultdict(int)
        work = []
        for bit, block in enumerate(defs):
            work += [(after, 1 << bit) for after in successors[block]]
        while work:
            block, bits = work.pop()
            fresh = bits & ~seen[block]
            if fresh:
                seen[block] |= fresh
                if block not in stops:
                    work += [(after, fresh) for after in successors[block]]
        for use in uses:
            bits = seen.get(use, 0)
            while bits:
                low = bits & -bits
                out.append((var, defs[low.bit_length() - 1], use))
                bits ^= low
    return out


def solved(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Every function in the task that its rows meet in, one function in memory at a time."""
    types = {f.name: f.dataType.simpleString() for f in facts.schema}
    block = types["block_id"]
    ddl = f"graph_id {types['graph_id']}, func {types['func']}, var {types['var']}, def_id {block}, use_id {block}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, own_facts, own_edges, schema = None, [], [], None

        def answer():
            rows = [(*scope, *r) for r in solve(own_facts, own_edges)]
            names = ("graph_id", "func", "var", "def_id", "use_id")
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, schema)], names=names)

        for batch in batches:
            kinds = {f.name: f.type for f in batch.schema}
            schema = [kinds[c] for c in ("graph_id", "func", "var", "block_id", "block_id")]
            for graph, func, at, pred, var, is_defined, is_exposed in zip(
                    *(batch.column(c).to_pylist() for c in
                      (*SCOPE, "block_id", "pred_id", "var", "is_defined", "is_exposed"))):
                if (graph, func) != scope:
                    if own_facts and own_edges:
                        yield answer()
                    scope, own_facts, own_edges = (graph, func), [], []
                if var is None:
                    own_edges.append((at, pred))
                else:
                    own_facts.append((at, var, is_defined, is_exposed))
        if own_facts and own_edges:
            yield answer()

    rows = facts.withColumn("pred_id", F.lit(None).cast(block)).unionByName(edges.withColumns(
        {"var": F.lit(None).cast(types["var"]), "is_defined": F.lit(False), "is_exposed": F.lit(False)}))
    return (rows.repartition(*SCOPE).sortWithinPartitions(*SCOPE)
            .select(*SCOPE, "block_id", "pred_id", "var", "is_defined", "is_exposed").mapInArrow(run, ddl))


# --- functions above the bound -----------------------------------------------------------------

def jumped(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges (cur, next) whose ``next`` skips blocks that define nothing and have one predecessor.

    Pointers double: after ``k`` rounds one spans ``2**k`` such blocks, so the logarithm of the
    largest number of them in a function is enough; what still moves then is a closed ring
    without a definition, and its edges go.
    """
    defining = facts.where("is_defined").select(*SCOPE, F.col("block_id").alias("cur")).distinct()
    steps = edges.select(*SCOPE, F.col("block_id").alias("cur"), F.col("pred_id").alias("next"))
    single = (steps.groupBy(*SCOPE, "cur").agg(F.count(F.lit(1)).alias("n"), F.min("next").alias("next"))
              .where("n = 1").drop("n").join(defining, [*SCOPE, "cur"], "left_anti"))
    pointers = cut(single)
    most = pointers.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    onward = lambda: pointers.select(*SCOPE, F.col("cur").alias("next"), F.col("next").alias("far"))
    for _ in range(int(most).bit_length()):
        pointers = cut(pointers.join(onward(), [*SCOPE, "next"], "left")
                       .select(*SCOPE, "cur", F.coalesce("far", "next").alias("next")))
    turning = pointers.select(*SCOPE, F.col("cur").alias("next"))
    ends = pointers.join(turning, [*SCOPE, "next"], "left_anti").withColumn("ends", F.lit(True))
    known = pointers.select(*SCOPE, "cur").join(ends, [*SCOPE, "cur"], "left").select(
        *SCOPE, F.col("cur").alias("next"), F.col("next").alias("far"), F.coalesce("ends", F.lit(False)).alias("ends"))
    return (steps.join(known, [*SCOPE, "next"], "left")
            .where(F.col("ends").isNull() | F.col("ends"))
            .select(*SCOPE, "cur", F.coalesce("far", "next").alias("next")).distinct())


def walked(facts: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """All uses walk at once; edges and definitions stay in their buckets, the frontier moves."""
    defs = facts.where("is_defined").select(*SCOPE, F.col("block_id").alias("cur"), "var")
    exposed = facts.where("is_exposed").select(
        *SCOPE, "var", F.col("block_id").alias("use_id"), F.col("block_id").alias("cur"))
    at = [*SCOPE, "cur"]
    back = cut_bucketed(jumped(edges, facts), at)
    stops = cut_bucketed(defs.withColumn("is_def", F.lit(True)), at)
    key = [*SCOPE, "var", "use_id", "cur"]
    # A walk starts at the predecessors of its use, which may be jumped over themselves.
    now, rows = cut_counted(exposed.join(defs.select(*SCOPE, "var").distinct(), [*SCOPE, "var"], "left_semi"))
    pieces, reached, rounds = [], [], 0
    while rows:
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"definitions still moving after {max_rounds} rounds")
        step = (now.join(back, at).select(*SCOPE, "var", "use_id", F.col("next").alias("cur")).distinct())
        found = (without(step, pieces, key).join(stops, [*at, "var"], "left")
                 .withColumn("is_def", F.coalesce("is_def", F.lit(False))))
        piece = cut_bucketed(found, key)
        pieces.append(piece.select(*key))
        reached.append(piece.where("is_def"))
        now = piece.where(~F.col("is_def")).select(*key)
        rows = now.count()
        if rounds % KEEP_PIECES == 0:
            pieces = [cut_bucketed(union(pieces), key)]
            reached = [cut(union(reached))]
    found = union(reached) if reached else now.withColumn("is_def", F.lit(True))
    return found.select(*SCOPE, "var", F.col("cur").alias("def_id"), "use_id")


KEEP_PIECES = 8  # visited tables are compacted after this many rounds


def union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
