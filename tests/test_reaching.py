"""Reaching definitions: both ways give the rows of a plain walk, and long stretches are jumped."""

import random

import pytest
from pyspark.sql import functions as F

from tracefold.operators import reaching

FACTS = ("graph_id bigint, func string, block_id bigint, var string, is_defined boolean, is_exposed boolean")
PREDS = "graph_id bigint, func string, block_id bigint, pred_id bigint"


def plain(facts, preds):
    back, defs, out = {}, {}, set()
    for g, f, b, p in preds:
        back.setdefault((g, f, b), set()).add(p)
    for g, f, b, v, d, _ in facts:
        if d:
            defs.setdefault((g, f, v), set()).add(b)
    for g, f, b, v, _, used in facts:
        if not used:
            continue
        todo, seen = list(back.get((g, f, b), ())), set()
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            if at in defs.get((g, f, v), ()):
                out.add((g, f, v, at, b))
            else:
                todo += back.get((g, f, at), ())
    return out


def random_functions(seed):
    rng = random.Random(seed)
    facts, preds = [], set()
    for g, f, n, share in ((0, "f", 14, 0.2), (0, "g", 40, 0.03), (1, "f", 25, 0.1)):
        for b in range(n):
            facts += [(g, f, b, v, rng.random() < share, rng.random() < 0.3) for v in "abc"]
            preds |= {(g, f, b, rng.randrange(n)) for _ in range(rng.choice([0, 1, 1, 1, 2]))}
    return facts, sorted(preds)


def frames(spark, facts, preds):
    return (spark.createDataFrame(facts, FACTS).repartition(3), spark.createDataFrame(preds, PREDS).repartition(2))


@pytest.mark.parametrize("seed,limit", [(1, 0), (2, 0), (3, reaching.FUNCTION_ROWS), (4, 100)])
def test_equals_a_plain_walk(spark, seed, limit):
    facts, preds = random_functions(seed)
    got = reaching.reaching_definitions(*frames(spark, facts, preds), function_rows=limit).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain(facts, preds))


def test_long_stretch_takes_few_rounds(spark):
    n = 600
    facts = [(0, "f", 0, "v", True, False), (0, "f", n, "v", False, True)]
    preds = [(0, "f", b, b - 1) for b in range(1, n + 1)]
    uses, back = frames(spark, facts, preds)
    got = reaching.walked(uses, back, max_rounds=3).collect()
    assert [tuple(r) for r in got] == [(0, "f", "v", 0, n)]


def test_ring_without_definition_ends(spark):
    facts = [(0, "f", 9, "v", True, False), (0, "f", 1, "v", False, True)]
    preds = [(0, "f", 1, 2), (0, "f", 2, 3), (0, "f", 3, 4), (0, "f", 4, 2)]
    assert reaching.walked(*frames(spark, facts, preds), max_rounds=5).collect() == []


def test_null_keys_and_empty_tables(spark):
    facts = [(None, "f", 1, "v", True, True), (0, None, 1, "v", True, True), (0, "f", None, "v", True, True),
             (0, "f", 1, None, True, True), (0, "f", 1, "v", True, True)]
    preds = [(0, "f", 1, None), (None, "f", 1, 1), (0, "f", 1, 1)]
    got = reaching.reaching_definitions(*frames(spark, facts, preds)).collect()
    assert [tuple(r) for r in got] == [(0, "f", "v", 1, 1)]
    uses, back = frames(spark, facts, preds)
    assert reaching.reaching_definitions(uses.limit(0), back.limit(0)).collect() == []


def test_edges_are_not_shuffled_in_a_round(spark):
    facts, preds = random_functions(5)
    edges = reaching.cut_bucketed(spark.createDataFrame(preds, PREDS).select(
        "graph_id", "func", F.col("block_id").alias("cur"), "pred_id"), [*reaching.SCOPE, "cur"])
    now = spark.createDataFrame(facts, FACTS).select("graph_id", "func", F.col("block_id").alias("cur"), "var")
    plan = now.hint("merge").join(edges, [*reaching.SCOPE, "cur"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
