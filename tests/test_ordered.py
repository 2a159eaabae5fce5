"""Ordered digests and texts in bounded pieces, and running counts in two levels."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracefold.operators import behavior, graph, intel, ordering


def rows(seed=2):
    rng = random.Random(seed)
    out = [(rng.choice(["a", "b", None]), i, rng.choice(["x", "yé", "", None])) for i in range(300)]
    rng.shuffle(out)
    return out + [("none", 900, None)]


def table(spark, data):
    return spark.createDataFrame(data, "k string, at int, t string").repartition(5)


def by_key(data):
    keys = {k for k, _, _ in data}
    return {k: [t for _, t in sorted((i, t) for one, i, t in data if one == k) if t is not None] for k in keys}


def test_ordered_md5(spark):
    data = rows()
    got = {r.k: r.digest for r in ordering.ordered_md5(
        table(spark, data), "k", "at", F.col("t"), ",", "digest").collect()}
    assert got == {k: hashlib.md5(",".join(v).encode()).hexdigest() for k, v in by_key(data).items()}
    assert ordering.ordered_md5(table(spark, data).limit(0), "k", "at", F.col("t"), ",", "d").collect() == []


@pytest.mark.parametrize("size", [1, 7, 1024])
def test_text_pieces(spark, size):
    data = rows(3)
    found = ordering.text_pieces(table(spark, data), ["k"], "at", F.col("t"), "|", size).collect()
    joined = {}
    for r in sorted(found, key=lambda r: (str(r.k), r.piece)):
        assert r.text.count("|") < size
        joined.setdefault(r.k, []).append(r.text)
    want = {k: "|".join(v) for k, v in by_key(data).items() if v}
    assert {k: "|".join(v) for k, v in joined.items()} == want


def test_running_counts(spark):
    data = [(k, i, t) for k, i, t in rows(4) if k]
    got = {(r.k, r["at"]): (r.n, r.xs) for r in ordering.running_counts(
        table(spark, data), ["k"], "at", {"n": F.lit(1), "xs": F.coalesce(F.col("t") == "x", F.lit(False))}, 16).collect()}
    for k, i, _ in data:
        before = [t for one, j, t in data if one == k and j < i]
        assert got[k, i] == (len(before), before.count("x"))


def test_no_list_of_a_whole_key(spark):
    imports = spark.createDataFrame([(1, 0, "k.dll", "F", None, False)],
                                    "file_id long, seq int, dll string, func string, ordinal int, delayed boolean")
    plan = behavior.imphash(imports)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    assert behavior.imphash(imports).first().imphash == hashlib.md5(b"k.f").hexdigest()


def test_reports_and_block_texts_in_pieces(spark):
    parts = spark.createDataFrame(
        [("a", i, "pe" if i % 2 else "script", f"f{i}", "BENIGN", 1.0, 2.0, None if i == 3 else f"r{i}") for i in range(9)],
        "analysis_id string, part_seq int, kind string, file_name string, verdict string, risk_score double, "
        "confidence double, report_markdown string")
    ids = spark.createDataFrame([("a",), ("b",)], "analysis_id string")
    pieces = sorted((r.analysis_id, r.scripts, r.piece, r.report_markdown)
                    for r in intel.verdict_reports(ids, parts, 3).collect())
    text = "".join(p[3] for p in pieces if p[0] == "a")
    assert text == "".join(f"\n\n# {'Script' if i % 2 == 0 else 'PE'} Analysis: f{i}\n{'' if i == 3 else f'r{i}'}"
                           for i in [1, 3, 5, 7, 0, 2, 4, 6, 8])
    assert sum(p[0] == "b" for p in pieces) == 1

    functions = spark.createDataFrame([(0, "f", 0, "sig", 9, False), (0, "x", 1, None, 8, True)],
                                      "graph_id long, func string, func_seq long, signature string, address long, is_external boolean")
    blocks = spark.createDataFrame([(0, "f", 5, 0, 50), (0, "f", 6, 1, 60), (0, "x", 7, 0, 70)],
                                   "graph_id long, func string, block_id long, block_seq long, start long")
    code = spark.createDataFrame([(0, "f", 5, i, "CALL" if i else "ADD", f"t{i}" if i != 1 else "") for i in range(6)],
                                 "graph_id long, func string, block_id long, idx int, inst_type string, raw_text string")
    nodes = graph.build_nodes(functions, blocks, code)
    got = {r.id: (r.type, r.name, r.code, r.num_instructions) for r in nodes.collect()}
    assert got == {0: ("METHOD", "f", "sig", 0), 1: ("BLOCK", "block_5", "", 6), 2: ("BLOCK", "block_6", "", 0),
                   3: ("METHOD", "x", "x", 0)}
    assert sorted((r.id, r.piece, r.code) for r in graph.block_code(nodes, code, 4).collect()) == [
        (1, 0, "t0\nt2\nt3"), (1, 1, "t4\nt5")]
