"""Feature slots: buckets that travel as bits, and sums of the slots."""

import pytest
from pyspark.sql import functions as F

from tracefold import rules
from tracefold.operators import features
from tracefold.plans import check_graphs

NODES = ("graph_id bigint, id bigint, type string, name string, is_external boolean, line bigint, "
         "inst_counts map<string,bigint>, num_instructions bigint")


@pytest.mark.parametrize("buckets", [[], [0, 63, 64, 67], list(range(rules.HASH_BUCKETS)), None])
def test_buckets_as_bits(spark, buckets):
    df = spark.createDataFrame([(buckets,)], "b array<bigint>")
    bits = df.select(*features.mask_columns(F.col("b"), "_m"))
    got = bits.select(F.array(*features.mask_slots("_m")).alias("slots"),
                      features.mask_buckets("_m").alias("held")).first()
    assert list(got["slots"]) == [int(i in (buckets or [])) for i in range(rules.HASH_BUCKETS)]
    assert got["held"] == (buckets or [])


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame(
        [(1, 0, "METHOD", "main", False, 5, None, 0), (1, 1, "BLOCK", "main", False, 0, {"CALL": 3, "FINALLY": 2}, 5),
         (1, 2, "METHOD", "KERNEL32.dll!" + rules.SUSPICIOUS_API_NAMES[0], True, 2000, None, 0),
         (2, 0, "METHOD", "main", None, None, None, 0), (2, 1, "CALL", None, False, 0, None, 0),
         (3, 0, None, "", False, 0, None, 0)], NODES)
    edges = spark.createDataFrame([(1, 0, 2, "CALLS"), (1, 0, 1, "CFG")],
                                  "graph_id bigint, src bigint, dst bigint, etype string")
    files = spark.createDataFrame([(1, "x86", 2, "pe", 0), (2, "x64", 3, "pe", 0)],
                                  "file_id bigint, arch string, subsystem bigint, file_type string, timestamp bigint")
    items = spark.createDataFrame([(1, "imports", i, f"a.dll!f{i}") for i in range(30)],
                                  "file_id bigint, kind string, pos bigint, value string")
    facts = features.global_features(files, items).withColumnRenamed("file_id", "graph_id")
    return nodes, edges, facts, features.node_features(nodes, edges, facts)


def test_node_features_hold_the_buckets_of_names_apis_and_imports(graph):
    nodes, edges, facts, out = graph
    got = {(r["graph_id"], r["id"]): r["features"] for r in out.collect()}
    assert len(got) == 6 and {len(v) for v in got.values()} == {320}
    hot = lambda held: [float(i in held) for i in range(rules.HASH_BUCKETS)]
    names = {(r["graph_id"], r["id"]): r["b"] for r in nodes.select(
        "graph_id", "id", features.name_buckets(F.col("name")).alias("b")).collect()}
    bad = {(r["graph_id"], r["id"]): r["buckets"] for r in features.suspicious_api_fingerprint(nodes, edges).collect()}
    bag = {r["graph_id"]: r["import_buckets"] for r in facts.collect()}
    assert set(bad) == {(1, 0), (1, 2)} and bag[2] == []
    for key, v in got.items():
        assert v[32:100] == hot(names[key] or [])
        assert v[210:278] == hot(bag.get(key[0], []))
        if key != (1, 1):  # the first two of a block keep counts
            assert v[142:210] == hot(bad.get(key, []))


def test_node_features_search_no_list_for_each_slot(graph):
    plan = graph[3]._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan
    # What is known by name and by graph joins before the nodes are dealt by their key.
    assert plan.index("in_degree") < plan.index("_name0")


def test_slot_sums_as_spark_adds_them(graph):
    out = graph[3]
    weighted = F.transform("features", lambda v, i: v * (i + 1))
    want = out.select(
        "graph_id", "id", F.size(F.filter("features", lambda v: v != 0)).cast("bigint").alias("slots"),
        F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v).alias("checksum")).collect()
    got = out.select("graph_id", "id", "features").mapInArrow(
        check_graphs._slot_sums, "graph_id long, id long, slots long, checksum double").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert [r["checksum"] for r in got if r["graph_id"] == 3] == [None]  # a slot of an unknown type is null
