"""Ordered helpers on a key that holds most rows, and the plans behind limits."""

from pyspark.sql import functions as F

from tracefold.operators import evaluate, features, ordering


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot(spark, rows=20_000):
    return spark.range(rows).select(
        F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 97).alias("key"), "id",
        (F.col("id") * 7919 % rows).alias("value"))


def test_number_rows_spreads_a_hot_key(spark):
    # Twenty thousand rows are too few for the planner to keep the pieces apart.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordering.number_rows(hot(spark), ["value"], ["key"])
        pieces = got.where("key = 0").select(F.spark_partition_id().alias("p")).distinct().count()
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = {}
    for r in rows:
        groups.setdefault(r["key"], []).append((r["value"], r["row_index"]))
    assert all([i for _, i in sorted(g)] == list(range(len(g))) for g in groups.values())
    assert pieces > 1


def test_running_total_without_group(spark):
    df = hot(spark, 5_000)
    got = ordering.running_total(df, ["id"], None, {"before": F.col("value")})
    total = 0
    for r in got.orderBy("id").collect():
        assert r["before"] == total
        total += r["value"]


def test_fill_forward_across_pieces(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), "id")
    mark = F.when(F.col("id").isin(3, 4, 500), F.col("id"))
    got = ordering.fill_forward(df, ["k"], "id", {"last": mark}, piece_rows=64)
    want = lambda i: None if i < 3 else 3 if i < 4 else 4 if i < 500 else 500
    assert all(r["last"] == want(r["id"]) for r in got.collect())


def test_first_rows_limits_before_the_shuffle(spark):
    df = ordering.first_rows(hot(spark), ["key"], ["id"], 5)
    assert plan_of(df).count("WindowGroupLimit") == 2
    assert df.groupBy("key").count().agg(F.max("count")).collect()[0][0] == 5


def test_split_sizes_are_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("file_id"),
                                  F.when(F.col("id") < 900, 0).otherwise(1).alias("label"))
    got = {(r["label"], r["split"]): r["count"]
           for r in evaluate.stratified_split(df).groupBy("label", "split").count().collect()}
    assert got == {(0, "train"): 720, (0, "val"): 90, (0, "test"): 90,
                   (1, "train"): 80, (1, "val"): 10, (1, "test"): 10}


def test_softmax_sums_to_one_on_a_hot_target(spark):
    scores = hot(spark).select(F.col("key").alias("dst"), (F.col("value") / 1000).alias("score"))
    sums = features.segment_softmax(scores, ["dst"]).groupBy("dst").agg(F.sum("weight").alias("s"))
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums.collect())
