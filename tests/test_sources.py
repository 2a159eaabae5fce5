"""File listings, the rule registry and pushed-down lookups."""

import pytest
from pyspark.sql import functions as F

from tracefold.operators import intel, registry
from tracefold.sources import files as listing


def test_read_files_skips_hidden_and_graph_output(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ["a.EXE", ".hidden.exe", "b.json", "c.cpg", "sub/d.dll", "e"]:
        (tmp_path / name).write_bytes(b"x")
    names = lambda df: {r["name"] for r in df.select("name").collect()}
    assert names(listing.read_files(spark, str(tmp_path))) == {"a.EXE", "d.dll", "e"}
    assert names(listing.read_files(spark, str(tmp_path), extensions=["exe", ".dll"])) == {
        "a.EXE", "d.dll"}
    assert names(listing.read_files(spark, str(tmp_path), recursive=False)) == {"a.EXE", "e"}


def test_numbers_follow_the_path(spark):
    paths = [f"/f/{i:03d}" for i in range(50)]
    df = spark.createDataFrame([(p,) for p in reversed(paths)], "path string")
    got = {r["path"]: (r["file_index"], r["index_name"]) for r in listing.number_files(df).collect()}
    assert got == {p: (i, f"{i:06d}") for i, p in enumerate(paths)}


def test_registry_runs_and_refuses_doubles(spark):
    @registry.rule("big_files")
    def big_files(df, limit):
        return df.where(F.col("size") > limit)

    df = spark.createDataFrame([(1, 10), (2, 20)], "id int, size int")
    assert registry.run_rule("big_files", df, limit=15).count() == 1
    with pytest.raises(ValueError):
        registry.rule("big_files")(big_files)


def test_lookup_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "analyses")
    spark.range(10).select(F.col("id").cast("string").alias("id"),
                           F.lit("h").alias("file_hash")).write.parquet(path)
    plan = intel.get_by_id(spark.read.parquet(path), "3")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "EqualTo(id,3)" in plan
