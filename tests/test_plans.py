"""Plans that must keep content out of shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from tracefold.operators import behavior, identity
from tracefold.plans.catalog import load
from tracefold.plans.check_layout import report_parts
from tracefold.plans.views import Tables
from tracefold.streaming import ingest

DATA = "/root/testdata/sf0.001"


def shuffled_columns(df):
    """Input columns of every exchange of the plan."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\) Exchange\nInput[^:]*: (\[.*?\])\n", text)


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_triage_is_one_scan_without_a_shuffle(spark):
    plan = load()["triage"].run(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("file_entropy"):]
    assert below.count("FileScan") == 1 and "Join" not in below


@pytest.mark.parametrize("refine", [identity.refine_pe, identity.refine_ole])
def test_refining_does_not_shuffle_content(spark, refine):
    files = identity.identify(spark.range(5).selectExpr(
        "id AS file_id", "concat('n', id) AS name", "encode(concat('MZ', id), 'UTF-8') AS content"))
    facts = (spark.range(5).selectExpr("id AS file_id", "1 AS characteristics", "2 AS subsystem")
             if refine is identity.refine_pe else
             spark.range(5).selectExpr("id AS file_id", "'Book' AS stream"))
    got = refine(files, facts).select("file_id", "file_type", "category")
    assert shuffled_columns(got)
    assert not any("content" in line for line in shuffled_columns(got))


def test_ingestion_does_not_shuffle_content(spark, tmp_path):
    batch = spark.range(5).selectExpr("concat('p', id) AS path", "'n.js' AS name", "id AS size",
                                      "encode(concat('f', id), 'UTF-8') AS content")
    got = ingest.analyse_new(batch, ingest.read_store(spark, str(tmp_path / "none")))
    assert shuffled_columns(got)
    assert not any("content" in line for line in shuffled_columns(got))


ANALYZERS = {"headers", "sections", "imports", "exports", "strings", "resources", "entropy", "cfg",
             "api_call_graph", "signatures", "packer", "debug_features", "certificate", "overlay", "memory_layout"}


def test_deep_report_has_every_part_of_every_file(spark):
    tables = Tables(spark, "/root/testdata/sf0.001")
    parts = report_parts(tables)
    assert {name.split(".")[0] for name in parts} == ANALYZERS | {"broken"}
    files = tables("files").select("file_id")
    report = behavior.deep_report(tables("files"), parts).cache()
    n = files.count()
    covered = {r["part"]: r for r in report.groupBy("part").agg(
        F.count_distinct("file_id").alias("files"), F.count("error").alias("failed")).collect()}
    assert {name: (r["files"], r["failed"] > 0) for name, r in covered.items()} == {
        name: (n, name == "broken") for name in parts}
    for name in ("certificate", "strings", "memory_layout"):
        want = parts[name]().join(files, "file_id", "left_semi").count()
        assert 0 < want == report.where((F.col("part") == name) & F.col("body").isNotNull()).count()
    report.unpersist()


def test_deep_report_keeps_the_other_parts_of_one_that_fails_in_running(spark):
    files = spark.range(3).withColumnRenamed("id", "file_id")
    report = behavior.deep_report(files, {
        "good": lambda: files.selectExpr("file_id", "file_id + 1 AS n"),
        "bad": lambda: files.selectExpr("file_id", "raise_error('no such header') AS n")}).collect()
    assert sorted((r["file_id"], r["body"]) for r in report if r["part"] == "good") == [
        (i, f'{{"n":{i + 1}}}') for i in range(3)]
    bad = [r for r in report if r["part"] == "bad"]
    assert len(bad) == 3 and all(r["error"] and r["body"] is None for r in bad)


def test_held_lines_run_their_window_once_and_give_the_same_rows(spark):
    plain, held = Tables(spark, DATA), Tables(spark, DATA)
    held.hold("lines")
    plan = held("sections").groupBy("file_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    for name in ("lines", "imports"):
        both = [sorted(map(str, tables(name).collect())) for tables in (plain, held)]
        assert both[0] and both[0] == both[1]


def test_deep_report_writes_no_findings_of_files_that_are_not_in_it(spark, monkeypatch):
    written, cut = [], behavior.cut

    def counted(df):
        table = cut(df)
        written.append((table.columns, table.count()))
        return table

    monkeypatch.setattr(behavior, "cut", counted)
    files = spark.range(3).union(spark.range(1)).withColumnRenamed("id", "file_id")
    report = behavior.deep_report(files, {
        "twice": lambda: spark.range(40).selectExpr("nullif(id % 20, 19) AS file_id", "id AS n")}).collect()
    assert [n for columns, n in written if "body" in columns] == [6]
    assert sorted((r["file_id"], r["body"]) for r in report) == sorted(
        (i, f'{{"n":{n}}}') for i in (0, 0, 1, 2) for n in (i, i + 20))
