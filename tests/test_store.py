"""The committed store: upserts by bucket, appends by token, ingestion by bucket."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracefold.sources import commits, store

COLUMNS = store.ANALYSIS_SCHEMA


def analysis(id, file_hash, at, report="r"):
    return (id, file_hash, "n", "t", "MALWARE", 1.0, 2.0, "{}", report, datetime(2024, 1, 1, 0, at))


def upserted(rows):
    """One row at a time, each replacing rows of its id and of its hash."""
    kept = []
    for row in rows:
        kept = [k for k in kept if k[0] != row[0] and (row[1] is None or k[1] != row[1])] + [row]
    return sorted((r[0], r[1], r[8]) for r in kept)


def held(spark, root):
    return sorted((r.id, r.file_hash, r.report_markdown) for r in store.read_analyses(spark, root).collect())


def files(root, kind):
    return {p: p.stat().st_mtime_ns for p in Path(root, kind).rglob("*.parquet")}


def test_upserts_equal_one_row_at_a_time(spark, tmp_path):
    root, done = str(tmp_path / "store"), []
    batches = [[analysis("a", "h1", 1, "r1"), analysis("b", "h2", 2, "r2"), analysis("n", None, 3, "r3")],
               [analysis("a", "h3", 4, "r4")],                                # the id moves to another bucket
               [analysis("c", "h2", 5, "r5"), analysis("n", None, 6, "r6")],  # the hash gets another id
               [analysis("d", "h3", 7, "r7"), analysis("d", "h2", 8, "r8")]]  # clashes inside a batch and with both
    for batch in batches:
        done += batch
        store.store_analyses(spark.createDataFrame(batch, COLUMNS), root)
        assert held(spark, root) == upserted(done)


def test_untouched_buckets_and_texts_stay_where_they_are(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = [analysis(f"a{i}", f"h{i}", 1, f"r{i}") for i in range(40)]
    store.store_analyses(spark.createDataFrame(rows, COLUMNS), root)
    texts = files(root, "texts")
    before = {(e[1]): e[2] for e in commits.last_commit(spark, root)[1] if e[0] == "keys"}
    touched = store.store_analyses(spark.createDataFrame([analysis("a7", "h7", 2, "new")], COLUMNS), root)
    after = {(e[1]): e[2] for e in commits.last_commit(spark, root)[1] if e[0] == "keys"}
    assert len(touched) == 1 and len(before) > 10
    assert {b for b in before if after[b] != before[b]} == set(touched)
    now = files(root, "texts")
    assert {p: t for p, t in now.items() if p in texts} == texts  # old texts lie as they were
    added = spark.read.parquet(*[str(p) for p in now if p not in texts])
    assert [r.report_markdown for r in added.collect()] == ["new"]
    assert ("a7", "h7", "new") in held(spark, root) and len(held(spark, root)) == 40


def test_a_failed_write_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "store")
    store.store_analyses(spark.createDataFrame([analysis("a", "h", 1)], COLUMNS), root)
    broken = spark.createDataFrame([analysis("b", "g", 2)], COLUMNS).withColumn(
        "report_markdown", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(PySparkException):
        store.store_analyses(broken, root)
    assert held(spark, root) == [("a", "h", "r")]
    with pytest.raises(PySparkException):  # the number of a commit is taken once
        commits.commit(spark, root, 1, [("keys", 0, "x", None)])


def test_appends_are_added_once(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.read_iocs(spark, root).count() == 0
    rows = spark.createDataFrame([("a", "url", "u", "c", None, None), ("a", "ip", "i", None, 2, None)], store.IOC_SCHEMA)
    assert store.append_iocs(rows, root, "b1") and not store.append_iocs(rows, root, "b1")
    assert store.append_iocs(rows.limit(0), root, "b2") and store.append_iocs(rows, root)
    assert sorted(r.threat_level for r in store.read_iocs(spark, root).collect()) == [2, 2, 5, 5]
    agents = rows.select("analysis_id", F.lit("x").alias("agent_name"), "ioc_type", "created_at")
    assert store.append_agent_results(agents, ["ioc_type"], root, "b1")  # tokens are per table
    assert sorted(r.result_json for r in store.read_agent_results(spark, root).collect()) == [
        '{"ioc_type":"ip"}', '{"ioc_type":"url"}']
