"""Streaming forms give the results of the batch forms."""

import hashlib

from pyspark.sql import functions as F

from tracefold.plans.views import Tables
from tracefold.streaming import events as progress
from tracefold.streaming import ingest

DATA = "/root/testdata/sf0.001"


def source(spark, tmp_path, parts=3):
    table = Tables(spark, DATA)("analysis_events").where("seq < 600")
    table = table.withColumn("seq", F.col("seq").cast("bigint"))
    folder = str(tmp_path / "events")
    for i in range(parts):
        table.where(f"cast(seq div 200 as int) = {i}").coalesce(1).write.mode("append").parquet(folder)
    batch = spark.read.parquet(folder)
    stream = (spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1)
              .parquet(folder))
    return batch, stream


def drain(df, name, mode):
    query = (df.writeStream.format("memory").queryName(name).outputMode(mode)
             .trigger(availableNow=True).start())
    query.awaitTermination(180)
    assert query.exception() is None
    return df.sparkSession.table(name)


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_state_and_activity(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    columns = ["analysis_id", "status", "progress", "file_type", "prediction", "error"]
    got = drain(progress.analysis_state(stream), "state_out", "complete")
    assert rows(got, *columns) == rows(progress.analysis_state(batch), *columns)
    got = drain(progress.agent_activity(stream), "agent_out", "complete")
    assert rows(got, "analysis_id", "agent", "status") == rows(
        progress.agent_activity(batch), "analysis_id", "agent", "status")


def test_history_keeps_every_event(spark, tmp_path):
    batch, _ = source(spark, tmp_path)
    got = progress.event_history(batch)
    assert got.count() == batch.count()
    assert got.where("place = 0").count() == batch.select("analysis_id").distinct().count()


def test_gate_is_emitted_once(spark, tmp_path):
    from tracefold import rules
    roles = rules.PARALLEL_ROLES
    events = [("a", i, "agent_completed", role) for i, role in enumerate(roles + roles)]
    events += [("b", i, "agent_completed", role) for i, role in enumerate(roles[:4])]
    schema = "analysis_id string, seq bigint, event_type string, agent string"
    folder = str(tmp_path / "gate")
    for part in (events[:3], events[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drain(progress.stream_stage_gate(stream), "gate_out", "append")
    assert [tuple(r) for r in got.collect()] == [("a", 4)]
    batch = progress.stage_gate(spark.read.parquet(folder))
    assert [tuple(r) for r in batch.collect()] == [("a", 4)]


def test_subscribe(spark, tmp_path):
    batch, _ = source(spark, tmp_path)
    one = batch.first()["analysis_id"]
    assert progress.subscribe(batch, one).select("analysis_id").distinct().count() == 1
    assert progress.subscribe(batch).count() == batch.count()


def test_ingest_skips_known_content(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "cp")
    inbox.mkdir()
    (inbox / "a.js").write_bytes(b"function x() {}")
    (inbox / "copy.js").write_bytes(b"function x() {}")
    (inbox / "data.bin").write_bytes(b"a\0b")

    def run():
        stream = ingest.read_upload_stream(spark, str(inbox))
        ingest.ingest_stream(stream, out, state).awaitTermination(120)
        return ingest.read_store(spark, out)

    first = run()
    assert rows(first, "name", "route", "status") == {
        ("a.js", "script", "completed"), ("data.bin", "unsupported", "completed")}
    (inbox / "later.js").write_bytes(b"function x() {}")
    (inbox / "b.exe").write_bytes(b"MZ\0\0")
    assert rows(run(), "name", "route") == {
        ("a.js", "script"), ("data.bin", "unsupported"), ("b.exe", "pe")}


def test_store_is_empty_before_the_first_batch(spark, tmp_path):
    assert ingest.read_store(spark, str(tmp_path / "none")).count() == 0


def test_missing_content_is_recorded_as_failed(spark, tmp_path):
    batch = spark.createDataFrame([("/x/a.bin", "a.bin", 0, bytearray())],
                                  "path string, name string, size bigint, content binary")
    known = ingest.read_store(spark, str(tmp_path / "none"))
    assert rows(ingest.analyse_new(batch, known), "name", "status") == {("a.bin", "failed")}


def test_a_new_checkpoint_keeps_stored_rows(spark, tmp_path):
    inbox, out = tmp_path / "in2", str(tmp_path / "store2")
    inbox.mkdir()
    for name, state in (("a.js", "cp1"), ("b.js", "cp2")):
        (inbox / name).write_bytes(f"function {name} ()".encode())
        stream = ingest.read_upload_stream(spark, str(inbox))
        ingest.ingest_stream(stream, out, str(tmp_path / state)).awaitTermination(120)
    assert rows(ingest.read_store(spark, out), "name") == {("a.js",), ("b.js",)}


def test_null_beside_empty_content(spark, tmp_path):
    batch = spark.createDataFrame([("/x/a", "a", 0, bytearray()), ("/x/b", "b", None, None),
                                   ("/x/c", "c", None, None)],
                                  "path string, name string, size bigint, content binary")
    known = ingest.read_store(spark, str(tmp_path / "none"))
    assert rows(ingest.analyse_new(batch, known), "name", "status") == {
        ("a", "failed"), ("b", "failed"), ("c", "failed")}


def test_a_batch_reads_its_buckets_only(spark, tmp_path):
    out = str(tmp_path / "buckets")
    make = lambda names: spark.createDataFrame(
        [(f"/x/{n}", n, 4, bytearray(n.encode())) for n in names], "path string, name string, size bigint, content binary")
    many = [f"f{i}" for i in range(60)]
    ingest.ingest_batch(make(many), out, "s", 0)
    known = ingest.known_rows(spark, out, [hashlib.sha256(b"f7").hexdigest()[:2]], "s", 1)
    scanned = [f for f in known.inputFiles()]
    plan = known.select("sha256")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0]
    assert {r.bucket for r in known.collect()} == {hashlib.sha256(b"f7").hexdigest()[:2]} and scanned
    # Files of other buckets may even be unreadable.
    mine = {hashlib.sha256(n.encode()).hexdigest()[:2] for n in ("f7", "fresh")}
    for path in (tmp_path / "buckets").rglob("*.parquet"):
        if path.parent.name.removeprefix("bucket=") not in mine:
            path.write_bytes(b"broken")
            crc = path.with_name(f".{path.name}.crc")
            if crc.exists():
                crc.unlink()
    assert set(ingest.ingest_batch(make(["f7", "fresh"]), out, "s", 1)) == mine
    added = spark.read.parquet(f"{out}/stream=s/batch_id=1")
    assert rows(added, "name") == {("fresh",)}
