"""Content in chunks gives what whole content gives, also for patterns across borders."""

import random
from collections import Counter
from math import log2

import pytest
from pyspark.sql import functions as F

from tracefold.operators import content
from tracefold.sources.chunks import chunk_store, chunked, read_chunks

SIZE, OVERLAP = 512, 512


def entropy(data):
    return abs(sum(c / len(data) * log2(c / len(data)) for c in Counter(data).values())) if data else 0.0


def contents():
    rng = random.Random(4)
    out = [b"", b"x", bytes(range(256)) * 5, b"a" * 2000 + b"PE\0\0" + b"b" * 100]
    out += [bytes(rng.randrange(256) for _ in range(n)) for n in (511, 512, 513, 1700, 2048, 4099)]
    border = bytearray(b"z" * 3000)
    border[1022:1026] = b"PE\0\0"  # half in one chunk, half in the next
    return out + [bytes(border), b"q" * 1024 + b"PK\x03\x04" + b"r" * 500]


def table(spark):
    rows = [(i, bytearray(c)) for i, c in enumerate(contents())] + [(99, None)]
    return spark.createDataFrame(rows, "file_id bigint, content binary")


@pytest.fixture(scope="module")
def chunks(spark):
    return chunk_store(chunked(table(spark), SIZE, OVERLAP))


def test_chunks_hold_all_bytes_once(chunks):
    whole = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.file_id, r.chunk)):
        assert len(r.bytes) <= SIZE + OVERLAP and r.offset == len(whole.get(r.file_id, b""))
        whole[r.file_id] = whole.get(r.file_id, b"") + bytes(r.bytes[:r.n])
    assert whole == {**dict(enumerate(contents())), 99: b""}


def test_entropy(chunks):
    got = {r.file_id: (r.bytes, r.entropy) for r in content.content_entropy(chunks).collect()}
    for i, data in [*enumerate(contents()), (99, b"")]:
        assert got[i][0] == len(data) and abs(got[i][1] - entropy(data)) < 1e-9


def test_window_means(chunks):
    got = {(r.file_id, r.pos): r.mean for r in content.byte_chunk_means(chunks).collect()}
    want = {(i, p // 256): sum(w) / len(w) / 255 for i, data in enumerate(contents())
            for p in range(0, len(data), 256) for w in [data[p:p + 512]]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_sections_and_overlay(spark, chunks):
    rng = random.Random(6)
    rows = [(i, s, rng.randrange(2500), rng.choice([0, 1, 300, 1500, 9000])) for i in range(12) for s in range(5)]
    rows += [(50, 0, 0, 10)]  # a section of a file that is not there
    sections = spark.createDataFrame(rows, "file_id bigint, seq int, raw_ptr bigint, raw_size bigint")
    got = {(r.file_id, r.seq): r.entropy for r in content.section_entropy(chunks, sections, SIZE).collect()}
    data = dict(enumerate(contents()))
    assert got == {(i, s): round(entropy(data.get(i, b"")[p:p + n]), 4) for i, s, p, n in rows}
    some = [(i, 0, p, 0) for i, p in ((3, 1500), (4, 100), (7, 0), (9, 4030), (10, 900), (10, 1023), (11, 1024))]
    for one in (some[:4] + [some[4], some[6]], some[5:6]):
        ends = spark.createDataFrame(one, "file_id bigint, seq int, raw_ptr bigint, raw_size bigint")
        rows_of = {r.file_id: r for r in content.overlay(chunks, ends, SIZE).collect()}
        for i, _, p, _ in one:
            tail = data[i][p:]
            there = len(tail) > 64
            r = rows_of[i]
            assert (r.has_overlay, r.overlay_size, r.overlay_offset) == (there, len(tail) * there, p * there)
            assert r.overlay_entropy == (round(entropy(tail), 4) if there else 0)
            assert r.embedded_pe == (there and b"PE\0\0" in tail)
            assert r.archive_detected == ("ZIP" if there and tail.startswith(b"PK\x03\x04") else "none")


def test_overlay_moves_no_content(spark, chunks):
    ends = spark.createDataFrame([(1, 0, 5, 5)], "file_id bigint, seq int, raw_ptr bigint, raw_size bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(
            content.overlay(chunks, ends, SIZE)._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    inputs = [line for line in text.split(") Exchange\n")[1:]]
    assert inputs and all("bytes#" not in part.split("\n")[0] for part in inputs)


def test_files_are_read_in_ranges(spark, tmp_path):
    data = bytes(range(256)) * 40
    (tmp_path / "a b.bin").write_bytes(data)
    (tmp_path / "empty.bin").write_bytes(b"")
    found = read_chunks(spark, str(tmp_path), 1000, 10)
    rows = {r.chunk: r for r in found.where(F.col("path").endswith("bin")).collect()}
    assert len(rows) == 11 and b"".join(bytes(rows[i].bytes[:rows[i].n]) for i in range(11)) == data
    assert bytes(rows[0].bytes) == data[:1010]
