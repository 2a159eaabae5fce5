"""Byte operators against plain Python on hand-made content."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tracefold.operators import behavior, features, identity, layout, text_rules

random.seed(7)
CONTENTS = [
    b"", b"a", b"\0" * 300, bytes(range(256)), b"MZ" + bytes(range(256)) * 5,
    random.randbytes(513), random.randbytes(1024), b"x" * 511 + b"\xff",
    "wide text".encode("utf-16le"), b"\x01" + "odd text".encode("utf-16le"),
    b"abc\x00abcd\x7fabcde\x80abcdef", b"\xe8\x01\x00\x00\x00\xc3\xeb\xfe\xe9\xff\xff\xff\xff\xe8\x00",
    b"\xe8\xe8\xe8\xe8\xe8\xe8", b"\xeb",
]


def table(spark):
    rows = [(i, bytearray(c)) for i, c in enumerate(CONTENTS)]
    return spark.createDataFrame(rows, "file_id bigint, content binary")


def entropy(data):
    if not data:
        return 0.0
    return -sum(c / len(data) * math.log2(c / len(data)) for c in Counter(data).values())


def test_entropy(spark):
    got = {r["file_id"]: r for r in layout.file_entropy(table(spark)).collect()}
    for i, data in enumerate(CONTENTS):
        assert abs(got[i]["file_entropy"] - entropy(data)) < 1e-4
        assert 0 <= got[i]["file_entropy"] <= 8
    assert got[0]["entropy_class"] == "unknown"
    assert got[2]["entropy_class"] == "mostly empty"
    assert got[3]["file_entropy"] == 8.0 and got[3]["entropy_class"] == "encrypted/packed"


def test_strings_any_alignment(spark):
    got = {}
    for r in text_rules.extract_strings(table(spark)).orderBy("file_id", "pos").collect():
        got.setdefault(r["file_id"], []).append(r["s"])
    for i, data in enumerate(CONTENTS):
        want = [m.decode() for m in re.findall(rb"[\x20-\x7e]{4,}", data)]
        want += [m.replace(b"\0", b"").decode()
                 for m in re.findall(rb"(?:[\x20-\x7e]\x00){4,}", data)]
        assert got.get(i, []) == want


def test_distinct_strings_use_even_offsets(spark):
    got = text_rules.extract_strings_distinct(table(spark)).collect()
    assert (8, "wide text") in [tuple(r) for r in got]
    assert (9, "odd text") not in [tuple(r) for r in got]


def test_distinct_strings_long_input(spark):
    data = bytearray(b"\x01\x02" * 200_000 + "tail".encode("utf-16le"))
    df = spark.createDataFrame([(1, data)], "file_id bigint, content binary")
    assert [r["s"] for r in text_rules.extract_strings_distinct(df).collect()] == ["tail"]


def test_opcodes_at_every_position(spark):
    code = table(spark).select("file_id", F.lit(0).alias("seq"), F.lit(1000).alias("base_addr"),
                               F.col("content").alias("data"))
    got = {(r["file_id"], r["address"], r["type"], r["target"])
           for r in behavior.code_patterns(code).collect()}
    want = set()
    for i, data in enumerate(CONTENTS):
        if len(data) < 2:
            continue
        for p, byte in enumerate(data):
            at = 1000 + p
            if byte in (0xE8, 0xE9) and p + 4 < len(data):
                jump = int.from_bytes(data[p + 1:p + 5], "little", signed=True)
                want.add((i, at, "CALL" if byte == 0xE8 else "BRANCH", at + 5 + jump))
            elif byte == 0xC3:
                want.add((i, at, "RETURN", None))
            elif byte == 0xEB and p + 1 < len(data):
                jump = int.from_bytes(data[p + 1:p + 2], "little", signed=True)
                want.add((i, at, "BRANCH", at + 2 + jump))
    assert got == want


def test_chunk_means(spark):
    got = {}
    for r in features.byte_chunk_means(table(spark)).collect():
        got.setdefault(r["file_id"], {})[r["pos"]] = r["mean"]
    for i, data in enumerate(CONTENTS):
        want = [sum(w) / len(w) / 255 for w in (data[p:p + 512] for p in range(0, len(data), 256))]
        means = got.get(i, {})
        assert len(means) == len(want)
        assert all(abs(means[p] - w) < 1e-9 for p, w in enumerate(want))


def test_byteplot(spark):
    rows = features.byteplot_rows(table(spark)).collect()
    by_file = {}
    for r in sorted(rows, key=lambda r: (r["file_id"], r["row"])):
        by_file.setdefault(r["file_id"], b"")
        by_file[r["file_id"]] += bytes(r["pixels"])
    for i, data in enumerate(CONTENTS):
        if data:
            assert by_file[i][:len(data)] == data and set(by_file[i][len(data):]) <= {0}
            assert len(by_file[i]) % 32 == 0


def test_iso_mark_and_magic_order(spark):
    iso = bytes(32769) + b"CD001" + b"\0" * 8
    short = bytes(32769) + b"CD001"
    rows = [(1, bytearray(iso)), (2, bytearray(short)), (3, bytearray(b"\x1f\x8b\x08")),
            (4, bytearray(b"MZ")), (5, bytearray(b""))]
    df = spark.createDataFrame(rows, "file_id bigint, content binary")
    got = dict(identity.identify_magic(df).select("file_id", "magic_type").collect())
    assert got == {1: "iso", 2: None, 3: "gz", 4: "exe", 5: None}


def test_overlay_boundary(spark):
    files = spark.createDataFrame(
        [(1, bytearray(b"a" * 164)), (2, bytearray(b"a" * 165)), (3, bytearray(b"MZ" + b"b" * 99))],
        "file_id bigint, content binary")
    sections = spark.createDataFrame([(1, 0, 100), (2, 0, 100)],
                                     "file_id bigint, raw_ptr bigint, raw_size bigint")
    got = {r["file_id"]: r for r in layout.overlay(files, sections).collect()}
    assert not got[1]["has_overlay"] and got[2]["has_overlay"]
    assert got[2]["overlay_size"] == 65 and got[2]["overlay_offset"] == 100
    assert got[3]["overlay_offset"] == 0 and got[3]["embedded_pe"]
