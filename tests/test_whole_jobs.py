"""Whole results and bounded tasks of queries that had lost some of either."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.functions import bytes as byte_functions
from tracefold.operators import behavior, content, features, graph, intel, tokens
from tracefold.plans.views import Tables
from tracefold.session import among


def test_nodes_hold_the_texts_of_their_blocks(spark):
    functions = spark.createDataFrame([(0, "f", 0, "sig", 9, False), (0, "x", 1, None, 8, True)],
                                      "graph_id long, func string, func_seq long, signature string, address long, is_external boolean")
    blocks = spark.createDataFrame([(0, "f", 5, 0, 50), (0, "f", 6, 1, 60)],
                                   "graph_id long, func string, block_id long, block_seq long, start long")
    code = spark.createDataFrame(
        [(0, "f", 5, i, "CALL" if i % 2 else "ADD", f"t{i}" if i != 1 else "") for i in range(12)]
        + [(None, None, 5, 0, "CALL", "no node")],
        "graph_id long, func string, block_id long, idx int, inst_type string, raw_text string")
    got = {r.name: (r.code, r.num_instructions) for r in graph.build_nodes(functions, blocks, code, texts=True).collect()}
    assert got == {"f": ("sig", 0), "x": ("x", 0), "block_6": ("", 0),
                   "block_5": ("\n".join(f"t{i}" for i in range(12) if i != 1), 12)}


def test_verdicts_hold_their_reports(spark):
    parts = spark.createDataFrame(
        [("a", i, "pe" if i % 2 else "script", f"f{i}", "BENIGN", 1.0, 2.0, f"r{i}") for i in range(5)]
        + [(None, 0, "pe", "f", "MALWARE", 9.0, 9.0, "r")],
        "analysis_id string, part_seq int, kind string, file_name string, verdict string, risk_score double, "
        "confidence double, report_markdown string")
    ids = spark.createDataFrame([("a",), ("b",)], "analysis_id string")
    got = {r.analysis_id: (r.verdict, r.report_markdown) for r in intel.aggregate_verdict(ids, parts).collect()}
    assert got["a"] == ("BENIGN", "".join(
        f"\n\n# {'PE' if i % 2 else 'Script'} Analysis: f{i}\nr{i}" for i in [1, 3, 0, 2, 4]))
    assert got["b"][1]


def test_pooling_shuffles_vectors_whole(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, None]), (3, None), (4, [])],
                                    "token_id int, vector array<float>")
    texts = spark.createDataFrame([(1, [1, 2]), (2, [3, 4]), (3, []), (4, [2]), (None, [1]), (5, [1]), (5, [2])],
                                  "text_id long, token_ids array<int>")
    pooled = tokens.pooled_name_vector(texts, vectors, 2)
    assert sorted(((r.text_id, r.vector) for r in pooled.collect()), key=repr) == sorted([
        (1, [2.0, 2.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0]), (4, [3.0, None]), (None, [0.0, 0.0]),
        (5, [2.0, 2.0]), (5, [2.0, 2.0])], key=repr)
    assert "posexplode" not in pooled._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_are_counted_in_bounded_pieces(spark):
    sections = spark.createDataFrame([(1, i, i % 50, 1 + i % 7) for i in range(3 * byte_functions.RANGES)],
                                     "file_id long, seq int, raw_ptr int, raw_size int")
    data = bytes(range(60))
    chunks = spark.createDataFrame([(1, 0, 0, 60, bytearray(data))],
                                   "file_id long, chunk long, offset long, n long, bytes binary")
    got = {r.seq: r.entropy for r in content.section_entropy(chunks, sections).collect()}
    assert got == {i: round(float(np.log2(len(data[i % 50:i % 50 + 1 + i % 7]))), 4) for i in range(len(got))}
    spans = F.array(F.struct(F.lit(0).alias("seq"), F.lit(0).alias("low"), F.lit(3).alias("high")))
    batch = chunks.select("file_id", "bytes", F.array_repeat(spans[0], 5000).alias("spans"))
    sizes = byte_functions.range_counts(batch).groupBy("file_id").count().first()["count"]
    assert sizes == 5000


def below_window(df):
    """Whether the keys are met before the rows are put in order."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return 0 <= plan.index("Window") < plan.rindex("LeftSemi")


@pytest.fixture
def tables(spark, tmp_path):
    lines = [(k, p, s, n, 5.0, 1.0, 0.0, 0.0, "R", "F") for k in (None, 1, 2, 2, 3, 9)
             for p, s, n in ((61, 4, 2), (62, 4, 1), (62, 5, 1), (None, 6, None))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                          "l_linestatus string").withColumn("l_shipdate", F.lit("2020-01-01").cast("timestamp")) \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    return Tables(spark, str(tmp_path))


@pytest.fixture
def keys(spark):
    return spark.createDataFrame([(2,), (2,), (3,), (7,), (None,)], "file_id long")


def rows(df):
    return sorted(map(str, df.collect()))


def test_sections_of_other_files_are_not_put_in_order(tables, keys):
    sections = tables("overlay_sections")
    some = among(sections, keys)
    assert below_window(some) and below_window(some.where("raw_ptr + raw_size > greatest(raw_ptr, 0)"))
    assert rows(some) == rows(sections.join(keys, "file_id", "left_semi")) and some.count() == 12


def test_entropy_moves_only_bytes_that_occur(spark):
    counts = lambda **seen: [seen.get(f"b{i}", 0) for i in range(256)]
    counted = spark.createDataFrame([(1, counts(b0=1, b7=2)), (1, counts(b7=1)), (2, counts()), (None, counts(b9=4)),
                                     (3, counts(b255=2, b1=2))], "k long, counts array<long>")
    merged = content.merged_entropy(counted, ["k"])
    got = {r.k: (r.bytes, round(r.entropy, 9)) for r in merged.collect()}
    assert got == {1: (4, round(0.75 * np.log2(4 / 3) + 0.5, 9)), 2: (0, 0.0), None: (4, 0.0), 3: (4, 1.0)}
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan[:plan.index("Generate posexplode")]


def test_parts_of_a_report_order_only_its_files(tables, keys, monkeypatch):
    written, cut = [], behavior.cut
    monkeypatch.setattr(behavior, "cut", lambda df: written.append(df) or cut(df))
    report = behavior.deep_report(keys, {
        "rows": lambda: tables("tls_pointers"),
        "counts": lambda: tables("overlay_sections").groupBy("file_id").agg(F.sum("raw_ptr").alias("n"))}).collect()
    assert len(written) == 3 and all(below_window(df) for df in written[1:])
    assert sorted((str(r.file_id), r.body) for r in report if r.part == "counts") == [
        ("2", '{"n":1440}'), ("2", '{"n":1440}'), ("3", '{"n":400}'), ("7", None), ("None", None)]


def test_kept_tables_have_the_rows_of_the_files_and_no_window(spark, tables, keys):
    whole = {name: tables(name) for name in ("imports", "overlay_sections")}
    for name, view in whole.items():
        tables.keep(name, keys)
        assert "Window" not in tables(name)._jdf.queryExecution().optimizedPlan().toString()
        assert rows(tables(name)) == rows(view.join(keys, "file_id", "left_semi")) and tables(name).count() > 3
    files = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "file_id long, content string")
    tables._loaded["files"] = files
    tables.keep("files")
    assert rows(tables("files")) == rows(files)
    tables._loaded["broken"] = broken = keys.selectExpr("file_id", "raise_error('bad row') AS n", "1 AS m")
    tables.keep("broken", keys)
    assert tables("broken") is broken and broken.select("file_id", "m").count() == 5
