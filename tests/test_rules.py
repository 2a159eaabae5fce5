"""Thresholds, names, paths and text rules on hand-made rows."""

import posixpath

import pytest
from pyspark.sql import functions as F

from tracefold.operators import behavior, evaluate, identity, layout, text_rules, tokens


def col(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def test_suffix(spark):
    names = ["a.exe", ".bashrc", "x.", "a.tar.gz", "none", "..b", "a b.c d"]
    assert col(spark, names, "string", identity.suffix) == [
        ".exe", "", "", ".gz", "", ".b", ".c d"]


def test_member_paths(spark):
    paths = ["a/b", "/a", "../x", "a/../../x", "a/./b//c", "..x", "\\a", "", "a/..", "./.."]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(paths)],
                               "container_id int, member_seq int, member_path string")
    got = {r["member_seq"]: r["safe_path"] for r in identity.safe_member_path(df).collect()}
    want = {i: posixpath.normpath(p.lstrip("/\\")) for i, p in enumerate(paths)}
    want = {i: p for i, p in want.items() if not p.startswith("..")}
    assert got == want


def test_disk_path_rejects_dots(spark):
    df = spark.createDataFrame([("/a\\b", "c\\d.txt"), ("..", "x"), ("", "x"), ("a", "..")],
                               "d string, n string")
    got = [r["p"] for r in df.select(identity.safe_disk_path(F.col("d"), F.col("n")).alias("p"))
           .collect()]
    assert got == ["a/b/d.txt", None, "x", None]


def test_file_names(spark):
    assert col(spark, ['a<b>:"c', "", "x" * 300, "a\x01b"], "string", identity.safe_file_name) == [
        "a_b___c", "unnamed", "x" * 300, "a_b"]
    assert col(spark, ["a b/é9.-_!"], "string", identity.upload_file_name) == ["abé9.-_"]


SECTION = ("file_id int, seq int, name string, va bigint, virtual_size bigint, raw_ptr bigint, "
           "raw_size bigint, flags bigint, entropy double")


def flags_of(spark, *row):
    df = spark.createDataFrame([row], SECTION)
    return {r["type"] for r in layout.section_red_flags(df).collect()}


@pytest.mark.parametrize("virt,size,entropy,flags,name,want", [
    (10, 10, 7.2, 0, ".text", set()),
    (10, 10, 7.2001, 0, ".text", {"high_entropy"}),
    (30, 10, 0.0, 0, ".text", set()),
    (31, 10, 0.0, 0, ".text", {"size_mismatch"}),
    (0x1000, 0, 0.0, 0, ".text", set()),
    (0x1001, 0, 0.0, 0, ".text", {"size_mismatch"}),
    (1, 1, 0.0, 0xE0000000, ".text", {"rwx_section"}),
    (1, 1, 0.0, 0, ".TEXT", {"unusual_section_name"}),
    (1, 1, 0.0, 0, "", set()),
])
def test_section_flags(spark, virt, size, entropy, flags, name, want):
    assert flags_of(spark, 1, 0, name, 0, virt, 0, size, flags, entropy) == want


def test_one_decimal(spark):
    values = [15.25, 15.35, 3.05, 4.75, 12.0, 3.149999, 0.05, 99.95, 7.349999999999999]
    got = col(spark, values, "double", layout.one_decimal)
    assert got == [f"{v:.1f}" for v in values]


def test_packing_scores_without_sections(spark):
    files = spark.createDataFrame([(1,), (2,)], "file_id int")
    rows = [(2, i, "s", 0, 1, 0, 1, 0xE0000000, 7.9) for i in range(9)]
    got = dict(layout.packing_likelihood(files, spark.createDataFrame(rows, SECTION))
               .select("file_id", "packing_likelihood").collect())
    assert got == {1: 10, 2: 90}


def test_chain_share(spark):
    def names(*apis):
        rows = [(1, i, "k.dll", a, 0, 4096 + i, False) for i, a in enumerate(apis)]
        df = spark.createDataFrame(rows, "file_id int, seq bigint, dll string, func string, "
                                         "ordinal int, address bigint, delayed boolean")
        return {r["signature_name"]: r for r in behavior.behavior_chains(df).collect()}
    hollow = names("CreateProcessA", "VirtualAllocEx", "ResumeThread")
    assert hollow["Process Hollowing"]["confidence"] == 60
    assert hollow["Process Hollowing"]["missing_apis"] == ["NtUnmapViewOfSection",
                                                           "WriteProcessMemory"]
    assert "Process Injection" not in hollow
    assert names("RegCreateKeyExW") == {}


def test_categories_of_paths_and_keys(spark):
    rows = [(1, s) for s in [r"C:\Windows\a.dll", r"HKLM\Software\Run", r"x%TEMP%\a", "a@b.co",
                             "A" * 40, "A" * 39, "http://h/x", " 1.2.3.4 ", "  "]]
    got = {}
    for r in text_rules.categorize_strings(
            spark.createDataFrame(rows, "file_id int, s string")).collect():
        got.setdefault(r["category"], set()).add(r["s"])
    assert got["file_paths"] == {r"C:\Windows\a.dll", r"x%TEMP%\a"}
    assert got["registry_keys"] == {r"HKLM\Software\Run"}
    assert got["base64_blobs"] == {"A" * 40}
    assert got["urls"] == {"http://h/x"} and got["ip_addresses"] == {"1.2.3.4"}
    assert got["emails"] == {"a@b.co"}


def test_script_offsets(spark):
    code = "x function a(b) {}\n function  cc (d, e) {}"
    df = spark.createDataFrame([(1, "js", code), (2, "js", "none")],
                               "file_id int, lang string, code string")
    got = {(r["file_id"], r["func"]): r["address"]
           for r in text_rules.script_function_offsets(df).collect()}
    assert got == {(1, "__main__"): 0, (1, "a"): code.index("function a"),
                   (1, "cc"): code.index("function  cc"), (2, "__main__"): 0}


def test_script_calls(spark):
    rows = [(1, "js", "a(b (c))"), (2, "ps1", "Get-X; Set-Y; Get-X; Foo-Z"),
            (3, "bat", " call a\n@CALL b\nstart\nstart c\nxcmd d")]
    got, places = {}, {}
    for r in text_rules.script_calls(spark.createDataFrame(
            rows, "file_id int, lang string, code string")).orderBy("file_id", "pos").collect():
        got.setdefault(r["file_id"], []).append(r["call"])
        places.setdefault(r["file_id"], []).append(r["address"])
    assert got == {1: ["a", "b"], 2: ["Get-X", "Set-Y"], 3: ["call a", "@CALL b", "start c"]}
    assert places == {1: [0, 2], 2: [0, 7], 3: [1, 8, 22]}


def test_offsets_of_a_long_script_are_linear(spark):
    code = "function f(a) {}\n" * 40_000
    df = spark.createDataFrame([(1, "js", code), (2, "js", None), (3, "js", ""), (4, "go", "function f() {}")],
                               "file_id int, lang string, code string")
    found = text_rules.script_function_offsets(df).where("func <> '__main__'")
    row = found.groupBy("file_id").agg(F.count("*").alias("n"), F.max("address").alias("last")).collect()
    assert [tuple(r) for r in row] == [(1, 40_000, 17 * 39_999)]
    assert {r.file_id for r in text_rules.script_calls(df).collect()} == {1}


def test_report_tables_in_pieces(spark, monkeypatch):
    from functools import partial
    monkeypatch.setattr(text_rules, "running_counts", partial(text_rules.running_counts, piece_rows=3))
    one = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\ntext\n|---|\n| x |\n\n" + "| r |\n" * 7
    rows = [("k", one), ("k", "| z |"), ("n", None), ("m", "no | table")]
    df = spark.createDataFrame(rows, "analysis_id string, report_markdown string").repartition(2)
    got = sorted((r.table_id, r.row_pos, r.row_kind, r.cell_pos, r.cell.strip())
                 for r in text_rules.report_tables(df).collect())
    want = [(1, 0, "header", 0, "a"), (1, 0, "header", 1, "b"), (1, 1, "data", 0, "1"), (1, 1, "data", 1, "2"),
            (1, 2, "data", 0, "3"), (1, 2, "data", 1, "4"), (2, 3, "data", 0, "x"), (3, 4, "header", 0, "r")]
    want += [(3, i, "data", 0, "r") for i in range(5, 11)] + [(1, 0, "header", 0, "z")]
    assert got == sorted(want)


def test_verdict_spellings(spark):
    rows = [("1", "pe", "x", "Verdict: benign"), ("2", "pe", "VERDICT**: MALWARE", "benign"),
            ("3", "pe", "", ""), ("4", "script", "z" * 1500 + "malware", ""),
            ("5", "script", "malware risk score: 12, confidence** : 3", ""),
            ("6", "pe", "Threat Matrix Score *: 9", "it is benign")]
    got = {r["analysis_id"]: (r["verdict"], r["risk_score"], r["confidence"])
           for r in text_rules.verdict_parse(spark.createDataFrame(
               rows, "analysis_id string, kind string, report_markdown string, "
                     "comparator_text string")).collect()}
    assert got == {"1": ("BENIGN", 20, 90), "2": ("MALWARE", 75, 85), "3": ("MALWARE", 75, 85),
                   "4": ("MALWARE", 70, 80), "5": ("MALWARE", 12, 80), "6": ("BENIGN", 9, 90)}


def test_abstract_values(spark):
    numbers = ["-1001", "-1000", "1000", "1001", "0", "255", "18446603336221196288",
               "18446603336221196287", "4194304", "4194303"]
    df = spark.createDataFrame([(n,) for n in numbers], "v string").select(
        F.col("v").cast("decimal(20,0)").alias("v"))
    got = [r["t"] for r in df.select(tokens.abstract_number(F.col("v")).alias("t")).collect()]
    assert got == ["<LARGE_INT>", "<INT_-1000>", "<INT_1000>", "<LARGE_INT>", "<MAGIC_0x0>",
                   "<MAGIC_0xff>", "<MEM_ADDR>", "<LARGE_INT>", "<MEM_ADDR>", "<LARGE_INT>"]
    texts = ["ABCDEF012", "ABCDEF01", "abc\n", "x" * 17, "/etc/x", "/Etc/x", None]
    assert col(spark, texts, "string", tokens.abstract_string) == [
        "<HEX_STRING>", "<STR_ABCDEF01>", "<STR_abc_>", "<LONG_STRING>", "<PATH>",
        "<STR__Etc_x>", "<NULL>"]


def test_threshold_and_metrics_edges(spark):
    rows = spark.createDataFrame([(1, 1, 0.85), (2, 1, 0.849), (3, 1, 0.5), (4, 1, 0.1)],
                                 "sample_id int, class int, prob double")
    got = {r["sample_id"]: (r["prediction"], r["needs_review"])
           for r in evaluate.threshold_predict(rows).collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (1, True), 4: (0, False)}
    none = spark.createDataFrame([], "prediction int, label int")
    assert evaluate.classification_metrics(none).count() == 0
    one_class = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert evaluate.roc_auc(one_class).collect()[0]["auc"] == 0.0
    tied = spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, label int")
    assert evaluate.roc_auc(tied).collect()[0]["auc"] == 0.5
