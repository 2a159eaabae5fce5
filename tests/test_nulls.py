"""Rows with nulls, ties and repeats stay."""

from tracefold.operators import evaluate, features, ordering, text_rules
from tracefold.sources import store


def test_split_keeps_samples_without_a_label(spark):
    samples = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(40)],
                                    "file_id bigint, label int")
    assert evaluate.stratified_split(samples).count() == 40


def test_running_total_over_a_null_group(spark):
    rows = spark.createDataFrame([(None if i < 3 else "g", i) for i in range(6)], "g string, i int")
    got = {(r["g"], r["i"]): r["row_index"] for r in ordering.number_rows(rows, ["i"], ["g"]).collect()}
    assert got == {(None, 0): 0, (None, 1): 1, (None, 2): 2, ("g", 3): 0, ("g", 4): 1, ("g", 5): 2}


def test_dedupe_keeps_files_without_content(spark):
    files = spark.createDataFrame([(1, None), (2, bytearray(b"x")), (3, bytearray(b"x")), (4, None)],
                                  "file_id bigint, content binary")
    assert sorted(r["file_id"] for r in features.dedupe_content(files).collect()) == [1, 2, 4]


def test_upsert_with_null_hashes_and_ties(spark):
    schema = "id string, file_hash string, created_at int"
    stored = spark.createDataFrame([("a", None, 1), ("b", None, 1), ("c", "h", 1)], schema)
    incoming = spark.createDataFrame([("d", "k", 2), ("d", "k", 2), ("d", "k", 2)], schema)
    got = sorted(r["id"] for r in store.upsert_analyses(stored, incoming).collect())
    assert got == ["a", "b", "c", "d"]


def test_every_module_of_an_import(spark):
    code = "import a, b.c as d\nfrom . import x\nfrom .. import y\nfrom .e import f\n  import g\n"
    scripts = spark.createDataFrame([(1, "py", code)], "file_id bigint, lang string, code string")
    got = [r["module"] for r in text_rules.script_imports(scripts).orderBy("pos").collect()]
    assert got == ["a", "b.c", ".e", "g"]


def test_names_that_differ_late_stay_apart(spark):
    from tracefold.operators import identity
    from pyspark.sql import functions as F
    names = spark.createDataFrame([("n" * 300 + c,) for c in "ab"], "name string")
    assert names.select(identity.safe_file_name(F.col("name"))).distinct().count() == 2
