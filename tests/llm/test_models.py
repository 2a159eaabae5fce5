"""Classifiers, near duplicates and the pipeline: held-out accuracy and brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tracefold.llm import embedding_dedup, language_id, minhash_dedup, quality, stages, toxicity
from tracefold.llm.components import components

DATA = "/root/testdata/sf0.01"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, node long")


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    label = {n: n for e in links for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    groups = lambda m: sorted(tuple(sorted(k for k in m if m[k] == v)) for v in set(m.values()))
    joined = {n for a, b in links if a != b for n in (a, b)}
    assert groups(got) == groups({n: v for n, v in label.items() if n in joined})


def vectors_expected(rows, cosine=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links[i].add(j)
    out = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min(rows[j][0] for j in seen)
        out.append((name, len(links[i]), low, low == name))
    return sorted(out)


def test_embedding_dedup(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    rows = [(i, list(map(float, base[i % 30] + 0.15 * rng.standard_normal(16)))) for i in range(150)]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None] * 16),
             (205, [float("inf")] + [1.0] * 15), (206, [1.0, 2.0]), (207, [2.0, 4.0])]
    rows += [(300 + i, rows[0][1]) for i in range(5)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, n string")
    want = vectors_expected(rows)
    for block in (1024, 8):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        got = sorted(tuple(r) for r in embedding_dedup.embedding_dedup(table, recall=0.99999).collect())
        assert got == want
    assert embedding_dedup.embedding_dedup(table.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold(spark):
    """Planted pairs just above the cosine, with the registered recall."""
    rng = np.random.default_rng(9)
    rows, pairs = [], 600
    for k in range(pairs):
        a, b = (v / np.linalg.norm(v) for v in rng.standard_normal((2, 64)))
        b -= (a @ b) * a
        cosine = rng.uniform(0.9001, 0.91)
        near = cosine * a + np.sqrt(1 - cosine ** 2) * b / np.linalg.norm(b)
        rows += [(2 * k, a.tolist()), (2 * k + 1, near.tolist())]
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()}
    assert sum(got[2 * k + 1].component_id == 2 * k for k in range(pairs)) >= 0.99 * pairs
    assert all(got[i].n_links <= 1 for i in got)


def test_one_large_class_of_near_copies(spark):
    """Every pair is a link and is counted once, whatever tables and blocks hold it."""
    rng = np.random.default_rng(10)
    base = rng.standard_normal(32)
    rows = [(i, (base + 0.01 * rng.standard_normal(32)).tolist()) for i in range(700)]
    rows += [(1000 + i, rng.standard_normal(32).tolist()) for i in range(300)]
    got = embedding_dedup.embedding_dedup(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert all((r.n_links, r.component_id) == (699, 0) for r in got if r.vec_id < 700)


def test_small_entries_are_counted_together(monkeypatch):
    """Entries of a few vectors share their passes; pairs of two entries stay apart."""
    import pyarrow as pa
    rng = np.random.default_rng(12)
    base = rng.standard_normal((200, 16)).repeat(4, axis=0)
    vec = base + rng.choice([0.02, 0.6], (800, 1)) * rng.standard_normal((800, 16))
    entries = np.arange(200).repeat(4)
    columns = {"entry": entries, "dim": np.full(800, 16, np.int32), "t": np.zeros(800, np.int32), "node": np.arange(800),
               "n": np.ones(800, np.int64), "codes": pa.array(list(entries.astype(np.int32)[:, None]), pa.list_(pa.int32())),
               "vec": pa.array([v.tobytes() for v in vec], pa.binary()), "one": np.zeros(800, np.int32),
               "two": np.zeros(800, np.int32), "side": np.zeros(800, np.int32)}
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))
    calls, plain = [], embedding_dedup.directions
    monkeypatch.setattr(embedding_dedup, "directions", lambda *a: calls.append(a) or plain(*a))
    solve = embedding_dedup.pairs_of(*embedding_dedup.needed_count(0.9, 0.99999), 0.9)
    links = np.zeros(800, np.int64)
    for out in solve(iter([whole.slice(0, 330), whole.slice(330)])):  # an entry lies in both batches
        np.add.at(links, out.column("node").to_numpy(), out.column("links").to_numpy())
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.9) & (entries[:, None] == entries)).sum(axis=1) - 1
    assert links.tolist() == want.tolist() and links.any()
    assert len(calls) < 10


def test_minhash_groups(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(25)]
    rows = []
    for k, text in enumerate(base):
        for copy in range(k % 5):
            near = list(text)
            near[rng.randrange(120)] = "edited%d" % copy
            rows.append((len(rows), " ".join(near if copy else text), k))
    rows += [(900, None, -1), (901, "", -2), (902, "one two", -3), (903, "One, two!", -3), (904, "...", -4)]
    docs = docs_of(spark, [(i, t, "en", "s", 5) for i, t, _ in rows])
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash_dedup.minhash_dedup(docs).collect()}
    first = {}
    for i, _, k in rows:
        first.setdefault(k, i)
    assert got == {i: (first[k], first[k] == i) for i, _, k in rows}
    assert minhash_dedup.minhash_dedup(docs.limit(0)).count() == 0


def test_minhash_links_that_miss_the_leader(spark):
    """A chain of edits: neighbours are similar, the ends are not."""
    rng = random.Random(4)
    text = ["w%d" % rng.randrange(10 ** 6) for _ in range(300)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(text), "en", "s", 5))
        for _ in range(4):
            text[rng.randrange(300)] = "x%d" % rng.randrange(10 ** 6)
    got = minhash_dedup.minhash_dedup(docs_of(spark, rows)).collect()
    assert {r.class_id for r in got} == {0}


def test_minhash_large_group_just_below_the_threshold(spark, monkeypatch):
    """Members that link with few others are not paired with all of their bands; blocks lose no link."""
    rng = random.Random(8)
    text = ["w%d" % rng.randrange(10 ** 6) for _ in range(120)]
    rows = []
    for i in range(500):
        near = list(text)
        for _ in range(3):
            near[rng.randrange(120)] = "x%d" % rng.randrange(10 ** 6)
        rows.append((i, " ".join(near), "en", "s", 5))
    sets = [{" ".join(w[k:k + 5]) for k in range(116)} for w in (r[1].split() for r in rows)]
    class_of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and class_of[i] != class_of[j]:
                low, high = sorted((class_of[i], class_of[j]))
                class_of = [low if c == high else c for c in class_of]
    assert 10 < len(set(class_of)) < 490
    compared, seen = minhash_dedup.compared, []

    def counted(pairs, texts, idf):
        seen.append(pairs.count())
        return compared(pairs, texts, idf)

    monkeypatch.setattr(minhash_dedup, "compared", counted)
    monkeypatch.setattr(minhash_dedup, "IDF", 0)  # plain sets of shingles
    monkeypatch.setattr(minhash_dedup, "BLOCK", 100, raising=False)
    got = {r.doc_id: r.class_id for r in minhash_dedup.minhash_dedup(docs_of(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == class_of
    # all pairs are 124,750; a round compares a member with a few leaders of its bands
    assert sum(seen) < 40_000, seen


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in language_id.language_id(docs).collect() if r.held_out]
    assert len(got) > 150 and np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.97


def test_language_edges(spark):
    rows = [(i, t, l, "s", 1) for i, (t, l) in enumerate(
        [("the cat and the dog", "en"), ("der hund und die katze", "de")] * 8
        + [(None, None), ("", "en"), ("123 !!", None), ("Ж", None), ("the dog", None)])]
    got = {r.doc_id: r for r in language_id.language_id(docs_of(spark, rows)).collect()}
    assert [got[i].lang_pred for i in (16, 17, 18)] == ["und"] * 3
    assert got[19].lang_pred in ("en", "de") and got[20].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.language_id(docs_of(spark, rows).limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.language_id(docs_of(spark, [(1, "abc", None, "s", 1)])).collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 3, 4, 6, 12])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert len({tuple(c) for c in code}) == n and (code != code[0]).any(axis=0).all()


def held_out(spark, found, column, data=DATA):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    return [(labels[r.doc_id], r.score) for r in found.collect() if r.held_out and r.doc_id in labels]


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = held_out(spark, quality.quality(docs, labels), "quality")
    assert np.mean([(s >= 0.5) == (y == 1) for y, s in got]) > 0.95


def test_toxicity_held_out(spark):
    """At sf0.1: the smaller folder has ten held-out toxic texts only."""
    data = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    got = held_out(spark, toxicity.toxicity(docs, labels), "toxic", data)
    right = [(y, (s >= 0.5) == (y == 1)) for y, s in got]
    assert np.mean([ok for _, ok in right]) > 0.95
    assert np.mean([ok for y, ok in right if y == 1]) > 0.85


def test_classifiers_without_labels_or_text(spark):
    docs = docs_of(spark, [(1, None, None, None, 1), (2, "", "en", "s", 1), (None, "some words", "en", "s", 1),
                           (3, "y" * 200_000, "en", "s", 1), (3, "again", "en", "s", 1)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert [r.rejected for r in quality.quality(docs, none).collect()] == [False] * 5
    some = spark.createDataFrame([(2, 1, 0), (3, 0, 1), (None, None, None), (1, 0, 1)], none.schema)
    for found in (toxicity.toxicity(docs, some), quality.quality(docs, some)):
        assert all(0 <= r.score <= 1 for r in found.collect())
    assert toxicity.toxicity(docs.limit(0), some).count() == 0
    assert quality.quality(docs.limit(0), some).count() == 0


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("source", "source")
    docs = docs.selectExpr("*", "'kept' AS row", "1 AS dropped", "2 AS nth", "doc_id AS id")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for out in (stages.good_quality(docs, labels), stages.without_repeated_lines(docs),
                stages.one_of_each_group(docs), stages.uncontaminated(docs, bench)):
        assert out.schema.names == docs.schema.names and 0 < out.count() <= 200


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert 0 < got.count() < 200


def test_windows_cover_long_runs_between_characters():
    assert toxicity.windows(b"word") == [b"word"]
    run = "".join(chr(0x4E00 + i) for i in range(210)).encode()
    found = toxicity.windows(run)
    assert all(w.decode() and len(w) <= toxicity.WINDOW + 3 for w in found)
    assert found[0] == run[:len(found[0])] and found[-1] == run[-len(found[-1]):]
    at, covered = 0, 0
    for w in found:  # every window begins inside the last one
        at = run.index(w, at)
        assert at <= covered
        covered = max(covered, at + len(w))
    assert covered == len(run)
