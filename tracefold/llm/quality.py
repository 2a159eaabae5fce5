"""Quality classification by co-training two views.

The text view looks at words and characters (repetition, upper case, symbols, digits);
the page view at what is known without reading (source, language, size, lines and how they
are filled); no feature is in both.  Both are logistic models that start from a bounded sample of
labelled documents.  The features of all documents are written once.  In each round every
unlabelled document is scored by both views, and a view passes the documents it is surest
about, a bounded number of all of them, to the other one.  At the end the views are
calibrated on labelled documents and combined.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tracefold.llm.common import crc_fold, cut
from tracefold.llm.logistic import fit_logistic, probability
from tracefold.llm.textcore import column_bytes, lists, mix, pieces, row_of, words

FOLDS, HELD_OUT = 5, 0
BUCKETS = 16  # hashed source and language values


@dataclass(frozen=True)
class Settings:
    sample: int = 3000      # labelled texts of each class
    rounds: int = 5
    exchanged: int = 100    # pseudo-labels per class, view and round
    reject: float = 0.3     # documents scored below are rejected


_KIND = np.array([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b in (32, 9)
                  else 5 if b == 10 else 6 if b in b".,;:'\"-()?" else 7 if b < 128 else 8 for b in range(256)], np.uint8)


def share(hit: np.ndarray, offsets: np.ndarray, size: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], np.cumsum(hit)])
    return (before[offsets[1:]] - before[offsets[:-1]]) / np.maximum(size, 1)


def spread(column: np.ndarray) -> np.ndarray:
    """A share in [0, 1] on two scales."""
    return np.stack([column, np.sqrt(column)], axis=1)


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Repetition and character mix of each row."""
    size = np.diff(offsets)
    kind = _KIND[data]
    hashes, bounds = words(data, offsets)
    count, row = np.diff(bounds), row_of(bounds)
    rows = len(size)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, bool)
    heads = np.flatnonzero(fresh)
    times = np.diff(np.append(heads, len(h)))
    distinct = np.bincount(r[heads], minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, r[heads], times)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    pair = mix(hashes[:-1] * np.uint64(31) + hashes[1:]) if len(hashes) > 1 else hashes[:0]
    pr = row[:len(pair)]
    po = np.lexsort((pair, pr))
    twice = np.zeros(len(pair), bool)
    twice[1:] = (pair[po][1:] == pair[po][:-1]) & (pr[po][1:] == pr[po][:-1])
    upper, lower, symbol = kind == 1, kind == 2, kind == 7
    run = np.zeros(len(data), bool)
    run[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    full = np.maximum(count, 1)
    long = np.log1p(count) / 10
    letters = share(upper | lower | (kind == 8), offsets, size)
    return np.hstack([
        spread(1 - distinct / full), spread(top / full), spread(np.bincount(row, again, rows) / full),
        spread(np.bincount(pr[po], twice, rows) / full), spread(share(upper, offsets, size)),
        spread(share(symbol, offsets, size)), spread(share(run, offsets, size)), spread(share(kind == 3, offsets, size)),
        letters[:, None], (letters * size / full / 20)[:, None],
        (long * (1 - distinct / full))[:, None], (count == 0).astype(float)[:, None]])


def page_view(data: np.ndarray, offsets: np.ndarray, sources: list, langs: list) -> np.ndarray:
    """Source, language, size and layout of each row."""
    size = np.diff(offsets)
    hot = np.zeros((len(size), 2 * BUCKETS))
    for i, (source, lang) in enumerate(zip(sources, langs)):
        hot[i, zlib.crc32(str(source).encode()) % BUCKETS] = 1
        hot[i, BUCKETS + zlib.crc32(str(lang).encode()) % BUCKETS] = 1
    breaks = share(data == 10, offsets, size)
    filled = np.log1p(1 / np.maximum(breaks, 1 / np.maximum(size, 1))) / 10
    return np.hstack([hot, (np.log1p(size) / 10)[:, None], breaks[:, None], filled[:, None], (size == 0)[:, None]])


def inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"),
                       F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))


def views(batch: pa.RecordBatch):
    """(first row, last row, text features, page features) in pieces of bounded size."""
    data, offsets = column_bytes(batch.column("text"))
    sources, langs = batch.column("source").to_pylist(), batch.column("lang").to_pylist()
    for first, last in pieces(offsets):
        o = offsets[first:last + 1]
        own, at = data[o[0]:o[-1]], o - o[0]
        yield first, last, text_view(own, at), page_view(own, at, sources[first:last], langs[first:last])


@dataclass
class Model:
    text: np.ndarray | None = None
    page: np.ndarray | None = None
    both: np.ndarray | None = None

    def score(self, text: np.ndarray, page: np.ndarray):
        if self.both is None:
            return np.ones(len(text)), np.ones(len(text)), np.ones(len(text))
        p, q = probability(self.text, text), probability(self.page, page)
        return p, q, probability(self.both, np.stack([logit(p), logit(q)], axis=1))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


FEATURES = "row long, doc_id long, text array<float>, page array<float>"


def feature_table(docs: DataFrame) -> DataFrame:
    """Both views of every document, written as a table; the texts are read once."""
    def run(batches):
        for batch in batches:
            for first, last, text, page in views(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(first, last - first), batch.column("doc_id").slice(first, last - first),
                     *(lists(v.astype(np.float32).ravel(), np.full(len(v), v.shape[1]), pa.float32())
                       for v in (text, page))], names=["row", "doc_id", "text", "page"])

    rows = inputs(docs).withColumn("row", F.monotonically_increasing_id())
    return cut(rows.mapInArrow(run, FEATURES))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy().astype(np.float64)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def surest(pool: DataFrame, fitted: list[np.ndarray], taken: set[int], count: int) -> list:
    """Of all unlabelled documents the ``count`` surest ones per view and class.

    Every task passes on at most that many of its own, so the driver gets a bounded number.
    """
    def run(batches):
        best: dict[tuple, list] = {}
        for batch in batches:
            rows = batch.column("row").to_numpy()
            free = ~np.isin(rows, list(taken))
            sides = matrix(batch.column("text")), matrix(batch.column("page"))
            for v in (0, 1):
                p = probability(fitted[v], sides[v])
                for label, sure in ((1, p), (0, 1 - p)):
                    at = np.flatnonzero(free & (sure >= 0.9))
                    at = at[np.lexsort((rows[at], -sure[at]))[:count]]
                    held = best.setdefault((v, label), [])
                    held += [(-float(sure[i]), int(rows[i]), sides[0][i].tolist(), sides[1][i].tolist()) for i in at]
                    held.sort(key=lambda r: r[:2])
                    del held[count:]
        rows = [{"view": v, "label": label, "order": o, "row": r, "text": t, "page": g}
                for (v, label), held in best.items() for o, r, t, g in held]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("view", pa.int32()), ("label", pa.int32()), ("order", pa.float64()), ("row", pa.int64()),
                        ("text", pa.list_(pa.float64())), ("page", pa.list_(pa.float64()))])
    found = pool.mapInArrow(run, "view int, label int, order double, row long, text array<double>, page array<double>")
    def leading(rows: DataFrame, keys: list[str]) -> DataFrame:
        place = F.row_number().over(W.partitionBy(*keys).orderBy("order", "row"))
        return rows.withColumn("place", place).where(F.col("place") <= count)

    parts = leading(found.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(64))), ["view", "label", "part"])
    return leading(parts, ["view", "label"]).orderBy("view", "label", "place").collect()


def co_train(text: np.ndarray, page: np.ndarray, y: np.ndarray, pool: DataFrame, settings: Settings) -> Model:
    """Fit both views; two thirds of the labelled rows train, the rest calibrate."""
    held = np.arange(len(y)) % 3 == 2
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    sets = [[(v[~held], y[~held])] for v in (text, page)]
    taken: set[int] = set()
    fitted = [None, None]
    for turn in range(settings.rounds + 1):
        for v in (0, 1):
            fitted[v] = fit_logistic(np.vstack([x for x, _ in sets[v]]), np.concatenate([t for _, t in sets[v]]))
        if turn == settings.rounds:
            break
        found = surest(pool, fitted, taken, settings.exchanged)
        for r in found:
            if r["row"] not in taken:  # each document goes to one view only
                taken.add(r["row"])
                other = np.array([r["page"] if r["view"] == 0 else r["text"]])
                sets[1 - r["view"]].append((other, np.array([r["label"]])))
        if not found:
            break
    test = held if held.any() else ~held
    z = np.stack([logit(probability(fitted[0], text[test])), logit(probability(fitted[1], page[test]))], axis=1)
    return Model(fitted[0], fitted[1], fit_logistic(z, y[test]))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), table: DataFrame | None = None) -> Model:
    """Co-train on a bounded sample of labelled rows outside the held-out fold (in hash order) and
    on all rows without a label; ``table`` is the :func:`feature_table` of ``docs`` when it is there."""
    table = feature_table(docs) if table is None else table
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality")))
    train = known.where(crc_fold(FOLDS) != HELD_OUT)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = [train.where(F.col("quality") == k).orderBy(*order).limit(settings.sample) for k in (0, 1)]
    sample = table.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")  # 2 * sample rows at most
    # One row per labelled document, whatever copies of its id there are.
    sample = sample.groupBy("doc_id", "quality").agg(F.min(F.struct("row", "text", "page")).alias("v"))
    rows = sorted(sample.select("doc_id", "quality", "v.text", "v.page").collect(),
                  key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    y = np.array([r["quality"] for r in rows])
    if not {0, 1} <= set(y.tolist()):
        return Model()
    text, page = np.array([r["text"] for r in rows]), np.array([r["page"] for r in rows])
    pool = cut(table.join(known.select("doc_id"), "doc_id", "left_anti").select("row", "text", "page"))
    return co_train(text, page, y, pool, settings)


def quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, text_score, page_score, score, rejected) of every whole text.

    ``score`` is the probability of good quality; without labels of both classes it is 1 and
    nothing is rejected.  Null and empty texts are scored as texts without words, null source
    and lang as values of their own; rows are answered one by one.
    """
    table = feature_table(docs)
    return scored(table, fit(docs, labels, settings, table), settings).select(
        "doc_id", F.coalesce(crc_fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "text_score", "page_score", "score", "rejected")


def scored(table: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """Scores of every row of a feature table."""
    def run(batches):
        for batch in batches:
            p, q, s = model.score(matrix(batch.column("text")), matrix(batch.column("page")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p), pa.array(q), pa.array(s), pa.array(s < settings.reject)],
                names=["doc_id", "text_score", "page_score", "score", "rejected"])

    return table.mapInArrow(run, "doc_id long, text_score double, page_score double, score double, rejected boolean")
