"""Toxicity by compression distance to two zstandard dictionaries.

One dictionary holds the words that stand out in toxic texts, the other the words of
ordinary texts.  The window is one word with a blank on both sides, the smallest in which
an expression shows.  Every byte is widened to a four-byte code, so that zstandard's optimal
parser can match single characters and the compressed length measures how few dictionary
phrases a window is made of; a carrier that both dictionaries hold keeps each frame
compressible.  The two lengths of a window place it in a cell, whose log odds come from the
labelled texts that hold such windows; thresholds on them and their weights are calibrated there too.

Only the labels of a bounded sample are used to fit (``Settings.sample`` texts of each
class, in hash order); word counts come from Spark and only the ranked words and a few
numbers per sampled text reach the driver.  Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tracefold.llm.common import binary, crc_fold
from tracefold.llm.logistic import fit_logistic, probability

FOLDS, HELD_OUT = 5, 0
WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
CARRIER = bytes((i * 37 + 11) % 200 + 40 for i in range(48))
_CODE = np.random.default_rng(3).integers(0, 256, (256, 4), dtype=np.uint8)
#: Lengths told apart on each side, and thresholds on the log odds of a window.
SIDE = 20
LIMITS = (0.5, 1.0, 2.0, 3.0)
#: Longest run of bytes taken as one window; longer ones give overlapping windows of this size.
WINDOW = 64
KEPT = 1_000_000
ONE_CELL = [(cell,) for cell in range(SIDE * SIDE)]


@dataclass(frozen=True)
class Settings:
    sample: int = 3000        # labelled texts of each class used for fitting
    toxic_words: int = 1500   # entries of the dictionaries
    ordinary_words: int = 6000
    rate: float = 20.0        # how much likelier a toxic word is in toxic texts
    support: float = 0.004    # share of the toxic sample that holds it
    level: int = 15           # zstandard level with an optimal parser


def wide(text: bytes) -> bytes:
    return _CODE[np.frombuffer(text, np.uint8)].tobytes()


def compressor(words: list[bytes], level: int) -> zstandard.ZstdCompressor:
    """The likeliest words stand last, where offsets are shortest."""
    content = wide(b" " + b" ".join(reversed(words)) + b" ") + CARRIER
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False,
                                    write_checksum=False, write_dict_id=False)


def windows(run: bytes) -> list[bytes]:
    """A run of word bytes, or windows over all of it, each half over the next, between characters."""
    if len(run) <= WINDOW:
        return [run]
    def place(i: int) -> int:
        while 0 < i < len(run) and 0x80 <= run[i] < 0xC0:
            i -= 1
        return i
    starts = range(0, len(run) - WINDOW // 2, WINDOW // 2)
    return [run[place(i):place(min(i + WINDOW, len(run)))] for i in starts]


class Scorer:
    """Cells of words (kept, up to a bound): the two compressed lengths above those of the carrier."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes], level: int):
        self.toxic, self.ordinary = compressor(toxic, level), compressor(ordinary, level)
        self.base = len(self.toxic.compress(CARRIER)), len(self.ordinary.compress(CARRIER))
        self.known: dict[bytes, tuple[int, ...]] = {}

    def cell(self, window: bytes) -> int:
        frame = CARRIER + wide(b" " + window + b" ")
        near, far = len(self.toxic.compress(frame)) - self.base[0], len(self.ordinary.compress(frame)) - self.base[1]
        return min(max(near, 0), SIDE - 1) * SIDE + min(max(far, 0), SIDE - 1)

    def learn(self, run: bytes) -> tuple[int, ...]:
        if len(self.known) >= KEPT:
            self.known.clear()
        if len(run) > WINDOW:  # these hardly come again
            return tuple(self.cell(w) for w in windows(run))
        got = self.known[run] = ONE_CELL[self.cell(run)]
        return got

    def cells(self, text: bytes) -> dict[int, int]:
        """How many windows of a text lie in each cell."""
        counts: dict[int, int] = {}
        known, have = self.known.get, counts.get
        for run, n in Counter(WORD.findall(text.lower())).items():
            for cell in known(run) or self.learn(run):
                counts[cell] = have(cell, 0) + n
        return counts


def features(counts: dict[int, int], odds: np.ndarray) -> list[float]:
    """The strongest windows, how many pass each threshold, and the size of the text."""
    total = sum(counts.values())
    ranked = sorted(((float(odds[c]), n) for c, n in counts.items()), reverse=True)
    top = [x for x, n in ranked[:3] for _ in range(min(n, 3))][:3]
    top += [0.0] * (3 - len(top))
    over = [sum(n for x, n in ranked if x >= limit) for limit in LIMITS]
    return [*top, *(float(np.log1p(n)) for n in over), *(n / (total + 1) for n in over),
            float(np.log1p(total)) / 10, top[0] * float(np.log1p(total)) / 10]


def text_words(batches):
    """(word, toxic, ordinary): in how many texts of the batch each word occurs."""
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            counts[label].update({w for run in set(WORD.findall(text.lower())) for w in windows(run)})
        words = [*{*counts[0], *counts[1]}]
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array([counts[1][w] for w in words], pa.int64()),
             pa.array([counts[0][w] for w in words], pa.int64())], names=["word", "toxic", "ordinary"])


@dataclass
class Model:
    toxic: list[bytes]
    ordinary: list[bytes]
    level: int
    odds: np.ndarray | None = None     # of a window's cell
    weights: np.ndarray | None = None  # None without labels of both kinds: every score is 0

    def scorer(self) -> Scorer:
        """The scorer of this worker: its known words outlive a task."""
        return scorer_of(tuple(self.toxic), tuple(self.ordinary), self.level)


@lru_cache(maxsize=1)
def scorer_of(toxic: tuple[bytes, ...], ordinary: tuple[bytes, ...], level: int) -> Scorer:
    return Scorer([*toxic], [*ordinary], level)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Dictionaries and calibration from labelled texts outside the held-out fold."""
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where((crc_fold(FOLDS) != HELD_OUT) & F.col("toxic").isin(0, 1)).groupBy("doc_id")
              .agg(F.max("toxic").alias("toxic")))
    picked = [chosen.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
              for k in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * sample rows at most
    texts = (binary(docs).join(sample, "doc_id")
             .groupBy(F.xxhash64("text").alias("tag")).agg(F.min_by("text", "doc_id").alias("text"),
                                                         F.max("toxic").alias("toxic"))
             .select("text", "toxic"))
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_toxic, n_ordinary = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_ordinary:
        return Model([], [], settings.level)
    counts = (texts.mapInArrow(text_words, "word binary, toxic long, ordinary long")
              .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    rate = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("ordinary") + 0.5) / (n_ordinary + 1))
    speaks = (rate >= settings.rate) & (F.col("toxic") >= max(2, settings.support * n_toxic))
    counts = counts.withColumn("rate", rate).withColumn("speaks", speaks)
    toxic = (counts.where("speaks").orderBy(F.desc("toxic"), "word").limit(settings.toxic_words)
             .select("word").collect())
    ordinary = (counts.where("NOT speaks AND ordinary >= 2").orderBy(F.desc("ordinary"), "word")
                .limit(settings.ordinary_words).select("word").collect())
    model = Model([bytes(r[0]) for r in toxic], [bytes(r[0]) for r in ordinary], settings.level)

    def cells(batches):
        scorer = model.scorer()
        for batch in batches:
            found = [scorer.cells(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(f) for f in found], pa.list_(pa.int32())),
                 pa.array([list(f.values()) for f in found], pa.list_(pa.int32())), batch.column("toxic")],
                names=["cells", "counts", "toxic"])

    # SIDE * SIDE small numbers per sampled text at most
    rows = texts.mapInArrow(cells, "cells array<int>, counts array<int>, toxic int").collect()
    found, y = [Counter(dict(zip(r["cells"], r["counts"]))) for r in rows], np.array([r["toxic"] for r in rows])
    holds = np.zeros((2, SIDE * SIDE))
    for counts, label in zip(found, y):
        holds[label, list(counts)] += 1
    rates = (holds + 0.5) / (np.array([[n_ordinary], [n_toxic]]) + 1)
    model.odds = np.log(rates[1] / rates[0])
    x = np.array([features(f, model.odds) for f in found])
    prior = labels.where((crc_fold(FOLDS) != HELD_OUT) & F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
    share = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))  # classes as they are in the table
    model.weights = fit_logistic(x, y, share)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Null and empty texts are scored as texts without words; a null doc_id belongs to no
    fold and is not held out; without labels of both classes every score is 0.
    """
    model = fit(docs, labels, settings)

    def run(batches):
        scorer = model.scorer()
        for batch in batches:
            if model.weights is None:
                scores = np.zeros(batch.num_rows)
            else:
                scores = probability(model.weights, np.array(
                    [features(scorer.cells(t), model.odds) for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())],
                                             names=["doc_id", "score"])

    scored = binary(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc_fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
