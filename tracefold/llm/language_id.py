"""Language identification by error-correcting output codes.

Every language has a codeword of bits.  A bit is predicted by a binary classifier over hashed
byte 3- and 4-grams: the log odds of the n-gram in languages with the bit against those
without, averaged over the text and calibrated by logistic regression.  Decoding weighs the
logistic loss of each bit by how well its classifier separates and takes the codeword of the
smallest sum; ``score`` compares the sums of all codewords and a small lead is ``ambiguous``.

Classifiers are fitted on a bounded sample per language (``Settings.sample`` texts in hash
order); n-gram counts are summed by Spark.  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tracefold.llm.common import binary, crc_fold
from tracefold.llm.logistic import fit_logistic
from tracefold.llm.textcore import U64, column_bytes, pieces

FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
SLOTS = 16  # bits of the n-gram hash
GRAMS = (3, 4)


@dataclass(frozen=True)
class Settings:
    sample: int = 1500       # texts per language used for fitting
    ambiguous: float = 0.6   # scores below are flagged


#: Letters in lower case, blanks for ASCII that is no letter; the second byte of Ã… letters is folded apart.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the Latin-1 capitals of UTF-8 in lower case, other ASCII as blanks."""
    out = _FOLD[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def slots(data: np.ndarray, offsets: np.ndarray):
    """For each n-gram size: start positions inside rows and their slots, blank runs left out."""
    out = letters(data).astype(np.uint64)
    end = np.repeat(offsets[1:], np.diff(offsets))
    for size in GRAMS:
        n = len(out) - size + 1
        if n <= 0:
            continue
        value = np.zeros(n, np.uint64)
        for j in range(size):
            value = value << U64(8) | out[j:j + n]
        at = np.flatnonzero((np.arange(n) + size <= end[:n]) & ((out[:n] != 32) | (out[1:n + 1] != 32)))
        yield at, ((value[at] * U64(0x9E3779B97F4A7C15) + U64(size)) >> U64(64 - SLOTS)).astype(np.int64)


def has_letter(texts: list[bytes], offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Whether a row holds any letter (of any script)."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    before = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = before[offsets[1:]] > before[offsets[:-1]]
    for i in np.flatnonzero(~out):
        text = texts[i]
        out[i] = not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))
    return out


def codewords(n: int) -> np.ndarray:
    """Codeword per language (±1): all splits for few languages, else spread random ones."""
    if n <= 5:
        bits = [c for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array([(1, *c) for c in bits], dtype=np.int8).T.reshape(n, -1)
    rng, best = np.random.default_rng(n), None
    length = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = np.where(rng.random((n, length)) < 0.5, 1, -1).astype(np.int8)
        apart = ((length - code.astype(int) @ code.T.astype(int)) // 2 + length * np.eye(n, dtype=int)).min()
        if (code != code[0]).any(axis=0).all() and (best is None or apart > best[0]):
            best = (apart, code)
    return best[1]


@dataclass
class Model:
    names: list[str]
    code: np.ndarray               # language × bit
    odds: np.ndarray | None        # slot × bit
    line: np.ndarray | None        # bit × (slope, intercept)
    trust: np.ndarray | None       # weight of a bit

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean log odds of every bit (row × bit)."""
        rows = len(offsets) - 1
        total, count = np.zeros((rows, self.code.shape[1])), np.zeros(rows)
        for at, slot in slots(data, offsets):
            sums = np.concatenate([np.zeros((1, self.code.shape[1])),
                                   np.cumsum(self.odds[slot], axis=0, dtype=np.float64)])
            bounds = np.searchsorted(at, offsets)
            total += sums[bounds[1:]] - sums[bounds[:-1]]
            count += np.diff(bounds)
        return total / np.maximum(count, 1)[:, None]

    def decode(self, margins: np.ndarray):
        """(language number, score) by weighted loss."""
        if self.code.shape[1] == 0:
            return np.zeros(len(margins), np.int64), np.ones(len(margins))
        f = np.clip(margins * self.line[:, 0] + self.line[:, 1], -30, 30)
        loss = np.stack([(self.trust * np.logaddexp(0, -c * f)).sum(axis=1) for c in self.code], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return loss.argmin(axis=1), 1 / share.sum(axis=1)


def gram_counts(names: list[str]):
    def run(batches):
        place = {n: i for i, n in enumerate(names)}
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            counts = np.zeros(len(names) << SLOTS, np.int64)
            for first, last in pieces(offsets):
                o = offsets[first:last + 1]
                row = np.repeat(lang[first:last], np.diff(o))
                for at, slot in slots(data[o[0]:o[-1]], o - o[0]):
                    counts += np.bincount((row[at] << SLOTS) + slot, minlength=len(counts))
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())],
                                             names=["key", "n"])
    return run


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Code, classifiers and calibration from labelled texts outside the held-out fold."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(FOLDS) != HELD_OUT))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = (labelled.select("doc_id", "lang").distinct().withColumn("rank", rank)
              .where(F.col("rank") <= settings.sample).select(F.col("doc_id").cast("long").alias("doc_id"), "lang"))
    sample = binary(labelled).join(F.broadcast(chosen), "doc_id").select("text", "lang")  # sample rows per language
    names = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    if not names:
        return Model([], np.zeros((0, 0), np.int8), None, None, None)
    code = codewords(len(names))
    if code.shape[1] == 0:
        return Model(names, code, None, None, None)
    counts = np.zeros((len(names), 1 << SLOTS))
    for row in (sample.mapInArrow(gram_counts(names), "key long, n long").groupBy("key")
                .agg(F.sum("n").alias("n")).collect()):  # languages * 2**SLOTS rows at most
        counts[row["key"] >> SLOTS, row["key"] & ((1 << SLOTS) - 1)] = row["n"]
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * (1 << SLOTS))
    odds = np.stack([np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
                     for b in range(code.shape[1])], axis=1).astype(np.float32)
    model = Model(names, code, odds, None, None)

    def margins(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for first, last in pieces(offsets):
                o = offsets[first:last + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(model.margins(data[o[0]:o[-1]], o - o[0])), pa.list_(pa.float64())),
                     batch.column("lang").slice(first, last - first)], names=["m", "lang"])

    rows = sample.mapInArrow(margins, "m array<double>, lang string").collect()  # a few numbers per text
    m = np.array([r["m"] for r in rows])
    truth = code[[names.index(r["lang"]) for r in rows]]
    model.line = np.array([fit_logistic(m[:, [b]], (truth[:, b] > 0).astype(float)) for b in range(code.shape[1])])
    right = ((m * model.line[:, 0] + model.line[:, 1] > 0) == (truth > 0)).mean(axis=0)
    error = np.clip(1 - right, 1e-3, 0.45)
    model.trust = np.log((1 - error) / error)
    model.trust = model.trust / model.trust.mean()
    return model


def language_id(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every whole text.

    Null texts and texts without a letter are ``und`` with score 0; without any labelled text
    all are.  A null doc_id is not held out; rows are answered one by one.
    """
    model = fit(docs, settings)

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for first, last in pieces(offsets, 1 << 19):
                o = offsets[first:last + 1]
                part, own = batch.slice(first, last - first), data[o[0]:o[-1]]
                known = has_letter(part.column("text").to_pylist(), o - o[0], own)
                if not model.names:
                    known[:] = False
                best, score = np.zeros(last - first, np.int64), np.zeros(last - first)
                if known.any():
                    m = model.margins(own, o - o[0]) if model.odds is not None else np.zeros((last - first, 0))
                    best, score = model.decode(m)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"),
                     pa.array([model.names[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                     pa.array(np.where(known, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    found = binary(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(crc_fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
                        "lang_pred", "score", (F.col("score") < settings.ambiguous).alias("ambiguous"))
