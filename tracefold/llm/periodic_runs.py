"""Periodic runs of words by recursive frequency splitting.

A run is a stretch whose words repeat with a smallest period ``q``, at least :data:`LEAST`
words and at least two periods long, that cannot be extended.  All its words occur twice or
more inside it.  So words that occur once in a segment (at first: the text) belong to no run
there and split it, the pieces are counted again on their own, and so on until nothing
changes; pieces below the least length go.  Every run lies wholly in one surviving segment.

Surviving segments are scanned for lags: a run of period ``q`` holds a block of words at an
aligned place together with its copy ``q`` words later, for a block size that follows from
``q``.  Blocks are matched by sorting, a matched pair is extended in both directions by binary
search on prefix hashes, so the work is near-linear in the words also where one phrase repeats
thousands of times.  Texts are narrow work: no row meets another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracefold.llm.common import binary
from tracefold.llm.textcore import U64, column_bytes, mix, pieces, prefix_hash, row_of, slice_hash, slices

LEAST = 12
#: Bytes between words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
WORD = r"[^\x20\x09-\x0D]+"
_PRIMES = (U64((1 << 31) - 1), U64((1 << 31) - 19))
_BASES = (U64(1_103_515_245), U64(1_664_525_013))
_STEP = U64(0x9E3779B97F4A7C15)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word index of each row (plus the end)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~BLANK[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]  # a word ends with its row
    both = cuts[inside[cuts] & inside[cuts + 1]]
    opens[both] = True
    closes[both - 1] = True
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    found = np.zeros(len(keys), dtype=bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def segments(words: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretches that splitting at words too rare for a run leaves."""
    at, part = np.arange(len(words)), row
    starts, ends = [], []
    while len(at):
        keep = repeated(mix(words[at] + (part.astype(np.uint64) + U64(1)) * _STEP))
        changed = np.zeros(int(part[-1]) + 1, dtype=bool)
        changed[part[~keep]] = True
        at, part = at[keep], part[keep]
        if not len(at):
            break
        edge = np.flatnonzero((np.diff(at) != 1) | (np.diff(part) != 0)) + 1
        first, last = np.append(0, edge), np.append(edge, len(at))
        long = last - first >= least
        first, last = first[long], last[long]
        again = changed[part[first]]
        starts.append(at[first[~again]])
        ends.append(at[last[~again] - 1] + 1)
        first, last = first[again], last[again]
        index = slices(np.arange(len(at)), first, last - first)
        at = at[index]
        part = np.repeat(np.arange(len(first)), last - first)
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    order = np.argsort(starts)
    return starts[order], ends[order]


class Prefixes:
    """Prefix hashes modulo two primes: do two stretches of words agree?"""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums, self.powers = [], []
        for k, (prime, base) in enumerate(zip(_PRIMES, _BASES)):
            powers = np.ones(n + 1, dtype=np.uint64)
            done = 1
            while done < n + 1:
                step = min(done, n + 1 - done)
                top = U64(pow(int(base), done, int(prime)))
                powers[done:done + step] = powers[:step] * top % prime
                done += step
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((words >> U64(32 * k)) % prime * powers[:n] % prime, out=sums[1:])
            self.powers.append(powers)
            self.sums.append(sums % prime)

    def agree(self, a: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        """words[a:a+size] == words[a+lag:a+lag+size], for each element."""
        out = np.ones(len(a), dtype=bool)
        for prime, sums, powers in zip(_PRIMES, self.sums, self.powers):
            left = (sums[a + size] + prime - sums[a]) % prime * powers[lag] % prime
            right = (sums[a + lag + size] + prime - sums[a + lag]) % prime
            out &= left == right
        return out

    def longest(self, at: np.ndarray, lag: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """How far the agreement of ``at`` and ``at + lag`` goes to the right (or ``back``)."""
        low, high = np.zeros(len(at), np.int64), limit.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) // 2
            start = at[open_] - middle if back else at[open_]
            good = self.agree(start, lag[open_], middle)
            low[open_] = np.where(good, middle, low[open_])
            high[open_] = np.where(good, high[open_], middle - 1)


def matched(keys: np.ndarray, at: np.ndarray, aligned: np.ndarray, low: int,
            high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of aligned places whose key comes again ``low`` to ``high - 1`` places on."""
    kept = np.flatnonzero(repeated(keys))
    if not len(kept):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, at, aligned = keys[kept], at[kept], aligned[kept]
    order = np.argsort(keys, kind="stable")  # places rise within a key
    keys, at, aligned = keys[order], at[order], aligned[order]
    group = np.cumsum(np.append(False, keys[1:] != keys[:-1])).astype(np.int64)
    code = group * (int(at.max()) + high + 1) + at
    asked = np.flatnonzero(aligned)
    first = np.searchsorted(code, code[asked] + low)
    count = np.searchsorted(code, code[asked] + high) - first
    place = np.repeat(at[asked], count)
    partner = slices(np.arange(len(at)), first, count)
    return place, at[partner] - place


def distinct(start: np.ndarray, length: np.ndarray, lag: np.ndarray):
    """Distinct stretches with their least lag (the others are its multiples)."""
    order = np.lexsort((lag, length, start))
    start, length, lag = start[order], length[order], lag[order]
    new = (np.diff(start) != 0) | (np.diff(length) != 0)
    new = np.append(True, new)[:len(start)]
    return start[new], length[new], lag[new]


def inside(found: list, x: np.ndarray, lag: np.ndarray, b: int, total: int) -> np.ndarray:
    """Which pairs of blocks lie in one known run whose period divides their lag (nothing new there)."""
    start, length, period = (np.concatenate(column) for column in zip(*found))
    if not len(start) or not len(x):
        return np.zeros(len(x), dtype=bool)
    reach = np.full(total, -1, dtype=np.int64)  # run of the furthest end that starts here or before
    np.maximum.at(reach, start, (start + length) * len(start) + np.arange(len(start)))
    run = np.maximum.accumulate(reach)[x]
    known = run >= 0
    run = np.where(known, run % len(start), 0)
    return known & (lag % period[run] == 0) & (x + lag + b <= (start + length)[run])


def runs_of(words: np.ndarray, bounds: np.ndarray, least: int = LEAST):
    """Row, start (word of the row), length and period of every run, by row, start and period."""
    row = row_of(bounds)
    first, last = segments(words, row, least)
    size = last - first
    total = int(size.sum())
    none = np.zeros(0, np.int64)
    found = [(none, none, none)]
    if total:
        place = slices(np.arange(len(words)), first, size)  # flat place → word
        flat = words[place]
        stop = np.cumsum(size)
        opens = np.repeat(stop - size, size)
        closes = np.repeat(stop, size)
        seed = mix(opens.astype(np.uint64) + U64(1))
        prefixes = Prefixes(flat)
        at = np.arange(total)

        def joined(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
            """Hash of the blocks at i and i + step; past the end the value is of no use."""
            out = a * _STEP
            out[:total - step] += b[step:]
            return mix(out)

        pair = joined(flat, flat, 1)
        block, b, low, high = joined(pair, flat, 2), 3, 1, 8
        while low * 2 <= int(size.max()):
            fits = np.flatnonzero((at + b <= closes) & (closes - opens >= 2 * low))
            x, lag = matched(block[fits] ^ seed[fits], at[fits], (at - opens)[fits] % b == 0, low, high)
            new = ~inside(found, x, lag, b, total)
            x, lag = x[new], lag[new]
            if len(x):
                right = prefixes.longest(x, lag, closes[x] - x - lag, False)
                left = prefixes.longest(x, lag, x - opens[x], True)
                start, length = x - left, left + lag + right
                good = length >= np.maximum(least, 2 * lag)
                found.append(distinct(start[good], length[good], lag[good]))
            b, low, high = (4, 8, 16) if b == 3 else (2 * b, 2 * low, 2 * high)
            block = joined(pair, pair, 2) if b == 4 else joined(block, block, b // 2)
        start, length, period = (np.concatenate(x) for x in zip(*found))
        start, length, period = distinct(start, length, period)
        start = place[start]
        order = np.lexsort((period, start))
        start, length, period = start[order], length[order], period[order]
        return row[start], start - bounds[row[start]], length, period
    return none, none, none, none


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)),
                  ("collapsed", pa.string())])
RUNS_DDL = ("doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
            "collapsed string")


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of every whole text, and the text without repeats.

    ``runs`` lists start (word number), length and smallest period by start and period;
    ``collapsed`` joins by one blank the words that no run holds after its first period.
    Null and empty texts have no words, no runs and an empty ``collapsed``; a null ``doc_id``
    stays null; repeated rows are answered each; an empty table gives no rows; columns other
    than ``doc_id`` and ``text`` are ignored.  A text is one row and one task's work, in memory
    proportional to its words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in pieces(offsets):
                o = offsets[a:b + 1]
                part, o = data[o[0]:o[-1]], o - o[0]
                starts, ends, bounds = word_spans(part, o)
                words = slice_hash(prefix_hash(part), starts, ends)
                row, start, length, period = runs_of(words, bounds, least)
                marks = np.zeros(len(words) + 1, dtype=np.int64)
                begin = bounds[row] + start
                np.add.at(marks, begin + period, 1)
                np.add.at(marks, begin + length, -1)
                kept = np.flatnonzero(np.cumsum(marks[:-1]) == 0)
                sizes = ends[kept] - starts[kept] + 1
                text = slices(np.append(part, np.uint8(32)), starts[kept], sizes).copy()
                stops = np.cumsum(sizes)
                text[stops - 1] = 32
                places = np.append(0, stops)[np.searchsorted(kept, bounds)]
                raw = text.tobytes()
                collapsed = [raw[i:max(i, j - 1)].decode("utf-8", "replace")
                             for i, j in zip(places[:-1].tolist(), places[1:].tolist())]
                counts = np.append(0, np.cumsum(np.bincount(row, minlength=b - a))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(counts), pa.StructArray.from_arrays(
                    [pa.array(start), pa.array(length), pa.array(period)], fields=list(RUN)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(bounds), pa.int64()), lists,
                     pa.array(collapsed, pa.string())], schema=RUNS)

    return binary(docs).mapInArrow(run, RUNS_DDL)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, chosen by id, end in repeats of a phrase of their own."""
    digest = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest.alias("h"),
                        F.when(digest % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    parts = parts.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    parts = parts.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    parts = parts.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    text = F.expr("array_join(transform(sequence(0, n - 1), "
                  "i -> words[if(i < a, i, a + (i - a) % p)]), ' ')")
    return parts.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def sha(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def run_digests(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period) and digests per document."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return periodic_runs(docs).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
