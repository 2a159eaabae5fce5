"""Functions over binary columns.

Counting bytes and finding opcodes are the only places where content passes
through Python: exploding one row per byte would multiply the data a hundred
times, while one vectorised numpy pass per Arrow batch keeps the row count.
Everything around them stays in JVM expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tracefold.functions.literals import first_match


@F.pandas_udf(T.DoubleType())
def byte_entropy(content: pd.Series) -> pd.Series:
    """Shannon entropy in bits per byte; empty or missing content gives 0."""
    def one(value):
        if not value:
            return 0.0
        counts = np.bincount(np.frombuffer(value, dtype=np.uint8))
        share = counts[counts > 0] / len(value)
        return float(abs(np.dot(share, np.log2(share))))
    return content.map(one, na_action=None).astype("float64")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def opcode_positions(content: pd.Series, opcode: pd.Series) -> pd.Series:
    """Zero-based positions of one byte value, in order."""
    def one(value, byte):
        if not value:
            return np.empty(0, dtype=np.int32)
        found = np.flatnonzero(np.frombuffer(value, dtype=np.uint8) == byte)
        return found.astype(np.int32)
    return pd.Series([one(v, b) for v, b in zip(content, opcode)], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def block_sums(content: pd.Series, size: pd.Series) -> pd.Series:
    """Byte sums of consecutive blocks of ``size`` bytes."""
    def one(value, width):
        if not value:
            return np.empty(0, dtype=np.int64)
        array = np.frombuffer(value, dtype=np.uint8)
        return np.add.reduceat(array, np.arange(0, len(array), width), dtype=np.int64)
    return pd.Series([one(v, w) for v, w in zip(content, size)], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def byte_counts(content: pd.Series, start: pd.Series, stop: pd.Series) -> pd.Series:
    """How often each of the 256 byte values occurs from ``start`` to ``stop``."""
    def one(value, low, high):
        return np.bincount(np.frombuffer(value, dtype=np.uint8)[low:high], minlength=256)
    return pd.Series([one(v, a, b) for v, a, b in zip(content, start, stop)], dtype=object)


#: Ranges counted at a time: 2 MB of counts, however many rows or ranges a batch holds.
RANGES = 1024


def range_counts(df: DataFrame) -> DataFrame:
    """(file_id, seq, counts): how often each byte value occurs in every range of a content.

    ``df`` has file_id, bytes and spans, a list of (seq, low, high) inside the content.
    """
    kind = df.schema["spans"].dataType.elementType["seq"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, content = batch.column("spans"), batch.column("bytes")
            rows = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy())
            flat = spans.flatten()
            seq, low, high = (pc.struct_field(flat, name) for name in ("seq", "low", "high"))
            for start in range(0, len(flat), RANGES):
                here = rows[start:start + RANGES]
                counts = np.zeros((len(here), 256), dtype=np.int64)
                for i, (row, a, b) in enumerate(zip(here, low.slice(start, RANGES).to_pylist(),
                                                    high.slice(start, RANGES).to_pylist())):
                    data = np.frombuffer(content[int(row)].as_buffer(), dtype=np.uint8)
                    counts[i] = np.bincount(data[a:b], minlength=256)
                offsets = np.arange(0, counts.size + 1, 256, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("file_id").take(pa.array(here)), seq.slice(start, RANGES),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.ravel()))],
                    names=["file_id", "seq", "counts"])

    key = df.schema["file_id"].dataType.simpleString()
    return df.select("file_id", "bytes", "spans").mapInArrow(
        run, f"file_id {key}, seq {kind}, counts array<bigint>")


@F.pandas_udf(T.ArrayType(T.LongType()))
def running_starts(gaps: pd.Series, found: pd.Series) -> pd.Series:
    """Where each found piece starts when gaps and pieces alternate, by their lengths."""
    def one(before, sizes):
        if sizes is None or before is None:
            return None
        before = np.asarray(before[:len(sizes)], dtype=np.int64)
        return np.cumsum(before) + np.cumsum(sizes, dtype=np.int64) - np.asarray(sizes, dtype=np.int64)
    return pd.Series([one(b, f) for b, f in zip(gaps, found)], dtype=object)


def latin1(content: Column) -> Column:
    """One character per byte, so that text functions work on raw content."""
    return F.decode(content, "ISO-8859-1")


def head(content: Column, size: int) -> Column:
    return F.substring(content, 1, size)


def hex_address(value: Column) -> Column:
    """Lower-case ``0x`` rendering without padding."""
    return F.concat(F.lit("0x"), F.lower(F.hex(value.cast("bigint"))))


def hex_padded(value: Column, width: int = 4) -> Column:
    digits = F.hex(value.cast("bigint"))
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def entropy_class(entropy: Column) -> Column:
    return first_match([(entropy < 1.0, F.lit("mostly empty")),
                        (entropy < 5.0, F.lit("normal code/data")),
                        (entropy < 7.0, F.lit("compressed/encoded"))],
                       F.lit("encrypted/packed"))


def little_endian_signed(digits: Column, size: int) -> Column:
    """Signed value of ``size`` little-endian bytes given as hex digits."""
    pairs = [F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]
    unsigned = F.conv(F.concat(*pairs), 16, 10).cast("bigint")
    wrap = 1 << (8 * size)
    return F.when(unsigned >= wrap // 2, unsigned - F.lit(wrap)).otherwise(unsigned)
