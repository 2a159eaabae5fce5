"""Ordered computations that never put a whole group into one task.

A plain window puts all rows of its partition key into one task, which fails
when one key holds a third of the table.  The helpers below work in two levels:
rows are ordered inside bounded pieces, and only one summary row per piece takes
part in the group-wide window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracefold.session import cut, shuffle_partitions


def running_total(df: DataFrame, order: list[str], group: list[str] | None = None,
                  weights: dict[str, Column] | None = None) -> DataFrame:
    """Add, per weight, the sum over all earlier rows of the group.

    ``order`` has to be unique inside a group.  The rows are range-partitioned
    once; the partition number is written out before it is used, because a
    retried shuffle may place rows differently.
    """
    group = group or []
    weights = weights or {"row_index": F.lit(1)}
    staged = cut(df.select("*", *[c.cast("bigint").alias(f"_w_{n}")
                                  for n, c in weights.items()])
                 .repartitionByRange(shuffle_partitions(df.sparkSession), *[F.col(c) for c in group + order])
                 .withColumn("_piece", F.spark_partition_id()))
    pieces = staged.groupBy(*group, "_piece").agg(
        *[F.sum(f"_w_{n}").alias(f"_t_{n}") for n in weights])
    earlier = W.partitionBy(*group).orderBy("_piece").rowsBetween(
        W.unboundedPreceding, -1)
    pieces = pieces.select(*group, "_piece", *[
        F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}")
        for n in weights])
    met = [staged[c].eqNullSafe(pieces[c]) for c in group + ["_piece"]]  # null is a group too
    inside = W.partitionBy(*[staged[c] for c in group], staged["_piece"]).orderBy(
        *[staged[c] for c in order]).rowsBetween(W.unboundedPreceding, -1)
    joined = staged.join(pieces, met)
    return joined.select(*[staged[c] for c in df.columns], *[
        (F.coalesce(F.sum(staged[f"_w_{n}"]).over(inside), F.lit(0)) + F.col(f"_b_{n}"))
        .alias(n) for n in weights])


def number_rows(df: DataFrame, order: list[str], group: list[str] | None = None,
                name: str = "row_index") -> DataFrame:
    """Zero-based position of each row in its group."""
    return running_total(df, order, group, {name: F.lit(1)})


def fill_forward(df: DataFrame, keys: list[str], order: str, values: dict[str, Column],
                 piece_rows: int = 65536) -> DataFrame:
    """Carry the last non-null value along ``order`` inside each key.

    ``order`` is an integer position, so pieces are fixed ranges of it and no
    extra write is needed.
    """
    cols = list(values)
    marked = df.select("*", *[c.alias(f"_v_{n}") for n, c in values.items()],
                       F.floor(F.col(order) / piece_rows).alias("_piece"))
    local = W.partitionBy(*keys, "_piece").orderBy(order)
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(
        W.unboundedPreceding, -1)
    pieces = (marked.groupBy(*keys, "_piece")
              .agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(),
                                               F.col(order))).alias(f"_l_{n}")
                     for n in cols])
              .select(*keys, "_piece", *[
                  F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_c_{n}")
                  for n in cols]))
    return (marked.join(pieces, keys + ["_piece"])
            .select(*df.columns, *[
                F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(local),
                           F.col(f"_c_{n}")).alias(n) for n in cols]))


def running_counts(df: DataFrame, keys: list[str], order: str, weights: dict[str, Column],
                   piece_rows: int = 65536) -> DataFrame:
    """Add, per weight, its sum over the earlier rows of the key.

    Like :func:`fill_forward`: ``order`` is an integer position, unique in a key, whose fixed
    ranges are the pieces, so nothing is written and one row per piece meets the others.
    """
    marked = df.select("*", *[c.cast("bigint").alias(f"_w_{n}") for n, c in weights.items()],
                       F.floor(F.col(order) / piece_rows).alias("_piece"))
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*keys, "_piece").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    pieces = (marked.groupBy(*keys, "_piece").agg(*[F.sum(f"_w_{n}").alias(f"_t_{n}") for n in weights])
              .select(*keys, "_piece", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}")
                                         for n in weights]))
    return marked.join(pieces, keys + ["_piece"]).select(*df.columns, *[
        (F.coalesce(F.sum(f"_w_{n}").over(inside), F.lit(0)) + F.col(f"_b_{n}")).alias(n) for n in weights])


def text_pieces(df: DataFrame, keys: list[str], order: str, text: Column, separator: str,
                rows: int = 1024) -> DataFrame:
    """Ordered text of each key in pieces of at most ``rows`` positions: (keys, piece, text).

    ``order`` is an integer position, unique in a key.  The text of a key is its pieces in order,
    joined by the separator; missing texts are left out.
    """
    entry = F.struct(F.col(order).alias("at"), text.alias("text"))
    return (df.where(text.isNotNull()).groupBy(*keys, F.floor(F.col(order) / rows).alias("piece"))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), separator)
                 .alias("text")))


def ordered_md5(df: DataFrame, key: str, order: str, text: Column, separator: str, name: str) -> DataFrame:
    """MD5 of the texts of each key in order: rows come sorted and are hashed as they come.

    One key is one task's stream, as a digest has to be, but never a list in memory.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, schema = None, None, None
        for batch in batches:
            schema = batch.schema.field(key).type
            done = []
            for value, piece in zip(batch.column(key).to_pylist(), batch.column("_text").to_pylist()):
                if state is None or value != at:
                    if state is not None:
                        done.append((at, state.hexdigest()))
                    at, state, first = value, hashlib.md5(), True
                if piece is not None:
                    state.update(("" if first else separator).encode() + piece.encode())
                    first = False
            yield rows_of(done, schema)
        if state is not None:
            yield rows_of([(at, state.hexdigest())], schema)

    def rows_of(done: list[tuple], schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([v for v, _ in done], schema), pa.array([d for _, d in done], pa.string())], names=[key, name])

    return (df.select(key, order, text.alias("_text")).repartition(key).sortWithinPartitions(key, order)
            .select(key, "_text").mapInArrow(run, f"{key} {kind}, {name} string"))


def first_rows(df: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    """First ``limit`` rows of each key.

    The rank filter is planned as a window group limit: every input partition
    forwards at most ``limit`` rows per key, so a hot key stays bounded.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
