"""Nested containers: breadth-first expansion until no new content is found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tracefold.operators.ordering import number_rows
from tracefold.session import cut, cut_counted


def expand_containers(roots: DataFrame, members: DataFrame) -> DataFrame:
    """Files found below each root: (root_id, position, depth, item_id, hash, ...).

    ``roots`` is (root_id, item_id, hash, is_container); ``members`` is
    (container_id, member_seq, item_id, hash, is_container).  One round per level
    takes items in queue order; content that a root has met before is counted but
    not opened again, so the loop ends, also when containers hold each other.
    Positions come from a distributed count: no task holds the queue of a root.
    """
    members = cut(members.select("container_id", "member_seq", "item_id", "hash",
                                 "is_container"))  # read on every level
    columns = ["root_id", "depth", "position", "item_id", "hash", "is_container"]
    queue = roots.select("root_id", "item_id", "hash", "is_container",
                         F.lit(0).cast("bigint").alias("_parent"),
                         F.lit(0).cast("bigint").alias("_seq"))
    used = roots.select("root_id", F.lit(0).cast("bigint").alias("_used"))
    found, levels, depth, rows = None, [], 0, 1
    while rows:
        level = (number_rows(queue, ["_parent", "_seq", "item_id"], ["root_id"], "_row")
                 .join(used, "root_id")
                 .withColumn("position", F.col("_row") + F.col("_used") + 1)
                 .withColumn("depth", F.lit(depth)))
        level = cut(level.select(*columns))
        levels.append(level.select("root_id"))
        used = reduce(DataFrame.unionByName, levels).groupBy("root_id").agg(
            F.count(F.lit(1)).alias("_used"))
        new = level if found is None else level.join(
            found.select("root_id", "hash"), ["root_id", "hash"], "left_anti")
        firsts = new.groupBy("root_id", "hash").agg(F.min("position").alias("position"))
        new = new.join(firsts, ["root_id", "hash", "position"]).select(*columns)
        new, rows = cut_counted(new, F.col("is_container"))
        found = new if found is None else found.unionByName(new)
        queue = (new.where("is_container")
                 .select("root_id", F.col("item_id").alias("container_id"),
                         F.col("position").alias("_parent"))
                 .join(members, "container_id")
                 .select("root_id", "item_id", "hash", "is_container", "_parent",
                         F.col("member_seq").cast("bigint").alias("_seq")))
        depth += 1
    taken = used.withColumnRenamed("_used", "total_processed")
    return found.join(taken, "root_id")


def leaves(expanded: DataFrame) -> DataFrame:
    """One row per file that is no container, in queue order by ``position``."""
    return expanded.where(~F.col("is_container")).select("root_id", "position", "item_id")


def container_summary(expanded: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Leaf count and success per root; :func:`leaves` has the leaves.

    A root succeeds when it had no error or gave any leaf.
    """
    out = expanded.groupBy("root_id").agg(
        F.count_if(~F.col("is_container")).alias("contained_files"),
        F.max("total_processed").alias("total_processed"))
    if errors is None:
        out = out.withColumn("_errors", F.lit(0))
    else:
        out = out.join(errors.groupBy("root_id").agg(F.count(F.lit(1)).alias("_errors")),
                       "root_id", "left")
    return out.select("root_id", "contained_files", "total_processed",
                      ((F.coalesce("_errors", F.lit(0)) == 0) | (F.col("contained_files") > 0))
                      .alias("success"))
