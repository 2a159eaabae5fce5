"""Connected components of a link table, by repeated contraction.

Every round each node points at its smallest neighbour; pointers are followed twice and the
links are rewritten between their targets.  A node with any link joins another one, so the
number of nodes at least halves per round.  Rounds are written tables; no group is collected
and hot nodes only take part in aggregates that combine before the shuffle and in joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracefold.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); ``root`` is a node of its component."""
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        for _ in range(2):
            higher = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            parent = parent.join(higher, "p").select("a", F.col("q").alias("p"))
        parent = cut(parent)
        steps.append(parent)
        left = parent.select("a", F.col("p").alias("x"))
        right = parent.select(F.col("a").alias("b"), F.col("p").alias("y"))
        edges = cut(edges.join(left, "a").join(right, "b").where("x <> y")
                    .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    roots = steps[0].select(F.col("a").alias("node"), F.col("p").alias("root"))
    for parent in steps[1:]:
        higher = parent.select(F.col("a").alias("root"), F.col("p").alias("next"))
        roots = roots.join(higher, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return cut(roots)
