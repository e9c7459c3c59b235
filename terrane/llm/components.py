"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import Workspace


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long), root the smallest node reachable.

    Alternates two star steps: each node sends its larger neighbours to its smallest one, then
    its smaller neighbours. Every round keeps the components and at most the number of edges,
    and the graph ends as stars around the roots. A round is written to the shared folder, so
    lineage stays short and a lost executor costs one round at most. Neighbour lists are never
    gathered: a node's smallest neighbour is a map-side combined aggregate joined back, so a
    node with very many neighbours is spread by the skew split of the join.
    Null ends and loops are dropped; an empty table gives an empty one.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = ws.save(now.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "edges-0")
    seen, turn = None, 0
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if mark == seen:
            break
        seen, turn = mark, turn + 1
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = ws.save(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), f"edges-{turn}")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
