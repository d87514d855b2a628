"""Connected components of an edge table, by alternating large and small stars.

Every step replaces each node's edges by edges to the smallest neighbour; the number of steps grows with
the logarithm of the longest path. Degrees may be large: a node's smallest neighbour is a partial
aggregate, and the join back is an equi-join that adaptive execution splits. Nothing but one row of
counts reaches the driver. Every step is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from framemetry.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: link every larger neighbour of a node to its smallest neighbour or itself.
    Small: link every smaller neighbour, and the node, to the smallest of them."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = around.join(low, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b)."""
    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    sums = None
    while True:
        now = written(_star(_star(now, True), False), "edges")
        # a step that changes nothing has stars only, with the smallest node in the middle
        row = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if (row["n"], row["h"]) == sums:
            break
        sums = (row["n"], row["h"])
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
