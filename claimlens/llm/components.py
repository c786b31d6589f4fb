"""Connected components of an edge table by contraction, entirely as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.stage import staged


def components(edges: DataFrame) -> DataFrame:
    """Edges (a long, b long) -> (node, component): the smallest node reachable.

    Every node points at its smallest neighbour (or itself), pointers are
    doubled until they reach their ends, the edges are contracted to these ends
    and the loop goes on until no edge is left: logarithmically many rounds,
    each a handful of joins on partially aggregated rows. Nothing but row
    counts reaches the driver. No edges give no rows; self-loops are ignored.
    """
    edges = staged(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                   "edges")
    nodes = None
    while not edges.isEmpty():
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = staged(ends.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("to")),
                       "point")
        while True:
            further = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
            moved = point.join(further, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
            moved = staged(moved, "point")
            point = moved.select("node", "to")
            if moved.filter("moved").isEmpty():
                break
        left = edges.join(point.select(F.col("node").alias("a"), F.col("to").alias("ca")), "a")
        left = left.join(point.select(F.col("node").alias("b"), F.col("to").alias("cb")), "b").filter("ca <> cb")
        edges = staged(left.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "edges")
        if nodes is None:
            nodes = point.select("node", F.col("to").alias("component"))
        else:
            step = point.select(F.col("node").alias("component"), F.col("to").alias("next"))
            nodes = staged(nodes.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "nodes")
    if nodes is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes
