"""Connected components of an edge table by alternating star steps.

Edges point from a node to a smaller one.  The large-star step hangs every
larger neighbour of a node below the node's smallest neighbour, the small-star
step does so with the smaller ones; both are one grouped minimum, pre-aggregated,
and one join back.  The minima are written first: a join with a written table is
a broadcast while its size allows, and otherwise a shuffle of both sides whose
hot keys Spark splits (it can't split the output of a grouping), so a node with
very many edges never fills one task.  The result is one edge (node, root) per node; the
number of rounds grows with the logarithm of the diameter.  Each round is
written to the shared folder; only two numbers per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def _star(edges: DataFrame, both: bool) -> tuple[DataFrame, DataFrame]:
    """One step and the written minima it reads.  Large (``both``): neighbours larger than u move below the
    smallest of u's neighbourhood; small: u and its smaller neighbours do."""
    around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
    least = around.groupBy("a").agg(F.min("b").alias("least"))
    if both:
        least = materialize(least.select("a", F.least("a", "least").alias("least")), "least")
        moved = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = materialize(least, "least")
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        moved = moved.union(least.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge to another: root is the least
    node of its component.  ``edges`` has columns a and b of one type, in any
    direction; null ends, loops and repeated edges are ignored."""
    edges = edges.where("a is not null and b is not null and a <> b") \
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, last = materialize(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == last:
            break
        last = state
        for both in (True, False):
            moved, least = _star(edges, both)
            step = materialize(moved, "edges")
            drop(edges)
            drop(least)
            edges = step
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
