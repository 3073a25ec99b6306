"""Connected components of an edge table, by large-star and small-star steps.

Each step is a minimum per node (partial sums, so that a hub sends one row per task) and a join of the edges with these
minima. Minima and edges are written before they are joined: lineage stays short, and adaptive execution may split a
hub's partition. Nothing but the number and a checksum of the edges comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.sources.tables import materialize

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b), a < b: links of every node go to the smallest node of its neighbourhood."""
    if large:
        ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
        sides = edges.select(ends.alias("e")).select("e.u", "e.v")
    else:
        sides = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    smallest = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    smallest = materialize(smallest)
    linked = sides.join(smallest, "u")
    if large:
        linked = linked.filter(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        both = F.explode(F.array(F.col("v"), F.col("u")))
        linked = linked.select(F.col("m").alias("a"), both.alias("b"))
    return linked.filter(F.col("a") < F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the smallest node that can be reached.

    edges: columns a and b of one orderable type, in any order and number; rows with a null or with a = b say nothing.
    No edges give no rows.
    """
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = materialize(ordered.filter(F.col("a") < F.col("b")).distinct())
    before = _state(edges)
    if not before[0]:
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(MAX_ROUNDS):
        edges = materialize(_star(materialize(_star(edges, large=True)), large=False))
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point within {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
