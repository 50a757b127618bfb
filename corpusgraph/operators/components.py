"""Connected components of a large graph by alternating star contractions.

Each round groups by node with a minimum (combined before the shuffle) and joins one row for each node back to the
edges. Edges are written as Parquet in the shared folder after each round, so an adaptive plan knows their sizes and
splits the edges of heavy nodes. Whether a star forest is reached takes one aggregate over the nodes. The number of
rounds grows with the logarithm of the component size, not with the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import run_table


def _with_low(edges: DataFrame) -> DataFrame:
    """The least neighbour beside each edge."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("low")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the greater neighbours of each node to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_low(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its lesser neighbours to the least of them; edges run from greater to less."""
    moved = _with_low(edges).select(F.explode(F.array(
        F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("e"))
    return moved.select("e.u", "e.v").filter("u <> v").distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node hangs on one centre, and no centre hangs on another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] is not True


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """``node, component`` for every node that has an edge; the component is named by its least node.

    Nodes may be of any ordered type.
    """
    current = run_table(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct(), "components")
    while not _is_star_forest(current):
        current = run_table(_small_star(_large_star(current)), "components")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
