"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import stored


def _joined_to_least(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) with ``least``: the smallest of u and its neighbours.

    The minimum is combined before it moves; the join back has one row per u, and adaptive execution splits the
    edges of a centre that holds many.
    """
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of u are joined to the smallest vertex near u."""
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = edges.select(F.inline(ways))
    return _joined_to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are joined to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    ends = F.array(*[F.struct(F.col(end).alias("u"), F.col("least").alias("v")) for end in ("u", "v")])
    return _joined_to_least(down).select(F.inline(ends)).filter("u > v").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and leads to a vertex that leads nowhere."""
    if not edges.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex on an edge (u, v): the smallest vertex it can reach.

    Each round is written to the shared folder; rounds end when the edges are a star per component.
    """
    current = stored(_small_star(edges.select("u", "v").filter("u <> v")), "edges")
    while not _all_stars(current):
        current = stored(_small_star(_large_star(current)), "edges")
    roots = current.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
