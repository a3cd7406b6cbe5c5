"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.columns import HOT_LEAST, hot_floor, join_groups
from tallyforge.session import settle


def _with_least(rows: DataFrame, least: DataFrame, floor: int) -> DataFrame:
    """Rows (a, b) with the least neighbour m of a; a node with very many edges isn't dealt to one task."""
    return join_groups(rows, least, ["a"], floor)


def _large_star(edges: DataFrame, floor: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return (_with_least(both.filter("b > a"), least, floor).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a != b").distinct())


def _small_star(edges: DataFrame, floor: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    return (_with_least(down, least, floor).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
            .union(least.select("a", F.col("m").alias("b"))).distinct())


def components(edges: DataFrame, least: int = HOT_LEAST) -> DataFrame:
    """(id, component) of every node of the undirected edges (a, b): the smallest id it reaches.

    Each turn is two aggregates and two joins over the edges; each half turn is
    written to the shared folder, so a lost executor repeats that at most. Nodes
    with a sizeable share of all edges, a bounded number, are broadcast. A few
    numbers reach the driver.
    """
    current = settle(edges.filter("a != b").select("a", "b").distinct(), "edges")
    # seen from both ends there are twice as many edges
    floor = hot_floor(2 * current.count(), least=least)
    seen = None
    while True:
        current = settle(_small_star(settle(_large_star(current, floor), "half-turn"), floor), "edges")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
