"""Bounded breadth-first traversal inside the start's scope, one distributed level at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sylva.model import Direction
from sylva.operators.reads import key_of, neighbours
from sylva.runtime import Scratch


def traverse(
    nodes: DataFrame, edges: DataFrame, start: str, direction: Direction, relationship: str | None, max_hops: int, max_results: int
) -> DataFrame:
    """``position, depth`` and the node's columns, in the order in which a queue would discover them.

    Neighbours of one node come in order of their storage key; nodes of another scope than the start's are neither
    returned nor passed through; the start is never returned. With no hops or results allowed the result is empty
    even for an unknown start. A level is ranked by its parents' positions and keys, so results equal those of a
    queue, but each level is one job. Ranking sees at most ``max_results`` rows.
    """
    spark = nodes.sparkSession
    empty = nodes.limit(0).select(F.lit(0).alias("position"), F.lit(0).alias("depth"), *nodes.columns)
    if max_hops <= 0 or max_results <= 0:
        return empty
    first = key_of(nodes, start)
    scratch = Scratch(spark, "traverse")
    scope = nodes.where(F.col("scope_id").eqNullSafe(F.lit(first["scope_id"]).cast("long")))
    seen = spark.createDataFrame([(first["node_key"],)], "node_key long")
    frontier = seen.withColumn("position", F.lit(0))
    levels, found = [], 0
    for depth in range(1, max_hops + 1):
        reached = (
            neighbours(edges, frontier, direction, relationship)
            .join(frontier, "node_key")
            .groupBy(F.col("neighbour").alias("node_key"))
            .agg(F.min("position").alias("parent"))
            .join(seen, "node_key", "left_anti")
            .join(scope.select("node_key"), "node_key", "left_semi")
        )
        kept = reached.orderBy("parent", "node_key").limit(min(max_results - found, 2**31 - 1))
        ranked = kept.withColumn("position", F.row_number().over(Window.orderBy("parent", "node_key")) + found)
        level = scratch.save(ranked.select("node_key", "position", F.lit(depth).alias("depth")), f"level{depth}")
        n = level.count()
        if not n:
            break
        levels.append(level)
        found += n
        if found >= max_results:
            break
        seen, frontier = seen.union(level.select("node_key")), level.select("node_key", "position")
    if not levels:
        return empty
    result = levels[0]
    for level in levels[1:]:
        result = result.union(level)
    return result.join(nodes, "node_key").select("position", "depth", *nodes.columns).orderBy("position")
