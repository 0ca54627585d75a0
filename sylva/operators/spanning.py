"""Minimum spanning forests and connected components by distributed Boruvka rounds.

In a round every component picks its lightest edge to another one; picked edges join the forest, components are merged
along them, and edges inside a component go. The number of components at least halves, so rounds are logarithmic. A
component's pick is one aggregation with partial results before the shuffle, so that a component with a third of all
edges is no bottleneck. Merging follows pointers, doubled until they rest.

Defined cases: null ends, self-edges and repeated edges are dropped (the lightest of repeated ones stays); edges of
equal weight are ordered by their ends, so that the forest is always the same; no edges give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sylva.runtime import Scratch, is_empty


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From edges ``a, b, w``: ``node, component`` (the smallest node) of every node with an edge, and the forest's
    edges ``a, b, w`` with a < b."""
    scratch = Scratch(edges.sparkSession, "spanning")
    clean = edges.where("a is not null and b is not null and a <> b").groupBy(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).agg(F.min("w").alias("w"))
    left = scratch.save(clean.select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")), "edges0")
    forest, maps, turn = [], [], 0
    while not is_empty(left):
        edge = F.struct("w", "a", "b")
        sides = left.select(F.col("x").alias("c"), F.struct("w", "a", "b", F.col("y").alias("to")).alias("e")).union(
            left.select(F.col("y").alias("c"), F.struct("w", "a", "b", F.col("x").alias("to")).alias("e"))
        )
        picked = scratch.save(sides.groupBy("c").agg(F.min("e").alias("e")).select("c", "e.*"), f"picked{turn}")
        forest.append(picked.select("a", "b", "w").distinct())
        # Picks form trees with one pair of components that picked each other; the smaller of the pair is the root.
        back = picked.select(F.col("c").alias("to"), F.col("to").alias("again"))
        pointer = picked.select("c", "to").join(back, "to").select(
            "c", F.when((F.col("again") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to")
        )
        pointer, k, moving = scratch.save(pointer, f"pointer{turn}_0"), 0, True
        while moving:
            k += 1
            ahead = pointer.select(F.col("c").alias("to"), F.col("to").alias("next"))
            jumped = pointer.join(ahead, "to").select("c", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
            new = scratch.save(jumped, f"pointer{turn}_{k}")
            moving, pointer = not is_empty(new.where("moved")), new.select("c", "to")
            scratch.drop(f"pointer{turn}_{k - 1}")
        maps.append(pointer)
        turn += 1
        one, two = pointer.select(F.col("c").alias("x"), F.col("to").alias("rx")), pointer.select(F.col("c").alias("y"), F.col("to").alias("ry"))
        merged = left.join(one, "x").join(two, "y").where("rx <> ry")
        lightest = merged.groupBy(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).agg(F.min(edge).alias("e"))
        left = scratch.save(lightest.select("e.a", "e.b", "e.w", "x", "y"), f"edges{turn}")
    spark = edges.sparkSession
    if not forest:
        kind = dict(edges.dtypes)
        return (
            spark.createDataFrame([], f"node {kind['a']}, component {kind['a']}"),
            spark.createDataFrame([], f"a {kind['a']}, b {kind['a']}, w {kind['w']}"),
        )
    labels = maps[0].select(F.col("c").alias("node"), F.col("to").alias("root"))
    for pointer in maps[1:]:
        # Components that had no edge left in a round stay what they were.
        labels = labels.join(pointer.select(F.col("c").alias("root"), "to"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")
        )
    labels = scratch.save(labels, "labels")
    smallest = labels.groupBy("root").agg(F.min("node").alias("component"))
    tree = forest[0]
    for more in forest[1:]:
        tree = tree.union(more)
    return labels.join(smallest, "root").select("node", "component"), tree
