"""Statistics and integrity as one-row and few-row DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sylva.functions import json as J


def stats(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``nodes, edges, embeddings``: three counts in one row."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n") for name, df in (("nodes", nodes), ("edges", edges), ("embeddings", embeddings))]
    rows = counts[0].union(counts[1]).union(counts[2])
    return rows.agg(*(F.sum(F.when(F.col("t") == t, F.col("n"))).alias(t) for t in ("nodes", "edges", "embeddings")))


def integrity(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, scopes: DataFrame, catalog: DataFrame, dimensions: int) -> DataFrame:
    """``issue, n``: how many rows break each rule, with a row for every rule."""
    keys = nodes.select("node_key")
    broken = {
        "vector length": embeddings.where(F.coalesce(F.size("vector") != dimensions, F.lit(True))),
        "embedding without node": embeddings.join(keys, "node_key", "left_anti"),
        "edge source without node": edges.join(keys, edges.source_key == keys.node_key, "left_anti"),
        "edge target without node": edges.join(keys, edges.target_key == keys.node_key, "left_anti"),
        "node scope without scope": nodes.where("scope_id is not null").join(
            scopes.select(F.col("id").alias("scope_id")), "scope_id", "left_anti"
        ),
        "repeated node id": nodes.groupBy("id").count().where("count > 1"),
        "repeated edge": edges.groupBy("source_key", "relationship", "target_key").count().where("count > 1"),
        "node attributes invalid": nodes.where(~J.is_json("attributes")),
        "catalog value invalid": catalog.where(~J.is_json("record_value")),
    }
    result = None
    for issue, rows in broken.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(issue).alias("issue"), "n")
        result = one if result is None else result.union(one)
    return result
