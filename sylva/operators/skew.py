"""Per-key results where a few keys hold most rows.

Everything is aggregated before it is moved: counts and sums combine on the map side into one compact state per key
and partition, joins see compact states only (eager aggregation), and their counts multiply. Lists cannot be made
compact, so a key's list comes in chunks of bounded size whose number follows from the key's count.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

#: A chunk of a neighbour list has about this many keys.
CHUNK = 1024
#: Keys with at least one in so many rows are hot: there are at most so many, so they may be broadcast.
HOT_SHARE = 10_000


def overfull(counts: DataFrame, share: float) -> DataFrame:
    """``key_value`` of the keys that hold at least ``share`` of all rows counted in ``key_value, n``; the null key
    counts in the total only. The comparison is in whole numbers, so that a share of any decimals is exact."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    part = Fraction(str(share))
    enough = F.col("n").cast("decimal(38,0)") * F.lit(part.denominator) >= F.lit(Decimal(part.numerator * total))
    return counts.where(F.col("key_value").isNotNull() & enough).select("key_value")


def overfull_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """``overfull`` of the rows of one table by one column."""
    return overfull(df.groupBy(F.col(key).alias("key_value")).agg(F.count(F.lit(1)).alias("n")), share)


def edge_state(edges: DataFrame) -> list[Column]:
    """Aggregates of a compact state: rows, valid weights and their sum as a double."""
    valid = F.col("weight").isNotNull() & ~F.isnan("weight") & (F.abs("weight") != float("inf"))
    return [
        F.count(F.lit(1)).alias("n_edges"),
        F.count(F.when(valid, 1)).alias("n_weights"),
        F.sum(F.when(valid, F.col("weight"))).alias("weight_sum"),
    ]


def source_stats(edges: DataFrame) -> DataFrame:
    """``source_key, n_edges, n_weights, weight_sum`` of edges; null, NaN and infinite weights are no weights, all
    others count, however large or small; a key without weights has a null sum."""
    return edges.where("source_key is not null").groupBy("source_key").agg(*edge_state(edges))


def joined_states(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_key, scope_id, n_edges, n_weights, weight_sum, copies``: the compact states of edges by source and of
    nodes by key and scope, joined whole.

    Both inputs are pre-aggregated by the join key before anything moves, so that a key with a third of all rows is
    one row by then. A key without edges has a null ``n_edges``, one without a node null ``copies``; rows without a
    key keep a row of their own on either side.
    """
    states = edges.groupBy(F.col("source_key").alias("node_key")).agg(*edge_state(edges))
    sides = nodes.groupBy("node_key", "scope_id").agg(F.count(F.lit(1)).alias("copies"))
    return states.join(sides, "node_key", "full").select("node_key", "scope_id", "n_edges", "n_weights", "weight_sum", "copies")


def source_counts(states: DataFrame) -> DataFrame:
    """``key_value, n``: the edges of each source in joined states, once whatever the number of its nodes' scopes."""
    return states.where("n_edges is not null").groupBy(F.col("node_key").alias("key_value")).agg(F.max("n_edges").alias("n"))


def scope_counts(states: DataFrame) -> DataFrame:
    """``key_value, n``: the node rows of each scope in joined states."""
    return states.where("copies is not null").groupBy(F.col("scope_id").alias("key_value")).agg(F.sum("copies").alias("n"))


def join_rollup(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``scope_id, n_edges, n_weights, weight_sum`` over edges joined to their source's node, grouped by its scope.

    Joined states multiply: counts and sums by the copies of the node, and only then is rolled up. Nodes without
    a scope roll up under null; edges without a node have no row.
    """
    both = joined_states(edges.where("source_key is not null"), nodes.where("node_key is not null"))
    return (
        both.where("n_edges is not null and copies is not null")
        .groupBy("scope_id")
        .agg(
            F.sum(F.col("n_edges") * F.col("copies")).alias("n_edges"),
            F.sum(F.col("n_weights") * F.col("copies")).alias("n_weights"),
            F.sum(F.col("weight_sum") * F.col("copies")).alias("weight_sum"),
        )
    )


def neighbour_lists(pairs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``key_value, chunk, n, neighbours`` of distinct ``key_value, neighbour`` pairs, each list sorted.

    A key with c neighbours has ceil(c / chunk) chunks, filled by a hash of the neighbour. The chunk numbers of hot
    keys, at most ``HOT_SHARE`` of them whatever the size, are broadcast; all other keys are joined on the key, where
    none holds more than one row in ``HOT_SHARE``.
    """
    counts = pairs.groupBy("key_value").agg(F.count(F.lit(1)).alias("c"))
    total = pairs.agg(F.count(F.lit(1))).first()[0]
    sized = counts.select("key_value", F.ceil(F.col("c") / F.lit(chunk)).alias("chunks"), "c")
    hot = sized.where(F.col("c") * HOT_SHARE >= F.lit(total)).where("chunks > 1").select("key_value", "chunks")
    few = sized.where(F.col("c") * HOT_SHARE < F.lit(total)).where("chunks > 1").select(
        "key_value", F.col("chunks").alias("more")
    )
    mixed = F.floor((F.pmod("neighbour", F.lit(2147483648)) * F.lit(2654435761)) % F.lit(4294967296) / F.lit(65536))
    split = pairs.join(F.broadcast(hot), "key_value", "left")
    none = F.lit(None).cast("long")
    placed = split.where("chunks is not null").select("key_value", "neighbour", "chunks", none.alias("more")).unionByName(
        split.where("chunks is null").join(few, "key_value", "left").select("key_value", "neighbour", "chunks", "more")
    )
    return (
        placed.select(
            "key_value",
            F.pmod(mixed, F.coalesce("chunks", "more", F.lit(1))).cast("int").alias("chunk"),
            "neighbour",
        )
        .groupBy("key_value", "chunk")
        .agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("neighbour")).alias("neighbours"))
    )
