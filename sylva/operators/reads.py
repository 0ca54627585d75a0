"""Bounded reads over nodes, edges, scopes and catalog as DataFrame functions.

Filters are added only where they are set, so that each reaches the scan; orders are total and binary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sylva.functions import json as J
from sylva.functions.text import ascii_lower, ascii_lower_text, is_blank
from sylva.model import Direction, InvalidInput, SearchFilter

_INT = 2**31 - 1


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in a total order; a limit of 0 or a negative number is invalid."""
    if limit <= 0 or offset < 0 or limit >= 2**63 or offset >= 2**63:
        raise InvalidInput("limit must be positive and offset not negative")
    if limit + offset <= _INT:
        return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)
    numbered = df.withColumn("_row", F.row_number().over(Window.orderBy(*order)))
    return numbered.where((F.col("_row") > offset) & (F.col("_row") <= offset + limit)).drop("_row").orderBy(*order)


def text_argument(value: str, what: str) -> str:
    if not value.strip():
        raise InvalidInput(f"{what} must not be blank")
    return value


def matching(nodes: DataFrame, where: SearchFilter = SearchFilter()) -> DataFrame:
    """Nodes of a scope, a kind or both; an unset part filters nothing."""
    if where.scope_id is not None:
        nodes = nodes.where(F.col("scope_id") == where.scope_id)
    if where.kind is not None:
        nodes = nodes.where(F.col("kind") == where.kind)
    return nodes


def scope_by_key(scopes: DataFrame, key: str) -> DataFrame:
    return scopes.where(F.col("scope_key") == text_argument(key, "scope key"))


def scope_by_id(scopes: DataFrame, id_: int) -> DataFrame:
    return scopes.where(F.col("id") == id_)


def register_scopes(scopes: DataFrame, keys: DataFrame) -> DataFrame:
    """Scopes with the new ones of ``keys`` (pos, scope_key) added, numbered on from the highest id in order."""
    if not keys.where(is_blank("scope_key")).isEmpty():
        raise InvalidInput("scope key must not be blank")
    fresh = keys.groupBy("scope_key").agg(F.min("pos").alias("pos")).join(scopes, "scope_key", "left_anti")
    top = scopes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return scopes.select("id", "scope_key").union(
        numbered(fresh, "pos", top).select(F.col("_n").alias("id"), "scope_key")
    )


def numbered(df: DataFrame, order: str, start: int = 0) -> DataFrame:
    """``df`` with ``_n`` = start + 1, start + 2, ... in the order of a column, without one task sorting all rows."""
    from sylva.runtime import Scratch

    scratch = Scratch(df.sparkSession, "numbered")
    local = F.monotonically_increasing_id()
    placed = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_at", local)
    placed = scratch.save(placed.withColumn("_part", F.shiftright("_at", 33)), "placed")
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, start
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    pairs = [F.lit(x) for kv in before.items() for x in kv] or [F.lit(0), F.lit(0)]
    base = F.create_map(*pairs)[F.col("_part")]
    return placed.withColumn("_n", (base + F.col("_at").bitwiseAND(2**33 - 1) + 1).cast("long")).drop("_at", "_part")


def get_node(nodes: DataFrame, id_: str) -> DataFrame:
    return nodes.where(F.col("id") == id_)


def get_nodes(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """Known nodes in the caller's order; a repeated id is invalid. The list is the caller's, so it is small."""
    if len(set(ids)) < len(ids):
        raise InvalidInput("duplicate node id")
    spark = nodes.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
    return nodes.join(F.broadcast(wanted), "id").orderBy("pos").select(*nodes.columns)


def list_nodes(nodes: DataFrame, where: SearchFilter, limit: int, offset: int = 0) -> DataFrame:
    return page(matching(nodes, where), ["id"], limit, offset)


def find_by_attribute(
    nodes: DataFrame, path: str, value, limit: int, offset: int = 0, scope_id: int | None = None
) -> DataFrame:
    """Nodes whose attribute at ``path`` equals ``value``, ordered by id; a stored key column is used where there is one."""
    stored, key = J.key_column(path), J.value_key(value)
    if stored in nodes.columns and key is not None:
        return page(matching(nodes, SearchFilter(scope_id)).where(F.col(stored) == key), ["id"], limit, offset)
    return page(matching(nodes, SearchFilter(scope_id)).where(J.attribute_equals("attributes", path, value)), ["id"], limit, offset)


def find_by_name(nodes: DataFrame, text: str, where: SearchFilter, limit: int, offset: int = 0) -> DataFrame:
    """Literal substring of the name, A-Z folded only; ordered by name, then id."""
    text_argument(text, "name query")
    hit = F.contains(ascii_lower("name"), F.lit(ascii_lower_text(text)))
    return page(matching(nodes, where).where(hit), ["name", "id"], limit, offset)


def without_embeddings(nodes: DataFrame, embeddings: DataFrame, where: SearchFilter = SearchFilter()) -> DataFrame:
    return matching(nodes, where).join(embeddings.select("node_key"), "node_key", "left_anti")


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def resolve_keys(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` with the node keys of their ``id``; an unknown id is invalid."""
    found = ids.join(nodes.select("id", "node_key"), "id", "left")
    if unknown := found.where("node_key is null").take(1):
        raise InvalidInput(f"unknown node id: {unknown[0]['id']}")
    return found


def key_of(nodes: DataFrame, id_: str):
    row = nodes.where(F.col("id") == id_).select("node_key", "scope_id").take(1)
    if not row:
        raise InvalidInput(f"unknown node id: {id_}")
    return row[0]


def _incident(key: int, direction: Direction) -> Column:
    out, into = F.col("source_key") == key, F.col("target_key") == key
    return {Direction.OUT: out, Direction.IN: into, Direction.BOTH: out | into}[direction]


def with_ids(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the public ids of both ends."""
    ids = nodes.select("node_key", F.col("id").alias("_id"))
    return (
        edges.join(ids.select(F.col("node_key").alias("source_key"), F.col("_id").alias("source_id")), "source_key")
        .join(ids.select(F.col("node_key").alias("target_key"), F.col("_id").alias("target_id")), "target_key")
        .select("id", "source_id", "target_id", "relationship", "weight", "attributes")
    )


def get_edges(edges: DataFrame, nodes: DataFrame, id_: str, direction: Direction, relationship: str | None = None) -> DataFrame:
    """Incident edges of a node in order of their id; a self-loop comes once; an unknown node is invalid."""
    hits = edges.where(_incident(key_of(nodes, id_)["node_key"], direction))
    if relationship is not None:
        hits = hits.where(F.col("relationship") == relationship)
    return with_ids(hits, nodes).orderBy("id")


def neighbours(edges: DataFrame, frontier: DataFrame, direction: Direction, relationship: str | None = None) -> DataFrame:
    """``node_key, neighbour`` (repeats possible) of the keys in ``frontier`` (node_key)."""
    if relationship is not None:
        edges = edges.where(F.col("relationship") == relationship)
    out = edges.select(F.col("source_key").alias("node_key"), F.col("target_key").alias("neighbour"))
    into = edges.select(F.col("target_key").alias("node_key"), F.col("source_key").alias("neighbour"))
    links = {Direction.OUT: out, Direction.IN: into, Direction.BOTH: out.union(into)}[direction]
    return links.join(frontier.select("node_key"), "node_key")


def catalog_get(catalog: DataFrame, namespace: str, key: str) -> DataFrame:
    text_argument(namespace, "namespace"), text_argument(key, "key")
    return catalog.where((F.col("record_namespace") == namespace) & (F.col("record_key") == key))


def catalog_list(catalog: DataFrame, namespace: str, limit: int, offset: int = 0) -> DataFrame:
    text_argument(namespace, "namespace")
    return page(catalog.where(F.col("record_namespace") == namespace), ["record_key"], limit, offset)
