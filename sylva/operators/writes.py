"""Write batches as DataFrame functions: validation, merges by key, cascading deletes.

Every function takes whole tables and returns the new whole table. A batch row has a column ``pos`` with its place in
the batch, as later rows win and new keys follow the batch order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sylva.functions import json as J
from sylva.functions.text import is_blank
from sylva.functions.vectors import is_valid
from sylva.model import ConstraintViolation, InvalidInput
from sylva.operators.reads import numbered



def problems(nodes=None, edges=None, embeddings=None, catalog=None, deletes=None, dimensions: int | None = None) -> DataFrame | None:
    """``check, detail`` of everything wrong with a batch, ``check`` numbered in order of precedence."""
    found: list[DataFrame] = []

    def bad(number: int, what: str, rows: DataFrame, detail) -> None:
        found.append(rows.select(F.lit(number).alias("check"), F.concat(F.lit(f"{what}: "), F.coalesce(detail.cast("string"), F.lit("null"))).alias("detail")))

    def repeated(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")

    def not_object(df: DataFrame) -> DataFrame:
        return df.where(~J.is_object("attributes"))

    if nodes is not None:
        bad(1, "blank node id", nodes.where(is_blank("id")), F.col("id"))
        bad(2, "repeated node id", repeated(nodes, "id"), F.col("id"))
        bad(3, "node attributes are no object", not_object(nodes), F.col("id"))
    if edges is not None:
        bad(4, "blank edge id", edges.where(is_blank("id")), F.col("id"))
        bad(5, "repeated edge id", repeated(edges, "id"), F.col("id"))
        odd = F.col("weight").isNull() | F.isnan("weight") | (F.abs("weight") == float("inf"))
        bad(6, "edge weight is not finite", edges.where(odd), F.col("id"))
        bad(7, "edge attributes are no object", not_object(edges), F.col("id"))
    if embeddings is not None:
        bad(8, "repeated embedding", repeated(embeddings, "node_id"), F.col("node_id"))
        if dimensions is not None:
            bad(9, "invalid vector", embeddings.where(~is_valid("vector", dimensions)), F.col("node_id"))
    both = ("record_namespace", "record_key")
    blank = is_blank(both[0]) | is_blank(both[1])
    if catalog is not None:
        bad(10, "blank catalog key", catalog.where(blank), F.col("record_key"))
        bad(11, "repeated catalog key", repeated(catalog, *both), F.col("record_key"))
        bad(12, "catalog value is no JSON", catalog.where(~J.is_json("record_value")), F.col("record_key"))
    if deletes is not None:
        bad(13, "blank catalog key", deletes.where(blank), F.col("record_key"))
        bad(14, "repeated catalog key", repeated(deletes, *both), F.col("record_key"))
        if catalog is not None:
            bad(15, "catalog key written and deleted", deletes.join(catalog, list(both), "left_semi"), F.col("record_key"))
    result = None
    for rows in found:
        result = rows if result is None else result.union(rows)
    return result


def validate(**parts) -> None:
    rows = problems(**parts)
    if rows is not None and (first := rows.orderBy("check", "detail").take(1)):
        raise InvalidInput(first[0]["detail"])


def merge_nodes(nodes: DataFrame, batch: DataFrame, top: int | None = None) -> DataFrame:
    """Upsert by id: the storage key stays, a null scope keeps the stored one, attributes are merge-patched.

    New nodes get the keys after the highest surviving one, in batch order. With ``top``, that key, ``nodes`` may be just
    the stored nodes whose ids are in the batch.
    """
    if top is None:
        top = nodes.agg(F.coalesce(F.max("node_key"), F.lit(0))).first()[0]
    new = batch.select(*(F.col(c).alias(f"b_{c}") for c in ("id", "scope_id", "kind", "name", "content", "attributes")), "pos")
    joined = nodes.join(new, nodes.id == new.b_id, "left")
    hit = F.col("b_id").isNotNull()
    take = lambda c: F.when(hit, F.col(f"b_{c}")).otherwise(F.col(c)).alias(c)
    changed = joined.where(hit).select(
        "node_key", "id", F.coalesce("b_scope_id", "scope_id").alias("scope_id"), take("kind"), take("name"), take("content"),
        J.folded_patches("attributes", F.array("b_attributes")).alias("attributes"),
    )
    same = joined.where(~hit).select(*changed.columns)
    fresh = numbered(batch.join(nodes.select("id"), "id", "left_anti"), "pos", top).select(
        F.col("_n").alias("node_key"), "id", "scope_id", "kind", "name", "content",
        J.folded_patches(F.lit(None).cast("string"), F.array("attributes")).alias("attributes"),
    )
    return same.union(changed).union(fresh)


def scope_violations(nodes: DataFrame, edges: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """``id, source_key, target_key`` of edges between two scopes, a null scope being one of its own.

    ``touched`` (node_key) restricts the check to edges at those nodes.
    """
    if touched is not None:
        ends = touched.select("node_key").distinct()
        edges = edges.join(ends.withColumnRenamed("node_key", "source_key"), "source_key", "left_semi").unionByName(
            edges.join(ends.withColumnRenamed("node_key", "target_key"), "target_key", "left_semi")
        ).select(*edges.columns).distinct()
    scope = nodes.select("node_key", "scope_id")
    return (
        edges.join(scope.select(F.col("node_key").alias("source_key"), F.col("scope_id").alias("_s")), "source_key")
        .join(scope.select(F.col("node_key").alias("target_key"), F.col("scope_id").alias("_t")), "target_key")
        .where(~F.col("_s").eqNullSafe(F.col("_t")))
        .select("id", "source_key", "target_key")
    )


def with_keys(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """Edges of a batch with storage keys; an unknown end is invalid."""
    ids = nodes.select("id", "node_key")
    found = batch.join(ids.select(F.col("id").alias("source_id"), F.col("node_key").alias("source_key")), "source_id", "left").join(
        ids.select(F.col("id").alias("target_id"), F.col("node_key").alias("target_key")), "target_id", "left"
    )
    if unknown := found.where("source_key is null or target_key is null").take(1):
        raise InvalidInput(f"edge {unknown[0]['id']} has an unknown end")
    return found.select("pos", "id", "source_key", "target_key", "relationship", "weight", "attributes")


def merge_edges(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert by (source, relationship, target): the last row of the batch gives id and weight, attributes fold in order.

    An edge id that another triple holds at that place of the batch is a violation; an id that the batch has freed
    before may be used again.
    """
    triple = ["source_key", "relationship", "target_key"]
    first = batch.groupBy(*triple).agg(F.min("pos").alias("_freed"))
    held = edges.select(F.col("id"), *triple).join(first, triple, "left")
    taken = held.select("id", *(F.col(c).alias(f"_{c}") for c in triple), "_freed").join(batch, "id").where(
        ~F.struct(*triple).eqNullSafe(F.struct(*(F.col(f"_{c}").alias(c) for c in triple)))
        & (F.col("_freed").isNull() | (F.col("_freed") >= F.col("pos")))
    )
    if clash := taken.take(1):
        raise ConstraintViolation(f"edge id {clash[0]['id']} belongs to another edge")
    folded = batch.groupBy(*triple).agg(
        F.max_by("id", "pos").alias("b_id"), F.max_by("weight", "pos").alias("b_weight"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "attributes"))), lambda x: x["attributes"]).alias("patches"),
    )
    old = edges.select("id", *triple, "weight", "attributes")
    untouched = old.join(folded.select(*triple), triple, "left_anti").select("id", *triple, "weight", "attributes")
    merged = folded.join(old, triple, "left").select(
        F.col("b_id").alias("id"), *triple, F.col("b_weight").alias("weight"),
        J.folded_patches("attributes", "patches").alias("attributes"),
    )
    return untouched.union(merged).select("id", "source_key", "target_key", "relationship", "weight", "attributes")


def merge_embeddings(nodes: DataFrame, embeddings: DataFrame, batch: DataFrame) -> DataFrame:
    """One vector per node, the batch's replacing the stored one; an unknown node is invalid."""
    keyed = batch.join(nodes.select(F.col("id").alias("node_id"), "node_key"), "node_id", "left")
    if unknown := keyed.where("node_key is null").take(1):
        raise InvalidInput(f"embedding of unknown node {unknown[0]['node_id']}")
    kept = embeddings.join(keyed.select("node_key"), "node_key", "left_anti").select("node_key", "vector")
    return kept.union(keyed.select("node_key", F.col("vector").cast("array<float>")))


def merge_catalog(catalog: DataFrame, batch: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """Values are replaced, not merged; then deletes go; a delete of an absent key does nothing."""
    keys = ["record_namespace", "record_key"]
    if batch is not None:
        kept = catalog.join(batch.select(*keys), keys, "left_anti").select(*keys, "record_value")
        catalog = kept.union(batch.select(*keys, "record_value"))
    if deletes is not None:
        catalog = catalog.join(deletes.select(*keys), keys, "left_anti").select(*keys, "record_value")
    return catalog


def delete_nodes(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the nodes of ``ids`` (id), their edges at either end and their vectors; unknown ids are ignored."""
    gone = nodes.join(ids.select("id").distinct(), "id", "left_semi").select("node_key")
    return (
        nodes.join(ids.select("id"), "id", "left_anti").select(*nodes.columns),
        edges.join(gone.withColumnRenamed("node_key", "source_key"), "source_key", "left_anti")
        .join(gone.withColumnRenamed("node_key", "target_key"), "target_key", "left_anti")
        .select(*edges.columns),
        embeddings.join(gone, "node_key", "left_anti").select(*embeddings.columns),
    )


def delete_edge(edges: DataFrame, id_: str) -> DataFrame:
    return edges.where(F.col("id") != id_)
