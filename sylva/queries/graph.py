"""The store's own operators over the driver tables, with the SQL that each is checked against."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sylva.functions.json import is_object
from sylva.functions.vectors import is_valid
from sylva.model import Backend, Direction, SearchFilter, WriteBatch
from sylva.operators import diagnostics, reads, search as V, traverse as T, writes as W
from sylva.plans.planner import choose
from sylva.runtime import checkpoint_dir
from sylva.sources.tables import table
from sylva.store import Store

_NODE = ("node_key", "id", "scope_id", "kind", "name", "content", "attributes")
_START = "anchor:00000157"
_DIMENSIONS = 64


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and anchors, redelivered rows once."""
    return table(spark, d, "nodes", *_NODE).union(table(spark, d, "anchor_nodes", *_NODE)).distinct()


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """One edge per source, relationship and target between existing nodes: the one with the smallest id; a weight
    that is not finite, which no store holds, is null."""
    keys = table(spark, d, "nodes", "node_key").union(table(spark, d, "anchor_nodes", "node_key")).distinct()
    edges = table(spark, d, "edges", "id", "source_key", "target_key", "relationship", "weight", "attributes")
    finite = ~F.isnan("e.weight") & (F.abs("e.weight") != float("inf"))
    first = edges.groupBy("source_key", "relationship", "target_key").agg(
        F.min(F.struct("id", "weight", "attributes")).alias("e")
    )
    return (
        first.select("e.id", "source_key", "target_key", "relationship", F.when(finite, F.col("e.weight")).alias("weight"), "e.attributes")
        .join(keys.withColumnRenamed("node_key", "source_key"), "source_key", "left_semi")
        .join(keys.withColumnRenamed("node_key", "target_key"), "target_key", "left_semi")
        .select("id", "source_key", "target_key", "relationship", "weight", "attributes")
    )


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Valid node vectors, redelivered rows once."""
    rows = table(spark, d, "node_vectors", "node_key", "vector").where(is_valid("vector", _DIMENSIONS))
    return rows.groupBy("node_key").agg(F.first("vector").alias("vector"))


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    """One value per namespace and key: the last written, then the greatest."""
    rows = table(spark, d, "catalog_records").groupBy("record_namespace", "record_key")
    return rows.agg(F.max(F.struct("written_at", "record_value"))["record_value"].alias("record_value"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    row = table(spark, d, "embeddings", "vec_id", "embedding").where("vec_id = 7").first()
    return [float(x) for x in row["embedding"]]


def _hits(df: DataFrame) -> DataFrame:
    return df.select("id", "kind", "name", F.round("distance", 6).alias("distance"))


def scope_lookup(spark, d):
    return reads.scope_by_key(table(spark, d, "scopes"), "team/yearly-granary")


def scope_by_id(spark, d):
    return reads.scope_by_id(table(spark, d, "scopes"), 9)


def scope_register(spark, d):
    keys = table(spark, d, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("scope_key"))
    return reads.register_scopes(table(spark, d, "scopes"), keys)


def node_get(spark, d):
    return reads.get_node(_nodes(spark, d), _START)


def nodes_get_many(spark, d):
    ids = ["anchor:00000262", "anchor:00000136", "no such node", "anchor:00000157"]
    return reads.get_nodes(_nodes(spark, d), ids)


def nodes_list_page(spark, d):
    return reads.list_nodes(_nodes(spark, d), SearchFilter(scope_id=1, kind="function"), 50, 20)


def nodes_by_attribute_scoped(spark, d):
    return reads.find_by_attribute(_nodes(spark, d), "$.symbol.public", True, 1000, 0, scope_id=1)


def nodes_by_attribute_unscoped(spark, d):
    return reads.find_by_attribute(_nodes(spark, d), "$.symbol.group", "g-1", 1000)


def nodes_by_attribute_object(spark, d):
    return reads.find_by_attribute(_nodes(spark, d), "$.symbol", {"group": "g-1", "public": 1}, 1000)


def events_by_json_attribute(spark, d):
    rows = table(spark, d, "events", "event_id", "event_type", "props").select(
        F.concat(F.lit("event:"), "event_id").alias("id"), F.col("event_type").alias("kind"), F.col("props").alias("attributes")
    )
    return reads.find_by_attribute(rows, "$.k", 87, 100_000)


def nodes_by_name(spark, d):
    return reads.find_by_name(_nodes(spark, d), "TURBINE", SearchFilter(), 500)


def nodes_missing_embedding(spark, d):
    missing = reads.without_embeddings(_nodes(spark, d), _embeddings(spark, d), SearchFilter(kind="class"))
    return reads.page(missing.select("node_key", "id", "kind"), ["id"], 1000, 10)


def nodes_missing_embedding_count(spark, d):
    return reads.count(reads.without_embeddings(_nodes(spark, d), _embeddings(spark, d)))


def nodes_count_by_filter(spark, d):
    return reads.count(reads.matching(_nodes(spark, d), SearchFilter(scope_id=2, kind="module")))


def node_count(spark, d):
    return reads.count(_nodes(spark, d))


def embedding_count(spark, d):
    return reads.count(_embeddings(spark, d))


def edges_incident_out(spark, d):
    return reads.get_edges(_edges(spark, d), _nodes(spark, d), _START, Direction.OUT, "calls")


def edges_incident_in(spark, d):
    return reads.get_edges(_edges(spark, d), _nodes(spark, d), _most_entered(spark, d), Direction.IN)


def edges_incident_both(spark, d):
    return reads.get_edges(_edges(spark, d), _nodes(spark, d), _START, Direction.BOTH)


def neighbors_one_hop(spark, d):
    frontier = table(spark, d, "nodes", "node_key", "kind").where("kind = 'module'").distinct()
    return reads.neighbours(_edges(spark, d), frontier, Direction.BOTH, "contains").groupBy("node_key", "neighbour").agg(
        F.count(F.lit(1)).alias("times")
    )


def _most_contained(spark: SparkSession, d: str) -> str:
    """The node that most links of containment start from, the smallest id of equals."""
    sources = _edges(spark, d).where("relationship = 'contains'").groupBy(F.col("source_key").alias("node_key")).agg(F.count(F.lit(1)).alias("n"))
    return sources.join(_nodes(spark, d).select("node_key", "id"), "node_key").orderBy(F.desc("n"), "id").first()["id"]


def _most_entered(spark: SparkSession, d: str) -> str:
    """The node that most edges end at, the smallest id of equals."""
    targets = _edges(spark, d).groupBy(F.col("target_key").alias("node_key")).agg(F.count(F.lit(1)).alias("n"))
    return targets.join(_nodes(spark, d).select("node_key", "id"), "node_key").orderBy(F.desc("n"), "id").first()["id"]


def _traverse(direction, relationship, hops, results, start=lambda spark, d: _START):
    def run(spark, d):
        found = T.traverse(_nodes(spark, d), _edges(spark, d), start(spark, d), direction, relationship, hops, results)
        return found.select("position", "depth", "node_key", "id")

    return run


def search_exact_topk(spark, d):
    nodes, vectors = _nodes(spark, d), _embeddings(spark, d)
    return _hits(V.exact_topk(nodes, vectors, _query_vector(spark, d), 10, precision="double"))


def search_exact_filtered(spark, d):
    nodes, vectors = _nodes(spark, d), _embeddings(spark, d)
    return _hits(V.exact_topk(nodes, vectors, _query_vector(spark, d), 25, SearchFilter(kind="class"), precision="double"))


def search_candidates(spark, d):
    nodes, vectors = _nodes(spark, d), _embeddings(spark, d)
    n = F.count(F.lit(1))
    used = F.when(n <= 300, choose(Backend.ADAPTIVE, 300, 300, True).value).otherwise(choose(Backend.ADAPTIVE, 301, 300, True).value)
    return V.candidates(nodes, vectors, SearchFilter(kind="class")).agg(n.alias("n"), used.alias("backend"))


def search_ivf_full_probe(spark, d):
    nodes, vectors = _nodes(spark, d), _embeddings(spark, d)
    centroids, cells, _ = V.build_index(vectors, _DIMENSIONS)
    return _hits(V.ivf_topk(nodes, cells, centroids, _query_vector(spark, d), 10, probes=len(centroids), precision="double"))


def search_ivf(spark, d):
    nodes, vectors = _nodes(spark, d), _embeddings(spark, d)
    centroids, cells, _ = V.build_index(vectors, _DIMENSIONS)
    return _hits(V.ivf_topk(nodes, cells, centroids, _query_vector(spark, d), 10, precision="double"))


def vector_validate(spark, d):
    rows = table(spark, d, "node_vectors", "node_key", "vector")
    ok = is_valid("vector", _DIMENSIONS)
    return rows.groupBy(ok.alias("valid")).agg(F.count(F.lit(1)).alias("n"), F.sum("node_key").alias("keys"))


def merge_nodes(spark, d):
    """Every catalogued node is upserted under the catalog's name, and every supplier becomes a new node."""
    named = table(spark, d, "catalog_records").where("record_key is not null").groupBy("record_key").agg(F.max("record_namespace").alias("n"))
    known = named.select(
        F.col("record_key").alias("id"), F.lit(None).cast("long").alias("scope_id"), F.lit("catalogued").alias("kind"),
        F.coalesce("n", F.lit("")).alias("name"), F.lit("").alias("content"), F.lit('{"reviewed":true,"lang":null}').alias("attributes"),
    )
    new = table(spark, d, "supplier", "s_suppkey", "s_name").select(
        F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.lit(1).cast("long").alias("scope_id"), F.lit("supplier").alias("kind"),
        F.col("s_name").alias("name"), F.lit("").alias("content"), F.lit('{"reviewed":false}').alias("attributes"),
    )
    nodes = _nodes(spark, d)
    batch = known.join(nodes.select("id"), "id", "left_semi").union(new)
    batch = batch.withColumn("pos", F.when(F.col("kind") == "supplier", F.substring("id", 10, 20).cast("long")).otherwise(0))
    part = lambda p: F.get_json_object("attributes", p)
    return W.merge_nodes(nodes, batch).select(
        "node_key", "id", "scope_id", "kind", "name",
        F.when(F.col("kind").isin("catalogued", "supplier"), part("$.reviewed")).alias("reviewed"),
        F.when(F.col("kind").isin("catalogued", "supplier"), part("$.lang")).alias("lang"),
    )


def merge_edges(spark, d):
    """Every call is upserted with a new id and twice its weight."""
    edges = _edges(spark, d)
    batch = edges.where("relationship = 'calls'").select(
        F.lit(0).alias("pos"), F.concat(F.lit("b"), "id").alias("id"), "source_key", "target_key", "relationship",
        (F.col("weight") * 2).alias("weight"), F.lit('{"merged":true}').alias("attributes"),
    )
    return W.merge_edges(edges, batch).select(
        "id", "source_key", "target_key", "relationship", "weight",
        F.coalesce(F.get_json_object("attributes", "$.merged"), F.lit("no")).alias("merged"),
    )


def merge_embeddings(spark, d):
    """The document vectors of matching numbers replace or join the node vectors."""
    nodes = _nodes(spark, d)
    new = table(spark, d, "embeddings").join(nodes.select("node_key", "id"), F.col("vec_id") == F.col("node_key"))
    merged = W.merge_embeddings(nodes, _embeddings(spark, d), new.select(F.col("id").alias("node_id"), F.col("embedding").alias("vector")))
    return merged.select("node_key", F.size("vector").alias("length"), F.round(F.col("vector")[0].cast("double"), 5).alias("first"))


def merge_catalog(spark, d):
    new = table(spark, d, "nation").select(
        F.lit("nation").alias("record_namespace"), F.col("n_name").alias("record_key"), F.col("n_regionkey").cast("string").alias("record_value")
    )
    gone = table(spark, d, "nodes", "id").distinct().select(F.lit("review").alias("record_namespace"), F.col("id").alias("record_key"))
    return W.merge_catalog(_catalog(spark, d), new, gone)


def scope_violations(spark, d):
    return W.scope_violations(_nodes(spark, d), _edges(spark, d))


def batch_validation(spark, d):
    """The delivered tables taken as one batch, redelivered and dirty rows included."""
    nodes = table(spark, d, "nodes", "id", "attributes")
    edges = table(spark, d, "edges", "id", "weight", "attributes")
    vectors = table(spark, d, "node_vectors").select(F.col("node_key").alias("node_id"), "vector")
    catalog = table(spark, d, "catalog_records", "record_namespace", "record_key", "record_value")
    found = W.problems(nodes, edges, vectors, catalog, dimensions=_DIMENSIONS)
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("n"))


def _cascade(spark, d):
    ids = table(spark, d, "catalog_records").select(F.col("record_key").alias("id"))
    return W.delete_nodes(_nodes(spark, d), _edges(spark, d), _embeddings(spark, d), ids)


def delete_cascade(spark, d):
    return diagnostics.stats(*_cascade(spark, d))


def edge_delete(spark, d):
    return reads.count(W.delete_edge(_edges(spark, d), "e0000005595"))


def _loaded(spark: SparkSession, d: str) -> Store:
    """A new store in the scratch folder with all nodes whose attributes are objects, unscoped, and all valid vectors of
    theirs; then every node of kind class is upserted under another name, and all anchors are deleted."""
    path = os.path.join(checkpoint_dir(spark).removeprefix("file:").replace("//", "/"), f"store-{uuid.uuid4().hex}")
    store = Store.open(spark, path, _DIMENSIONS)
    nodes = _nodes(spark, d).where(is_object("attributes"))
    batch = nodes.select("id", F.lit(None).cast("long").alias("scope_id"), "kind", "name", "content", "attributes", F.col("node_key").alias("pos"))
    vectors = _embeddings(spark, d).join(nodes.select("node_key", F.col("id").alias("node_id")), "node_key").select("node_id", "vector")
    store.apply_batch(WriteBatch(nodes=batch, embeddings=vectors))
    again = batch.where("kind = 'class'").withColumns({"name": F.concat(F.lit("new "), "id"), "attributes": F.lit('{"again":1}')})
    store.apply_batch(WriteBatch(nodes=again))
    store.delete_nodes([r["id"] for r in table(spark, d, "anchor_nodes", "id").collect()])
    return store


def store_batches(spark, d):
    """The nodes of the store after its commits."""
    with _loaded(spark, d) as store:
        return store._table("nodes").select("node_key", "id", "kind", "name", F.get_json_object("attributes", "$.again").alias("again"))


def store_vectors(spark, d):
    with _loaded(spark, d) as store:
        return store._table("embeddings").select("node_key", F.round(F.col("vector")[0].cast("double"), 5).alias("first"))


def store_search(spark, d):
    with _loaded(spark, d) as store:
        return store.search(_query_vector(spark, d), 10, backend=Backend.EXACT).hits.select("id", F.round(F.col("distance").cast("double"), 4).alias("distance"))


def _counted(store: Store) -> DataFrame:
    stats = store.stats()
    return store.spark.createDataFrame([(stats.nodes, stats.embeddings, stats.generation)], "nodes long, embeddings long, generation long")


def clear_embeddings(spark, d):
    with _loaded(spark, d) as store:
        store.clear_embeddings()
        return _counted(store)


def truncate(spark, d):
    with _loaded(spark, d) as store:
        store.truncate()
        return _counted(store)


def catalog_get(spark, d):
    key = table(spark, d, "catalog_records").where("record_namespace = 'build'").agg(F.min("record_key")).first()[0]
    return reads.catalog_get(_catalog(spark, d), "build", key)


def catalog_list_page(spark, d):
    return reads.catalog_list(_catalog(spark, d), "review", 100, 5)


def store_stats(spark, d):
    return diagnostics.stats(_nodes(spark, d), _edges(spark, d), _embeddings(spark, d))


def integrity_report(spark, d):
    """Over the tables as delivered."""
    nodes = table(spark, d, "nodes", *_NODE)
    return diagnostics.integrity(
        nodes, table(spark, d, "edges"), table(spark, d, "node_vectors"), table(spark, d, "scopes"), table(spark, d, "catalog_records"), _DIMENSIONS
    )


QUERIES = {
    f.__name__: f
    for f in (
        scope_lookup, scope_by_id, scope_register, node_get, nodes_get_many, nodes_list_page, nodes_by_attribute_scoped,
        nodes_by_attribute_unscoped, nodes_by_attribute_object, events_by_json_attribute, nodes_by_name, nodes_missing_embedding,
        nodes_missing_embedding_count, nodes_count_by_filter, node_count, embedding_count, edges_incident_out, edges_incident_in,
        edges_incident_both, neighbors_one_hop, search_exact_topk, search_exact_filtered, search_candidates, search_ivf_full_probe,
        search_ivf, vector_validate, merge_nodes, merge_edges, merge_embeddings, merge_catalog, scope_violations, batch_validation,
        delete_cascade, edge_delete, store_batches, store_vectors, store_search, clear_embeddings, truncate, catalog_get, catalog_list_page, store_stats, integrity_report,
    )
} | {
    "traverse_out_3": _traverse(Direction.OUT, None, 3, 100_000),
    "traverse_in_2": _traverse(Direction.IN, None, 2, 100_000, _most_contained),
    "traverse_both_2": _traverse(Direction.BOTH, "contains", 2, 100_000, _most_contained),
    "traverse_truncated": _traverse(Direction.OUT, None, 3, 40),
}

_N = """n AS (SELECT DISTINCT node_key, id, scope_id, kind, name, content, attributes FROM (
  SELECT node_key, id, scope_id, kind, name, content, attributes FROM nodes
  UNION ALL SELECT node_key, id, scope_id, kind, name, content, attributes FROM anchor_nodes))"""
_E = """known AS (SELECT node_key FROM nodes UNION SELECT node_key FROM anchor_nodes),
e AS (SELECT min(id) AS id, source_key, target_key, relationship, CASE WHEN isfinite(arg_min_null(weight, id)) THEN arg_min_null(weight, id) END AS weight, arg_min_null(attributes, id) AS attributes
  FROM edges WHERE source_key IN (SELECT node_key FROM known) AND target_key IN (SELECT node_key FROM known)
  GROUP BY source_key, relationship, target_key)"""
_BAD = "len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0"
_V = f"""v AS (SELECT node_key, any_value(vector) AS vector FROM node_vectors
  WHERE vector IS NOT NULL AND len(vector) = 64 AND NOT ({_BAD}) GROUP BY node_key)"""
_C = """c AS (SELECT record_namespace, record_key, record_value FROM (SELECT *, row_number() OVER (
  PARTITION BY record_namespace, record_key ORDER BY written_at DESC, record_value DESC NULLS LAST) AS r FROM catalog_records) WHERE r = 1)"""
_COLS = "node_key, id, scope_id, kind, name, content, attributes"


def _number(path: str) -> str:
    at = f"json_extract_string(attributes, '{path}')"
    return (
        f"CASE WHEN json_valid(attributes) THEN CASE json_type(attributes, '{path}') WHEN 'BOOLEAN' THEN CAST({at} = 'true' AS INT) "
        f"WHEN 'UBIGINT' THEN TRY_CAST({at} AS DOUBLE) WHEN 'BIGINT' THEN TRY_CAST({at} AS DOUBLE) WHEN 'DOUBLE' THEN TRY_CAST({at} AS DOUBLE) END END"
    )


def _text(path: str) -> str:
    return f"CASE WHEN json_valid(attributes) AND json_type(attributes, '{path}') IN ('VARCHAR', 'OBJECT', 'ARRAY') THEN json_extract_string(attributes, '{path}') END"


_BUSY = """(SELECT id FROM e JOIN n ON n.node_key = e.source_key WHERE relationship = 'contains'
  GROUP BY n.id ORDER BY count(*) DESC, n.id LIMIT 1)""".replace("SELECT id", "SELECT n.id")


def _levels(direction: Direction, relationship: str | None, hops: int, results: int, start: str = f"'{_START}'") -> str:
    """Breadth-first levels unrolled, each ranked by its parents' positions and keys."""
    only = f"WHERE relationship = '{relationship}'" if relationship else ""
    out, into = f"SELECT source_key AS a, target_key AS b FROM e {only}", f"SELECT target_key AS a, source_key AS b FROM e {only}"
    hop = {Direction.OUT: out, Direction.IN: into, Direction.BOTH: f"{out} UNION ALL {into}"}[direction]
    parts = [f"WITH {_N}, {_E}, hop AS ({hop}), l0 AS (SELECT node_key, scope_id, 0 AS position FROM n WHERE id = {start})"]
    for k in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT node_key FROM l{j}" for j in range(k))
        base = f"(SELECT max(position) FROM ({' UNION ALL '.join(f'SELECT position FROM l{j}' for j in range(k))}))"
        parts.append(f"""l{k} AS (SELECT node_key, scope_id, row_number() OVER (ORDER BY parent, node_key) + {base} AS position FROM (
  SELECT n.node_key, any_value(n.scope_id) AS scope_id, min(p.position) AS parent FROM l{k - 1} p JOIN hop ON hop.a = p.node_key
  JOIN n ON n.node_key = hop.b WHERE n.scope_id IS NOT DISTINCT FROM (SELECT scope_id FROM l0)
  AND n.node_key NOT IN ({seen}) GROUP BY n.node_key))""")
    union = " UNION ALL ".join(f"SELECT position, {k} AS depth, node_key FROM l{k}" for k in range(1, hops + 1))
    return ", ".join(parts) + f" SELECT position, depth, node_key, n.id FROM ({union}) JOIN n USING (node_key) WHERE position <= {results}"


def _search(k: int, kind: str | None) -> str:
    only = f"WHERE kind = '{kind}'" if kind else ""
    distance = "1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))"
    return f"""WITH {_N}, {_V}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7),
s AS (SELECT id, kind, name, CAST(vector AS DOUBLE[]) AS v FROM n JOIN v USING (node_key) {only})
SELECT id, kind, name, round({distance}, 6) AS distance FROM s, q WHERE list_dot_product(v, v) > 0 ORDER BY {distance}, id LIMIT {k}"""


def _incident(where: str) -> str:
    return f"""WITH {_N}, {_E} SELECT e.id, s.id AS source_id, t.id AS target_id, e.relationship, e.weight, e.attributes
FROM e JOIN n s ON s.node_key = e.source_key JOIN n t ON t.node_key = e.target_key, (SELECT node_key AS k FROM n WHERE id = '{_START}') WHERE {where}"""


_CASCADE = f"""WITH {_N}, {_E}, {_V}, gone AS (SELECT node_key FROM n WHERE id IN (SELECT record_key FROM catalog_records))
SELECT (SELECT count(*) FROM n WHERE node_key NOT IN (SELECT node_key FROM gone)) AS nodes,
(SELECT count(*) FROM e WHERE source_key NOT IN (SELECT node_key FROM gone) AND target_key NOT IN (SELECT node_key FROM gone)) AS edges,
(SELECT count(*) FROM v WHERE node_key NOT IN (SELECT node_key FROM gone)) AS embeddings"""

_STORE = f"""WITH {_N}, {_V}, kept AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY node_key) AS node_key, node_key AS given, id, kind, name
  FROM n WHERE json_valid(attributes) AND (CASE WHEN json_valid(attributes) THEN json_type(attributes) END) = 'OBJECT')
  WHERE id NOT IN (SELECT id FROM anchor_nodes))"""
_DISTANCE = "1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))"

ORACLE = {
    "scope_lookup": "SELECT id, scope_key FROM scopes WHERE scope_key = 'team/yearly-granary'",
    "scope_by_id": "SELECT id, scope_key FROM scopes WHERE id = 9",
    "scope_register": """SELECT id, scope_key FROM scopes UNION ALL
SELECT (SELECT max(id) FROM scopes) + row_number() OVER (ORDER BY r_regionkey), r_name FROM region WHERE r_name NOT IN (SELECT scope_key FROM scopes)""",
    "node_get": f"WITH {_N} SELECT {_COLS} FROM n WHERE id = '{_START}'",
    "nodes_get_many": f"WITH {_N} SELECT {_COLS} FROM n WHERE id IN ('anchor:00000262', 'anchor:00000136', 'no such node', 'anchor:00000157')",
    "nodes_list_page": f"WITH {_N} SELECT {_COLS} FROM n WHERE scope_id = 1 AND kind = 'function' ORDER BY id LIMIT 50 OFFSET 20",
    "nodes_by_attribute_scoped": f"WITH {_N} SELECT {_COLS} FROM n WHERE scope_id = 1 AND {_number('$.symbol.public')} = 1 ORDER BY id LIMIT 1000",
    "nodes_by_attribute_unscoped": f"WITH {_N} SELECT {_COLS} FROM n WHERE {_text('$.symbol.group')} = 'g-1' ORDER BY id LIMIT 1000",
    "nodes_by_attribute_object": f"""WITH {_N} SELECT {_COLS} FROM n WHERE {_text('$.symbol')} = '{{"group":"g-1","public":1}}' ORDER BY id LIMIT 1000""",
    "events_by_json_attribute": f"""SELECT id, kind, attributes FROM (SELECT 'event:' || event_id AS id, event_type AS kind, props AS attributes FROM events)
WHERE {_number('$.k')} = 87 ORDER BY id LIMIT 100000""",
    "nodes_by_name": f"""WITH {_N} SELECT {_COLS} FROM n WHERE contains(translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'turbine')
ORDER BY name, id LIMIT 500""",
    "nodes_missing_embedding": f"WITH {_N}, {_V} SELECT node_key, id, kind FROM n ANTI JOIN v USING (node_key) WHERE kind = 'class' ORDER BY id LIMIT 1000 OFFSET 10",
    "nodes_missing_embedding_count": f"WITH {_N}, {_V} SELECT count(*) AS n FROM n ANTI JOIN v USING (node_key)",
    "nodes_count_by_filter": f"WITH {_N} SELECT count(*) AS n FROM n WHERE scope_id = 2 AND kind = 'module'",
    "node_count": f"WITH {_N} SELECT count(*) AS n FROM n",
    "embedding_count": f"WITH {_V} SELECT count(*) AS n FROM v",
    "edges_incident_out": _incident("e.source_key = k AND e.relationship = 'calls'"),
    "edges_incident_in": _incident(
        "e.target_key = (SELECT target_key FROM e JOIN n ON n.node_key = e.target_key GROUP BY target_key, n.id ORDER BY count(*) DESC, n.id LIMIT 1)"
    ),
    "edges_incident_both": _incident("(e.source_key = k OR e.target_key = k)"),
    "neighbors_one_hop": f"""WITH {_E}, hop AS (SELECT source_key AS a, target_key AS b FROM e WHERE relationship = 'contains'
  UNION ALL SELECT target_key, source_key FROM e WHERE relationship = 'contains')
SELECT a AS node_key, b AS neighbour, count(*) AS times FROM hop WHERE a IN (SELECT node_key FROM nodes WHERE kind = 'module') GROUP BY a, b""",
    "traverse_out_3": _levels(Direction.OUT, None, 3, 100_000),
    "traverse_in_2": _levels(Direction.IN, None, 2, 100_000, _BUSY),
    "traverse_both_2": _levels(Direction.BOTH, "contains", 2, 100_000, _BUSY),
    "traverse_truncated": _levels(Direction.OUT, None, 3, 40),
    "search_exact_topk": _search(10, None),
    "search_exact_filtered": _search(25, "class"),
    "search_candidates": f"""WITH {_N}, {_V} SELECT count(*) AS n, CASE WHEN count(*) <= 300 THEN 'exact' ELSE 'approximate' END AS backend
FROM n JOIN v USING (node_key) WHERE kind = 'class'""",
    "search_ivf_full_probe": _search(10, None),
    "vector_validate": f"SELECT coalesce(len(vector) = 64 AND NOT ({_BAD}), false) AS valid, count(*) AS n, CAST(sum(node_key) AS BIGINT) AS keys FROM node_vectors GROUP BY 1",
    "merge_nodes": f"""WITH {_N}, named AS (SELECT record_key AS id, coalesce(max(record_namespace), '') AS name FROM catalog_records
  WHERE record_key IS NOT NULL GROUP BY record_key)
SELECT node_key, n.id, scope_id, CASE WHEN m.id IS NULL THEN kind ELSE 'catalogued' END AS kind, coalesce(m.name, n.name) AS name,
  CASE WHEN m.id IS NOT NULL THEN 'true' END AS reviewed, CAST(NULL AS VARCHAR) AS lang FROM n LEFT JOIN named m ON m.id = n.id
UNION ALL SELECT (SELECT max(node_key) FROM n) + row_number() OVER (ORDER BY s_suppkey), 'supplier:' || s_suppkey, 1, 'supplier', s_name, 'false', NULL FROM supplier""",
    "merge_edges": f"""WITH {_E} SELECT CASE WHEN relationship = 'calls' THEN 'b' || id ELSE id END AS id, source_key, target_key, relationship,
  CASE WHEN relationship = 'calls' THEN weight * 2 ELSE weight END AS weight,
  CASE WHEN relationship = 'calls' THEN 'true' ELSE 'no' END AS merged FROM e""",
    "merge_embeddings": f"""WITH {_N}, {_V}, b AS (SELECT node_key, embedding AS vector FROM embeddings JOIN n ON n.node_key = vec_id)
SELECT node_key, CAST(len(vector) AS INT) AS length, round(CAST(vector[1] AS DOUBLE), 5) AS first FROM (
  SELECT node_key, vector FROM b UNION ALL SELECT node_key, vector FROM v WHERE node_key NOT IN (SELECT node_key FROM b))""",
    "merge_catalog": f"""WITH {_C}, b AS (SELECT 'nation' AS record_namespace, n_name AS record_key, CAST(n_regionkey AS VARCHAR) AS record_value FROM nation)
SELECT * FROM (SELECT * FROM c WHERE NOT (record_namespace = 'nation' AND record_key IN (SELECT record_key FROM b)) UNION ALL SELECT * FROM b)
WHERE NOT (record_namespace = 'review' AND record_key IN (SELECT id FROM nodes))""",
    "scope_violations": f"""WITH {_N}, {_E} SELECT e.id, e.source_key, e.target_key FROM e JOIN n s ON s.node_key = e.source_key
JOIN n t ON t.node_key = e.target_key WHERE s.scope_id IS DISTINCT FROM t.scope_id""",
    "batch_validation": f"""SELECT "check", n FROM (
SELECT 1 AS "check", count(*) AS n FROM nodes WHERE id IS NULL OR trim(id) = ''
UNION ALL SELECT 2, count(*) FROM (SELECT id FROM nodes GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 3, count(*) FROM nodes WHERE attributes IS NULL OR NOT json_valid(attributes) OR (CASE WHEN json_valid(attributes) THEN json_type(attributes) END) <> 'OBJECT'
UNION ALL SELECT 4, count(*) FROM edges WHERE id IS NULL OR trim(id) = ''
UNION ALL SELECT 5, count(*) FROM (SELECT id FROM edges GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 6, count(*) FROM edges WHERE weight IS NULL OR isnan(weight) OR isinf(weight)
UNION ALL SELECT 7, count(*) FROM edges WHERE attributes IS NULL OR NOT json_valid(attributes) OR (CASE WHEN json_valid(attributes) THEN json_type(attributes) END) <> 'OBJECT'
UNION ALL SELECT 8, count(*) FROM (SELECT node_key FROM node_vectors GROUP BY node_key HAVING count(*) > 1)
UNION ALL SELECT 9, count(*) FROM node_vectors WHERE NOT coalesce(len(vector) = 64 AND NOT ({_BAD}), false)
UNION ALL SELECT 10, count(*) FROM catalog_records WHERE coalesce(trim(record_namespace), '') = '' OR coalesce(trim(record_key), '') = ''
UNION ALL SELECT 11, count(*) FROM (SELECT record_key FROM catalog_records GROUP BY record_namespace, record_key HAVING count(*) > 1)
UNION ALL SELECT 12, count(*) FROM catalog_records WHERE record_value IS NULL OR NOT json_valid(record_value)) WHERE n > 0""",
    "delete_cascade": _CASCADE,
    "edge_delete": f"WITH {_E} SELECT count(*) AS n FROM e WHERE id <> 'e0000005595'",
    "store_batches": f"{_STORE} SELECT node_key, id, kind, CASE WHEN kind = 'class' THEN 'new ' || id ELSE name END AS name, CASE WHEN kind = 'class' THEN '1' END AS again FROM kept",
    "store_vectors": f"{_STORE} SELECT kept.node_key, round(CAST(vector[1] AS DOUBLE), 5) AS first FROM kept JOIN v ON v.node_key = kept.given",
    "store_search": f"""{_STORE}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7),
s AS (SELECT id, CAST(vector AS DOUBLE[]) AS v FROM kept JOIN v ON v.node_key = kept.given)
SELECT id, round({_DISTANCE}, 4) AS distance FROM s, q WHERE list_dot_product(v, v) > 0 ORDER BY {_DISTANCE}, id LIMIT 10""",
    "clear_embeddings": f"{_STORE} SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS embeddings, CAST(4 AS BIGINT) AS generation FROM kept",
    "truncate": "SELECT CAST(0 AS BIGINT) AS nodes, CAST(0 AS BIGINT) AS embeddings, CAST(4 AS BIGINT) AS generation",
    "catalog_get": f"""WITH {_C} SELECT record_namespace, record_key, record_value FROM c
WHERE record_namespace = 'build' AND record_key = (SELECT min(record_key) FROM catalog_records WHERE record_namespace = 'build')""",
    "catalog_list_page": f"WITH {_C} SELECT * FROM c WHERE record_namespace = 'review' ORDER BY record_key LIMIT 100 OFFSET 5",
    "store_stats": f"WITH {_N}, {_E}, {_V} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM v) AS embeddings",
    "integrity_report": """SELECT 'vector length' AS issue, count(*) AS n FROM node_vectors WHERE vector IS NULL OR len(vector) <> 64
UNION ALL SELECT 'embedding without node', count(*) FROM node_vectors ANTI JOIN nodes USING (node_key)
UNION ALL SELECT 'edge source without node', count(*) FROM edges ANTI JOIN nodes ON source_key = node_key
UNION ALL SELECT 'edge target without node', count(*) FROM edges ANTI JOIN nodes ON target_key = node_key
UNION ALL SELECT 'node scope without scope', count(*) FROM nodes WHERE scope_id IS NOT NULL AND scope_id NOT IN (SELECT id FROM scopes)
UNION ALL SELECT 'repeated node id', count(*) FROM (SELECT id FROM nodes GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'repeated edge', count(*) FROM (SELECT 1 FROM edges GROUP BY source_key, relationship, target_key HAVING count(*) > 1)
UNION ALL SELECT 'node attributes invalid', count(*) FROM nodes WHERE attributes IS NULL OR NOT json_valid(attributes)
UNION ALL SELECT 'catalog value invalid', count(*) FROM catalog_records WHERE record_value IS NULL OR NOT json_valid(record_value)""",
}
