"""The general problem queries: hierarchies (p1) and overfull keys (p2), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sylva.operators import hierarchy as H, skew as S
from sylva.runtime import Scratch
from sylva.sources.tables import table


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes", "node_key").union(table(spark, d, "anchor_nodes", "node_key"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges", "source_key", "target_key", "relationship")
    return H.containment_links(edges, _keys(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return H.cycle_members(_links(spark, d))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = H.hierarchy(_keys(spark, d), _links(spark, d))
    return tree.withColumn("path", F.array_join(F.transform("path", lambda k: k.cast("string")), "/"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(_keys(spark, d), _links(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with redelivered rows once."""
    return table(spark, d, "edges", "id", "source_key", "target_key", "relationship", "weight", "written_at").distinct()


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes", "node_key", "scope_id").union(table(spark, d, "anchor_nodes", "node_key", "scope_id")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """From the joined compact states of the delivered rows, written once and rolled up to either key."""
    edges, nodes = table(spark, d, "edges", "source_key", "weight"), table(spark, d, "nodes", "node_key", "scope_id")
    states = Scratch(spark, "states").save(S.joined_states(edges, nodes), "joined")
    sources, scopes = S.overfull(S.source_counts(states), 0.02), S.overfull(S.scope_counts(states), 0.10)
    return sources.select(F.lit("source_key").alias("field"), "key_value").union(
        scopes.select(F.lit("scope_id").alias("field"), "key_value")
    )


def p2_source_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.source_stats(_edges(spark, d))


def p2_scope_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.join_rollup(_edges(spark, d), _nodes(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "edges", "source_key", "target_key")
        .where("source_key is not null and target_key is not null")
        .distinct()
    )


def _printed(df: DataFrame, field: str) -> DataFrame:
    text = F.array_join(F.transform("neighbours", lambda k: k.cast("string")), ",")
    return df.select(F.lit(field).alias("field"), "key_value", "chunk", "n", text.alias("neighbours"))


def p2_source_neighbours(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d).select(F.col("source_key").alias("key_value"), F.col("target_key").alias("neighbour"))
    return _printed(S.neighbour_lists(pairs), "source_key")


def p2_scope_neighbours(spark: SparkSession, d: str) -> DataFrame:
    scopes = _nodes(spark, d).where("scope_id is not null").select(F.col("node_key").alias("source_key"), "scope_id")
    pairs = _pairs(spark, d).join(scopes, "source_key").select(
        F.col("scope_id").alias("key_value"), F.col("target_key").alias("neighbour")
    )
    return _printed(S.neighbour_lists(pairs.distinct()), "scope_id")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_hierarchy, p1_descendants,
        p2_found, p2_source_stats, p2_scope_stats, p2_source_neighbours, p2_scope_neighbours,
    )
}

_LINKS = """known AS (SELECT node_key FROM nodes UNION SELECT node_key FROM anchor_nodes),
stated AS (SELECT DISTINCT CASE WHEN lower(trim(relationship)) = 'contains' THEN source_key ELSE target_key END AS parent,
    CASE WHEN lower(trim(relationship)) = 'contains' THEN target_key ELSE source_key END AS child
  FROM edges WHERE lower(trim(relationship)) IN ('contains', 'part_of')),
links AS (SELECT parent, child FROM stated WHERE parent IN (SELECT node_key FROM known) AND child IN (SELECT node_key FROM known))"""

_TREE = f"""WITH RECURSIVE {_LINKS},
up AS (SELECT child, min(parent) AS parent FROM links GROUP BY child),
tree AS (
  SELECT node_key, node_key AS root_key, 0 AS depth, CAST(node_key AS VARCHAR) AS path, [node_key] AS keys
  FROM known WHERE node_key IS NOT NULL AND node_key NOT IN (SELECT child FROM up)
  UNION ALL
  SELECT u.child, t.root_key, t.depth + 1, t.path || '/' || u.child, list_append(t.keys, u.child)
  FROM tree t JOIN up u ON u.parent = t.node_key)"""

_EDGES = "e AS (SELECT DISTINCT id, source_key, target_key, relationship, weight, written_at FROM edges)"
_STATE = """count(*) AS n_edges, count(*) FILTER (isfinite(weight)) AS n_weights, sum(weight) FILTER (isfinite(weight)) AS weight_sum"""


def _chunks(pairs: str, field: str) -> str:
    return f"""WITH {pairs},
sized AS (SELECT key_value, CAST(ceil(count(*) / {S.CHUNK}.0) AS BIGINT) AS chunks FROM pairs GROUP BY key_value),
placed AS (SELECT key_value, neighbour,
  CAST(((neighbour % 2147483648 + 2147483648) % 2147483648 * 2654435761 % 4294967296 // 65536) % chunks AS INTEGER) AS chunk
  FROM pairs JOIN sized USING (key_value))
SELECT '{field}' AS field, key_value, chunk, count(*) AS n, string_agg(CAST(neighbour AS VARCHAR), ',' ORDER BY neighbour) AS neighbours
FROM placed GROUP BY key_value, chunk"""


ORACLE = {
    "p1_found": f"""WITH RECURSIVE {_LINKS},
reach AS (SELECT parent AS a, child AS b FROM links UNION SELECT r.a, l.child FROM reach r JOIN links l ON l.parent = r.b)
SELECT x.a AS node_key, min(y.b) AS cycle_key FROM reach x JOIN reach y ON y.a = x.a JOIN reach z ON z.a = y.b AND z.b = x.a
WHERE x.a = x.b GROUP BY x.a""",
    "p1_hierarchy": f"""{_TREE},
reach AS (SELECT parent AS a, child AS b FROM links UNION SELECT r.a, l.child FROM reach r JOIN links l ON l.parent = r.b)
SELECT k.node_key, u.parent AS parent_key, t.root_key, t.depth, t.path,
  CASE WHEN k.node_key IN (SELECT a FROM reach WHERE a = b) THEN 'cycle' WHEN t.node_key IS NOT NULL THEN 'ok' ELSE 'below_cycle' END AS status
FROM known k LEFT JOIN up u ON u.child = k.node_key LEFT JOIN tree t USING (node_key) WHERE k.node_key IS NOT NULL""",
    "p1_descendants": f"""WITH RECURSIVE {_LINKS},
walk(a, b, d) USING KEY (a, b) AS (SELECT parent, child, 1 FROM links
  UNION SELECT w.a, l.child, min(w.d) + 1 FROM walk w JOIN links l ON l.parent = w.b
    LEFT JOIN recurring.walk s ON s.a = w.a AND s.b = l.child WHERE s.a IS NULL GROUP BY w.a, l.child)
SELECT a AS node_key, b AS descendant_key, CAST(d AS INTEGER) AS distance FROM walk""",
    "p2_found": """SELECT 'source_key' AS field, source_key AS key_value FROM edges WHERE source_key IS NOT NULL
GROUP BY source_key HAVING count(*) * 50 >= (SELECT count(*) FROM edges)
UNION ALL SELECT 'scope_id', scope_id FROM nodes WHERE scope_id IS NOT NULL
GROUP BY scope_id HAVING count(*) * 10 >= (SELECT count(*) FROM nodes)""",
    "p2_source_stats": f"WITH {_EDGES} SELECT source_key, {_STATE} FROM e WHERE source_key IS NOT NULL GROUP BY source_key",
    "p2_scope_stats": f"""WITH {_EDGES}, n AS (SELECT DISTINCT node_key, scope_id FROM (
  SELECT node_key, scope_id FROM nodes UNION ALL SELECT node_key, scope_id FROM anchor_nodes))
SELECT scope_id, {_STATE} FROM e JOIN n ON n.node_key = e.source_key GROUP BY scope_id""",
    "p2_source_neighbours": _chunks(
        """pairs AS (SELECT DISTINCT source_key AS key_value, target_key AS neighbour FROM edges
  WHERE source_key IS NOT NULL AND target_key IS NOT NULL)""",
        "source_key",
    ),
    "p2_scope_neighbours": _chunks(
        """n AS (SELECT node_key, scope_id FROM nodes UNION SELECT node_key, scope_id FROM anchor_nodes),
pairs AS (SELECT DISTINCT scope_id AS key_value, target_key AS neighbour FROM edges JOIN n ON n.node_key = edges.source_key
  WHERE scope_id IS NOT NULL AND target_key IS NOT NULL)""",
        "scope_id",
    ),
}
