"""Queries of the training-data problems p3 to p8, with SQL where SQL can state them."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession, functions as F

from sylva.llm import bpe, clusters, leaks, personal, posting, similar_text
from sylva.sources.tables import table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; it is the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _records(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    return table(spark, d, "nodes", "node_key", "name", "content").select(F.col("node_key").alias("key"), text.alias("text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similar_text.similar_pairs(_records(spark, d))
    return pairs.select(F.col("key_a").alias("node_key_a"), F.col("key_b").alias("node_key_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return similar_text.similar_groups(_records(spark, d)).withColumnRenamed("key", "node_key")


DIMENSIONS = 64


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "node_vectors", "node_key", "vector").select(F.col("node_key").alias("key"), "vector")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "nodes", "node_key", "kind").where("kind is not null").distinct()
    return table(spark, d, "node_vectors", "node_key", "vector").join(kinds, "node_key").select(
        F.col("node_key").alias("key"), F.col("kind").alias("label"), "vector"
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.sets(_labelled(spark, d), DIMENSIONS).withColumnRenamed("key", "node_key")


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clusters(_labelled(spark, d), DIMENSIONS).withColumnRenamed("key", "node_key")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = posting.neighbours(_vectors(spark, d), 5, DIMENSIONS, least=0.9)
    return near.select(F.least("key", "neighbour").alias("node_key_a"), F.greatest("key", "neighbour").alias("node_key_b")).distinct()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "item_text"))
    return found.select("doc_id", "item_id")


def p7_edited(spark: SparkSession, d: str) -> DataFrame:
    """Passages of 20 words with up to three edits."""
    return leaks.leaks(
        table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "item_text"), words=20, edits=3
    )


def _key(spark: SparkSession) -> str:
    """The session's key of pseudonyms; without one a key of this call, so that values stay linked within its result."""
    return spark.conf.get("spark.sylva.pseudonymKey", None) or secrets.token_hex(16)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = personal.personal_values(table(spark, d, "documents", "doc_id", "text"), _key(spark))
    return found.select("doc_id", "pii_type", "pii_value")


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(table(spark, d, "documents", "doc_id", "text"), _key(spark))


QUERIES = {f.__name__: f for f in (p3_found, p3_groups, p4_found, p4_clusters, p5_found, p6_ids, p7_found, p7_edited, p8_found, p8_redacted)}
_SHINGLES = """w AS (SELECT DISTINCT node_key, regexp_extract_all(lower(coalesce(name, '') || ' ' || coalesce(content, '')), '[a-z0-9]+') AS w FROM nodes),
s AS (SELECT DISTINCT node_key, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT node_key, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 12)),
c AS (SELECT node_key, count(*) AS n FROM s GROUP BY node_key),
met AS (SELECT x.node_key AS a, y.node_key AS b, count(*) AS n FROM s x JOIN s y ON x.g = y.g AND x.node_key < y.node_key GROUP BY 1, 2),
pairs AS (SELECT a, b FROM met JOIN c p ON p.node_key = a JOIN c q ON q.node_key = b WHERE 2 * met.n >= p.n + q.n - met.n)"""

_UNIT = """v AS (SELECT node_key, any_value(CAST(vector AS DOUBLE[])) AS v FROM node_vectors WHERE len(vector) = 64
  AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY node_key),
u AS (SELECT node_key, CAST(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS DOUBLE[64]) AS v FROM v)"""

ORACLE: dict[str, str] = {
    "p4_found": f"""WITH RECURSIVE {_UNIT},
k AS (SELECT DISTINCT node_key, lower(trim(kind)) AS kind FROM nodes WHERE kind IS NOT NULL),
near AS MATERIALIZED (SELECT x.node_key AS a, y.node_key AS b FROM u x JOIN k p ON p.node_key = x.node_key JOIN k q ON q.kind = p.kind
  JOIN u y ON y.node_key = q.node_key WHERE array_inner_product(x.v, y.v) >= 0.85),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b)
SELECT min(b) AS cluster_key, a AS node_key FROM reach GROUP BY a HAVING count(*) >= 5""",
    "p5_found": f"""WITH {_UNIT},
near AS (SELECT x.node_key AS a, y.node_key AS b, array_inner_product(x.v, y.v) AS s FROM u x JOIN u y ON x.node_key <> y.node_key
  WHERE array_inner_product(x.v, y.v) >= 0.9),
best AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM near)
SELECT DISTINCT least(a, b) AS node_key_a, greatest(a, b) AS node_key_b FROM best WHERE r <= 5""",
    "p3_found": f"WITH {_SHINGLES} SELECT a AS node_key_a, b AS node_key_b FROM pairs",
    "p7_found": r"""WITH runs AS (SELECT item_id, list_aggregate(w[k:k + 9], 'string_agg', ' ') AS g FROM (
  SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items))),
texts AS (SELECT doc_id, list_aggregate(w[k:k + 9], 'string_agg', ' ') AS g FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)))
SELECT DISTINCT doc_id, item_id FROM texts JOIN runs USING (g)""",
}
