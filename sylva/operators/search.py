"""Filtered cosine top-k: exact scan, and an inverted-file index with exact re-ranking."""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sylva.functions.vectors import cosine_distance, is_valid, is_zero
from sylva.model import InvalidInput, SearchFilter
from sylva.operators.centroids import fit_centroids
from sylva.operators.reads import matching

#: The index learns its cells from so many vectors at least, so many a cell, and so many bytes of them at most.
FIT_SAMPLE, PER_CELL, FIT_BYTES = 20_000, 16, 1 << 27


def check_query(query: list[float], dimensions: int) -> list[float]:
    if len(query) != dimensions or not np.isfinite(np.asarray(query, dtype="f4")).all():
        raise InvalidInput(f"a query has {dimensions} finite coordinates")
    if not np.any(query):
        raise InvalidInput("a query must not be all zero")
    return query


def candidates(nodes: DataFrame, embeddings: DataFrame, where: SearchFilter = SearchFilter()) -> DataFrame:
    """Nodes that match the filter, with their vectors."""
    return matching(nodes, where).join(embeddings.select("node_key", "vector"), "node_key")


def exact_topk(
    nodes: DataFrame, embeddings: DataFrame, query: list[float], k: int, where: SearchFilter = SearchFilter(), precision: str = "float"
) -> DataFrame:
    """The k nearest by cosine distance, ties by id; stored zero vectors never match. One scan, no full sort."""
    if k <= 0:
        raise InvalidInput("limit must be positive")
    scored = candidates(nodes, embeddings.where(~is_zero("vector")), where).select(
        "id", "kind", "name", "scope_id", cosine_distance(F.col("vector"), query, precision).alias("distance")
    )
    return scored.orderBy("distance", "id").limit(k)


def indexable(embeddings: DataFrame, dimensions: int) -> DataFrame:
    """Valid vectors that are not zero."""
    return embeddings.where(is_valid("vector", dimensions) & ~is_zero("vector"))


def build_index(embeddings: DataFrame, dimensions: int, seed: int = 7) -> tuple[np.ndarray, DataFrame, int]:
    """Centroids, ``node_key, cell, vector`` of every valid non-zero vector, and the number of these.

    There are as many cells as the square root of that number. They are learnt from ``PER_CELL`` vectors each,
    ``FIT_SAMPLE`` at least, as far as ``FIT_BYTES`` allows; all vectors are assigned.
    """
    valid = indexable(embeddings, dimensions)
    n = valid.count()
    cells = max(1, int(round(n**0.5)))
    most = min(max(FIT_SAMPLE, PER_CELL * cells), max(1, FIT_BYTES // (4 * dimensions)))
    rows = valid.select("vector").orderBy(F.xxhash64("node_key", F.lit(seed))).limit(most).toArrow().column("vector").combine_chunks()
    data = np.asarray(rows.flatten(), "f4").reshape(-1, dimensions)
    centroids = fit_centroids(data, max(1, min(cells, len(data) // 4)), seed)
    return centroids, assign_cells(valid, centroids), n


def assign_cells(embeddings: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``node_key, cell, vector``: the nearest centroid of each vector."""
    shared = embeddings.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        import pyarrow as pa

        centres = shared.value.T
        for batch in batches:
            keys = batch.column(0)
            data = np.asarray(batch.column(1).flatten(), dtype="f4").reshape(len(keys), -1)
            cell = [(data[at : at + 4096] @ centres).argmax(1) for at in range(0, len(keys), 4096)]
            cell = np.concatenate(cell) if cell else np.zeros(0, "i8")
            yield pa.RecordBatch.from_arrays([keys, pa.array(cell, pa.int32()), batch.column(1)], ["node_key", "cell", "vector"])

    return embeddings.select("node_key", "vector").mapInArrow(run, "node_key long, cell int, vector array<float>")


def ivf_topk(
    nodes: DataFrame, cells: DataFrame, centroids: np.ndarray, query: list[float], k: int,
    where: SearchFilter = SearchFilter(), probes: int = 32, precision: str = "float",
) -> DataFrame:
    """The nearest k among the vectors of the ``probes`` cells nearest to the query, filtered before ranking.

    ``cells`` holds the vectors sorted by cell, and each probe is an equality that reaches the scan, so that only these
    cells are read.
    """
    order = np.argsort(-(centroids @ np.asarray(query, dtype="f4")))[:probes]
    if len(order) == len(centroids):
        return exact_topk(nodes, cells, query, k, where, precision)
    probed = reduce(operator.or_, [F.col("cell") == int(c) for c in order])
    return exact_topk(nodes, cells.where(probed), query, k, where, precision)
