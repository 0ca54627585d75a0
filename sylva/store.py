"""The store: versioned Parquet tables that change together, under one manifest.

A table is a list of segments. The first holds rows; later ones hold rows that replace those of equal keys and keys
that are gone, as the commits brought them, and are laid over it on reading. So a commit writes what it changes, not the
table; segments are merged as they pile up. The index of vectors is kept in the same way.

A commit writes new segments beside the old ones and then replaces the manifest; that replacement is the only commit
point, so a writer that dies leaves the old state. Readers resolve the manifest at every call and use that state
throughout the call. The folder must be on a file system that all executors and the driver share as a mounted one.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import uuid
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sylva import model as M
from sylva.functions import json as J
from sylva.operators import diagnostics, reads, search as vs, traverse as bfs, writes
from sylva.plans.planner import choose
from sylva.runtime import Scratch


CELLS = T.StructType([T.StructField("node_key", T.LongType()), T.StructField("cell", T.IntegerType()), T.StructField("vector", T.ArrayType(T.FloatType()))])
_TABLES = M.TABLES | {"cells": CELLS}
_KEYS = {
    "nodes": ["node_key"], "edges": ["id"], "scopes": ["id"], "embeddings": ["node_key"],
    "catalog": ["record_namespace", "record_key"], "cells": ["node_key"],
}
#: The index is made anew once it holds so many times the vectors that its cells were made for.
GROWN = 4


@dataclass(frozen=True)
class StoreBuilder:
    """Options of a store; ``build`` opens or creates it."""

    path: str
    dimensions: int
    threshold: int = M.DEFAULT_EXACT_THRESHOLD
    durability_level: M.Durability = M.Durability.FULL
    reading_only: bool = False
    attribute_paths: tuple[str, ...] = ()

    def exact_search_threshold(self, n: int) -> StoreBuilder:
        return replace(self, threshold=n)

    def durability(self, level: M.Durability) -> StoreBuilder:
        return replace(self, durability_level=level)

    def read_only(self, yes: bool = True) -> StoreBuilder:
        return replace(self, reading_only=yes)

    def node_attribute_indexes(self, paths) -> StoreBuilder:
        paths = tuple(J.check_path(p) for p in paths)
        if len(set(paths)) < len(paths):
            raise M.InvalidInput("repeated attribute path")
        return replace(self, attribute_paths=paths)

    def build(self, spark: SparkSession) -> Store:
        return Store(spark, self)


def _writing(method):
    def guarded(self, *args, **kwargs):
        if self.is_read_only:
            raise M.ReadOnly("the operation needs a writable store")
        return method(self, *args, **kwargs)

    guarded.__doc__, guarded.__name__ = method.__doc__, method.__name__
    return guarded


def _live(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_gone", F.lit(False))


def _over(rows: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with those of ``delta`` (with ``_gone``) in the place of rows of equal keys; Spark broadcasts a small delta."""
    columns = [c for c in rows.columns if c in delta.columns]
    kept = rows.join(delta.select(*keys), keys, "left_anti").select(*columns)
    return kept.union(delta.where("not _gone").select(*columns))


def _sync(folder: str) -> None:
    """Puts a folder's files and entries on disk; the file system must be a mounted one."""
    for at, _, files in os.walk(folder):
        for name in [*files, ""]:
            handle = os.open(os.path.join(at, name), os.O_RDONLY)
            os.fsync(handle)
            os.close(handle)


class Store:
    def __init__(self, spark: SparkSession, options: StoreBuilder):
        if options.dimensions <= 0:
            raise M.InvalidInput("dimensions must be positive")
        self.spark, self.options, self._lock = spark, options, None
        self._manifest_path = os.path.join(options.path, "manifest.json")
        if options.reading_only:
            if not os.path.exists(self._manifest_path):
                raise M.StorageError(f"no store at {options.path}")
        else:
            os.makedirs(options.path, exist_ok=True)
            self._take_lock()
        try:
            self._open()
        except Exception:
            self.close()
            raise

    @classmethod
    def builder(cls, path: str, dimensions: int) -> StoreBuilder:
        return StoreBuilder(path, dimensions)

    @classmethod
    def open(cls, spark: SparkSession, path: str, dimensions: int, threshold: int = M.DEFAULT_EXACT_THRESHOLD) -> Store:
        return StoreBuilder(path, dimensions, threshold).build(spark)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self._lock is not None:
            fcntl.flock(self._lock, fcntl.LOCK_UN)
            self._lock.close()
            self._lock = None

    @property
    def is_read_only(self) -> bool:
        return self.options.reading_only

    # Manifest

    def _take_lock(self) -> None:
        self._lock = open(self.options.path.rstrip("/") + ".lock", "w")
        try:
            fcntl.flock(self._lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            self._lock.close()
            self._lock = None
            raise M.WriterLocked(self.options.path) from e

    def _open(self) -> None:
        if not os.path.exists(self._manifest_path):
            self._publish({"format_version": M.FORMAT_VERSION, "dimensions": self.options.dimensions, "generation": 0, "snapshot": 0, "tables": {}, "index": None})
        found = self._manifest()
        version = found.get("format_version", 0)
        if version > M.FORMAT_VERSION or (self.is_read_only and version != M.FORMAT_VERSION):
            raise M.UnsupportedFormat(f"format {version}; this version reads {M.FORMAT_VERSION}")
        if version < M.FORMAT_VERSION:
            raise M.ReindexRequired(f"format {version} must be rebuilt as {M.FORMAT_VERSION}")
        if found["dimensions"] != self.options.dimensions:
            raise M.InvalidInput(f"the store has {found['dimensions']} dimensions")
        if not self.is_read_only and not self._index_current(found):
            self._refresh_index(None)

    def _manifest(self) -> dict:
        try:
            with open(self._manifest_path) as f:
                return json.load(f)
        except (OSError, ValueError) as e:
            raise M.StorageError(str(e)) from e

    def _publish(self, manifest: dict) -> None:
        temporary = f"{self._manifest_path}.{uuid.uuid4().hex}"
        with open(temporary, "w") as f:
            json.dump(manifest, f)
            if self.options.durability_level is M.Durability.FULL:
                f.flush()
                os.fsync(f.fileno())
        os.replace(temporary, self._manifest_path)
        if self.options.durability_level is M.Durability.FULL:
            folder = os.open(self.options.path, os.O_RDONLY)
            os.fsync(folder)
            os.close(folder)

    def _read(self, name: str, segment: dict, delta: bool) -> DataFrame:
        fields = [*_TABLES[name].fields, *(T.StructField(c, T.StringType()) for c in segment["keys"])]
        schema = T.StructType(fields + [T.StructField("_gone", T.BooleanType())] * delta)
        return self.spark.read.schema(schema).parquet(os.path.join(self.options.path, segment["at"]))

    def _newest(self, name: str, segments: list[dict]) -> DataFrame:
        """Of all rows of later segments the last of each key, with ``_gone`` where the key was deleted."""
        parts = [self._read(name, x, True).withColumn("_seq", F.lit(k)) for k, x in enumerate(segments)]
        shared = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
        rows = parts[0].select(*shared)
        if len(parts) == 1:
            return rows.drop("_seq")
        for more in parts[1:]:
            rows = rows.union(more.select(*shared))
        kept = [c for c in shared if c != "_seq"]
        return rows.groupBy(*_KEYS[name]).agg(F.max_by(F.struct(*kept), "_seq").alias("_r")).select("_r.*")

    def _view(self, name: str, segments: list[dict]) -> DataFrame:
        """The live rows of a table: its first segment, with later ones laid over it by key."""
        if not segments:
            return self.spark.createDataFrame([], _TABLES[name])
        first = self._read(name, segments[0], False)
        return first if len(segments) == 1 else _over(first, self._newest(name, segments[1:]), _KEYS[name])

    def _table(self, name: str, manifest: dict | None = None) -> DataFrame:
        manifest = manifest or self._manifest()
        return self._view(name, manifest["tables"].get(name, []))

    def _tables(self) -> tuple[dict, dict[str, DataFrame]]:
        manifest = self._manifest()
        return manifest, {name: self._table(name, manifest) for name in M.TABLES}

    def _write(self, name: str, rows: DataFrame) -> dict:
        """One new segment, sorted for pruning and, with full durability, on disk when this returns."""
        at = f"{name}-{uuid.uuid4().hex}"
        keys = [J.key_column(p) for p in self.options.attribute_paths] if name == "nodes" else []
        for path, column in zip(self.options.attribute_paths, keys):
            rows = rows.withColumn(column, J.attribute_key("attributes", path))
        columns = [*_TABLES[name].fieldNames(), *keys, *(["_gone"] if "_gone" in rows.columns else [])]
        order = {"nodes": ["scope_id", *keys, "kind", "node_key"], "edges": ["source_key", "target_key"], "cells": ["cell"]}.get(name)
        rows = rows.select(*columns)
        if order:
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        folder = os.path.join(self.options.path, at)
        rows.write.parquet(folder)
        if self.options.durability_level is M.Durability.FULL:
            _sync(folder)
        segment = {"at": at, "keys": keys}
        return segment | {"rows": self._read(name, segment, "_gone" in rows.columns).count()}

    def _append(self, name: str, segments: list[dict], delta: DataFrame | dict) -> list[dict]:
        """The segments with one more, ``delta`` being rows with ``_gone`` or a segment already written.

        Later segments are merged so that each is at least twice as large as all after it together: there are as many
        as the logarithm of the table's size, and a row is written again as often, whatever the number of commits.
        """
        new = self._write(name, delta) if isinstance(delta, DataFrame) else delta
        if not new["rows"]:
            return segments
        if not segments:
            return [self._write(name, self._read(name, new, True).where("not _gone").drop("_gone", *new["keys"]))]
        segments = [*segments, new]
        k = len(segments) - 1
        while k and segments[k - 1]["rows"] < 2 * sum(x["rows"] for x in segments[k:]):
            k -= 1
        if k == len(segments) - 1:
            return segments
        merged = self._view(name, segments) if k == 0 else self._newest(name, segments[k:])
        return [*segments[:k], self._write(name, merged)]

    def _commit(self, manifest: dict, changed: dict, bump: bool = True, streams: dict[str, int] | None = None, **more) -> dict:
        """Publishes the manifest with the rows of ``changed`` (with ``_gone``) added to their tables."""
        tables = dict(manifest["tables"])
        for name, delta in changed.items():
            tables[name] = self._append(name, tables.get(name, []), delta)
        new = manifest | {"tables": tables, "snapshot": manifest["snapshot"] + 1, "generation": manifest["generation"] + bump} | more
        if streams:
            new["streams"] = manifest.get("streams", {}) | streams
        self._publish(new)
        return new

    # Index

    @staticmethod
    def _index_current(manifest: dict) -> bool:
        index = manifest.get("index")
        return bool(index) and index["generation"] == manifest["generation"]

    def _index_parts(self, manifest: dict) -> tuple[np.ndarray, DataFrame]:
        index = manifest["index"]
        return np.load(os.path.join(self.options.path, index["at"], "centroids.npy")), self._view("cells", index["cells"])

    def _refresh_index(self, before: dict | None, changed: DataFrame | None = None, removed: DataFrame | None = None) -> bool:
        """Brings the index to the present generation: if it was current before, by the changed vectors (``node_key,
        vector``) and removed keys alone, else, or once it holds ``GROWN`` times the vectors that its cells were made
        for, from all. A failure leaves search exact and never undoes the commit."""
        manifest = self._manifest()
        try:
            index = None
            if before is not None and self._index_current(before):
                index = dict(before["index"])
                centroids = np.load(os.path.join(self.options.path, index["at"], "centroids.npy"))
                for rows in (changed, removed):
                    if rows is not None:
                        live = vs.assign_cells(vs.indexable(rows, self.options.dimensions), centroids) if rows is changed else None
                        keys = rows.select("node_key") if live is None else rows.select("node_key").join(live.select("node_key"), "node_key", "left_anti")
                        gone = keys.select("node_key", F.lit(None).cast("int").alias("cell"), F.lit(None).cast("array<float>").alias("vector"), F.lit(True).alias("_gone"))
                        index["cells"] = self._append("cells", index["cells"], gone if live is None else live.withColumn("_gone", F.lit(False)).union(gone))
                if sum(x["rows"] for x in index["cells"]) > GROWN * max(index["fitted"], 1_000):
                    index = None
            if index is None:
                centroids, cells, n = vs.build_index(self._table("embeddings", manifest), self.options.dimensions)
                at = f"index-{uuid.uuid4().hex}"
                os.makedirs(os.path.join(self.options.path, at))
                np.save(os.path.join(self.options.path, at, "centroids.npy"), centroids)
                if self.options.durability_level is M.Durability.FULL:
                    _sync(os.path.join(self.options.path, at))
                index = {"at": at, "fitted": n, "cells": self._append("cells", [], cells.withColumn("_gone", F.lit(False)))}
            self._publish(manifest | {"index": index | {"generation": manifest["generation"]}})
            return True
        except Exception:
            self._publish(self._manifest() | {"index": None})
            return False

    # Scopes

    @_writing
    def get_or_create_scope(self, key: str) -> DataFrame:
        reads.text_argument(key, "scope key")
        manifest, t = self._tables()
        if t["scopes"].where(F.col("scope_key") == key).isEmpty():
            new = reads.register_scopes(t["scopes"], self.spark.createDataFrame([(0, key)], "pos int, scope_key string"))
            self._commit(manifest, {"scopes": _live(new.where(F.col("scope_key") == key))}, bump=False)
        return self.scope_by_key(key)

    def scope_by_key(self, key: str) -> DataFrame:
        return reads.scope_by_key(self._table("scopes"), key)

    def scope_by_id(self, id_: int) -> DataFrame:
        return reads.scope_by_id(self._table("scopes"), id_)

    # Reads

    def _nodes(self) -> DataFrame:
        return self._table("nodes")

    def _shown(self, nodes: DataFrame) -> DataFrame:
        return nodes.select("id", "scope_id", "kind", "name", "content", "attributes")

    def get_node(self, id_: str) -> DataFrame:
        return self._shown(reads.get_node(self._nodes(), id_))

    def get_nodes(self, ids: list[str]) -> DataFrame:
        return self._shown(reads.get_nodes(self._nodes(), ids))

    def list_nodes(self, where=M.SearchFilter(), limit: int = 100, offset: int = 0) -> DataFrame:
        return self._shown(reads.list_nodes(self._nodes(), where, limit, offset))

    def find_nodes_by_attribute(self, path: str, value, limit: int = 100, offset: int = 0, scope_id: int | None = None) -> DataFrame:
        return self._shown(reads.find_by_attribute(self._nodes(), path, value, limit, offset, scope_id))

    def find_nodes_by_name(self, text: str, where=M.SearchFilter(), limit: int = 100, offset: int = 0) -> DataFrame:
        return self._shown(reads.find_by_name(self._nodes(), text, where, limit, offset))

    def list_nodes_without_embeddings(self, where=M.SearchFilter(), limit: int = 100, offset: int = 0) -> DataFrame:
        _, t = self._tables()
        return self._shown(reads.page(reads.without_embeddings(t["nodes"], t["embeddings"], where), ["id"], limit, offset))

    def count_nodes(self, where=M.SearchFilter()) -> int:
        return reads.matching(self._nodes(), where).count()

    def count_nodes_without_embeddings(self, where=M.SearchFilter()) -> int:
        _, t = self._tables()
        return reads.without_embeddings(t["nodes"], t["embeddings"], where).count()

    def node_count(self) -> int:
        return self._nodes().count()

    def embedding_count(self) -> int:
        return self._table("embeddings").count()

    def get_edges(self, id_: str, direction=M.Direction.BOTH, relationship: str | None = None) -> DataFrame:
        _, t = self._tables()
        return reads.get_edges(t["edges"], t["nodes"], id_, direction, relationship)

    def traverse(self, start: str, direction=M.Direction.OUT, relationship: str | None = None, max_hops: int = 1, max_results: int = 100) -> DataFrame:
        _, t = self._tables()
        return bfs.traverse(t["nodes"], t["edges"], start, direction, relationship, max_hops, max_results)

    def catalog_get(self, namespace: str, key: str) -> DataFrame:
        return reads.catalog_get(self._table("catalog"), namespace, key)

    def catalog_list(self, namespace: str, limit: int = 100, offset: int = 0) -> DataFrame:
        return reads.catalog_list(self._table("catalog"), namespace, limit, offset)

    # Search

    def search(self, query: list[float], limit: int, where=M.SearchFilter(), backend=M.Backend.ADAPTIVE, probes: int = 32) -> M.SearchResults:
        vs.check_query(query, self.options.dimensions)
        if limit <= 0:
            raise M.InvalidInput("limit must be positive")
        manifest, t = self._tables()
        current = self._index_current(manifest)
        n = vs.candidates(t["nodes"], t["embeddings"], where).count() if backend is M.Backend.ADAPTIVE else 0
        used = choose(backend, n, self.options.threshold, current)
        if used is M.Backend.APPROXIMATE:
            if not current and (self.is_read_only or not self._refresh_index(None)):
                raise M.IndexUnavailable("the index is not current")
            manifest = self._manifest()
            centroids, cells = self._index_parts(manifest)
            hits = vs.ivf_topk(t["nodes"], cells, centroids, query, limit, where, probes)
        else:
            hits = vs.exact_topk(t["nodes"], t["embeddings"], query, limit, where)
        return M.SearchResults(used, hits)

    # Writes

    def _part(self, rows, schema: str, scratch: Scratch, name: str) -> DataFrame | None:
        if rows is None:
            return None
        if isinstance(rows, DataFrame):  # written once, so that its order is the same in every step
            return scratch.save(rows if "pos" in rows.columns else rows.withColumn("pos", F.monotonically_increasing_id()), name)
        rows = [(k, *r) for k, r in enumerate(rows)]
        return self.spark.createDataFrame(rows, f"pos long, {schema}") if rows else None

    def stream_position(self, stream: str) -> int:
        """The last epoch of a stream that is part of the committed state; -1 before the first."""
        return self._manifest().get("streams", {}).get(stream, -1)

    @_writing
    def apply_batch(self, batch: M.WriteBatch, streams: dict[str, int] | None = None) -> M.CommitReceipt:
        """Validates, then applies nodes, embeddings, edges, catalog values and catalog deletes as one commit.

        ``streams`` records epochs of streams in the same commit, so that a repeated epoch can be told.
        """
        scratch = Scratch(self.spark, "batch")
        part = lambda rows, schema, name: self._part(rows, schema, scratch, name)
        nodes, edges = part(batch.nodes, M.NODE_IN, "nodes"), part(batch.edges, M.EDGE_IN, "edges")
        embeddings = part(batch.embeddings, M.EMBEDDING_IN, "embeddings")
        catalog, deletes = part(batch.catalog, M.CATALOG_IN, "catalog"), part(batch.catalog_deletes, M.CATALOG_KEY_IN, "deletes")
        writes.validate(nodes=nodes, edges=edges, embeddings=embeddings, catalog=catalog, deletes=deletes, dimensions=self.options.dimensions)
        if all(x is None for x in (nodes, edges, embeddings, catalog, deletes)):
            raise M.InvalidInput("the batch is empty")
        manifest, t = self._tables()
        changed, more, vectors = {}, {}, None
        after, linked = t["nodes"].select(*M.NODE.fieldNames()), t["edges"]
        if nodes is not None:
            scope = t["scopes"].select(F.col("id").alias("scope_id"))
            if unknown := nodes.where("scope_id is not null").join(scope, "scope_id", "left_anti").take(1):
                raise M.ConstraintViolation(f"unknown scope {unknown[0]['scope_id']}")
            top = manifest.get("top_key")
            if top is None:
                top = after.agg(F.coalesce(F.max("node_key"), F.lit(0))).first()[0]
            stored = after.join(nodes.select("id"), "id", "left_semi").select(*M.NODE.fieldNames())
            changed["nodes"] = self._write("nodes", _live(writes.merge_nodes(stored, nodes, top)))
            new = self._read("nodes", changed["nodes"], True).select(*M.NODE.fieldNames(), "_gone")
            more["top_key"] = max(top, new.agg(F.max("node_key")).first()[0])
            after = _over(after, new, ["node_key"])
        if embeddings is not None:
            none = self.spark.createDataFrame([], M.EMBEDDING)
            changed["embeddings"] = self._write("embeddings", _live(writes.merge_embeddings(after, none, embeddings)))
            vectors = self._read("embeddings", changed["embeddings"], True).select("node_key", "vector")
        if edges is not None:
            keyed = scratch.save(writes.with_keys(after, edges), "keyed")
            if crossing := writes.scope_violations(after, keyed).take(1):
                raise M.InvalidInput(f"edge {crossing[0]['id']} crosses scopes")
            triple = ["source_key", "relationship", "target_key"]
            stored = linked.join(keyed.select(*triple).distinct(), triple, "left_semi").select(*M.EDGE.fieldNames())
            stored = scratch.save(stored.union(linked.join(keyed.select("id"), "id", "left_semi").select(*M.EDGE.fieldNames())).distinct(), "stored")
            new = scratch.save(writes.merge_edges(stored, keyed), "merged")
            freed = stored.join(new.select("id"), "id", "left_anti").withColumn("_gone", F.lit(True))
            delta = _live(new).unionByName(freed)
            changed["edges"], linked = delta, _over(linked, delta, ["id"])
        if nodes is not None:
            touched = after.join(nodes.select("id"), "id", "left_semi").select("node_key")
            if crossing := writes.scope_violations(after, linked, touched).take(1):
                raise M.InvalidInput(f"edge {crossing[0]['id']} crosses scopes")
        if catalog is not None or deletes is not None:
            columns = M.CATALOG.fieldNames()
            rows = [] if catalog is None else [_live(catalog.select(*columns))]
            rows += [] if deletes is None else [deletes.withColumns({"record_value": F.lit(None).cast("string"), "_gone": F.lit(True)}).select(*columns, "_gone")]
            changed["catalog"] = rows[0] if len(rows) == 1 else rows[0].union(rows[1])
        new = self._commit(manifest, changed, streams=streams, **more)
        ready = self._refresh_index(manifest, changed=vectors)
        scratch.close()
        return M.CommitReceipt(new["generation"], ready)

    @_writing
    def delete_nodes(self, ids: list[str]) -> M.DeleteReceipt:
        if not ids or any(not i.strip() for i in ids) or len(set(ids)) < len(ids):
            raise M.InvalidInput("node ids must be given, not blank and distinct")
        manifest, t = self._tables()
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id string")
        scratch = Scratch(self.spark, "gone")
        lost = scratch.save(t["nodes"].join(wanted, "id", "left_semi").select(*M.NODE.fieldNames()), "nodes")
        keys = lost.select("node_key")
        n = keys.count()
        if not n:
            return M.DeleteReceipt(manifest["generation"], 0, self._index_current(manifest))
        ends = [t["edges"].join(keys.withColumnRenamed("node_key", end), end, "left_semi").select(*M.EDGE.fieldNames()) for end in ("source_key", "target_key")]
        gone = {"nodes": lost, "edges": ends[0].union(ends[1]).distinct(), "embeddings": t["embeddings"].join(keys, "node_key", "left_semi").select("node_key", "vector")}
        new = self._commit(manifest, {name: rows.withColumn("_gone", F.lit(True)) for name, rows in gone.items()}, top_key=None)
        ready = self._refresh_index(manifest, removed=keys)
        scratch.close()
        return M.DeleteReceipt(new["generation"], n, ready)

    @_writing
    def delete_edge(self, id_: str) -> bool:
        manifest, t = self._tables()
        lost = t["edges"].where(F.col("id") == id_)
        if lost.isEmpty():
            return False
        self._commit(manifest, {"edges": lost.withColumn("_gone", F.lit(True))}, bump=False)
        return True

    @_writing
    def clear_embeddings(self) -> int:
        manifest, t = self._tables()
        if n := t["embeddings"].count():
            self._commit(manifest | {"tables": manifest["tables"] | {"embeddings": []}}, {})
            self._refresh_index(None)
        return n

    @_writing
    def truncate(self) -> int:
        manifest, t = self._tables()
        n = t["nodes"].count()
        self._publish(manifest | {"snapshot": manifest["snapshot"] + 1, "generation": manifest["generation"] + 1, "tables": {}, "top_key": 0})
        self._refresh_index(None)
        return n

    @_writing
    def vacuum(self) -> int:
        """Deletes table and index folders that the manifest no longer names."""
        manifest = self._manifest()
        index = manifest["index"] or {"at": None, "cells": []}
        used = {x["at"] for segments in (*manifest["tables"].values(), index["cells"]) for x in segments} | {index["at"]}
        old = [x for x in os.listdir(self.options.path) if os.path.isdir(os.path.join(self.options.path, x)) and x not in used]
        for x in old:
            shutil.rmtree(os.path.join(self.options.path, x))
        return len(old)

    # Diagnostics

    def generation(self) -> int:
        return self._manifest()["generation"]

    def stats(self) -> M.StoreStats:
        manifest, t = self._tables()
        row = diagnostics.stats(t["nodes"], t["edges"], t["embeddings"]).first()
        return M.StoreStats(manifest["generation"], row["nodes"], row["edges"], row["embeddings"], self._index_current(manifest), self.is_read_only)

    def verify_integrity(self) -> M.IntegrityReport:
        manifest, t = self._tables()
        files = all(os.path.isdir(os.path.join(self.options.path, x["at"])) for segments in manifest["tables"].values() for x in segments)
        if not files:
            return M.IntegrityReport(False, self._index_current(manifest), ["a table's files are missing"])
        found = diagnostics.integrity(t["nodes"], t["edges"], t["embeddings"], t["scopes"], t["catalog"], self.options.dimensions)
        issues = [f"{r['issue']}: {r['n']}" for r in found.where("n > 0").collect()]
        return M.IntegrityReport(True, self._index_current(manifest), issues)

    @_writing
    def repair_index(self) -> None:
        if not self._refresh_index(None):
            raise M.IndexUnavailable("the index could not be rebuilt")
