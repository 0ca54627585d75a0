"""Record types, enums, receipts and errors of the graph store."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, types as T

FORMAT_VERSION = 3
DEFAULT_EXACT_THRESHOLD = 10_000

NODE = T.StructType(
    [
        T.StructField("node_key", T.LongType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("scope_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("attributes", T.StringType()),
    ]
)
EDGE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("source_key", T.LongType(), False),
        T.StructField("target_key", T.LongType(), False),
        T.StructField("relationship", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("attributes", T.StringType()),
    ]
)
SCOPE = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("scope_key", T.StringType(), False)])
EMBEDDING = T.StructType(
    [T.StructField("node_key", T.LongType(), False), T.StructField("vector", T.ArrayType(T.FloatType(), False), False)]
)
CATALOG = T.StructType(
    [
        T.StructField("record_namespace", T.StringType(), False),
        T.StructField("record_key", T.StringType(), False),
        T.StructField("record_value", T.StringType()),
    ]
)
TABLES = {"nodes": NODE, "edges": EDGE, "scopes": SCOPE, "embeddings": EMBEDDING, "catalog": CATALOG}

#: What a caller hands in: ids instead of storage keys, in batch order.
NODE_IN = "id string, scope_id long, kind string, name string, content string, attributes string"
EDGE_IN = "id string, source_id string, target_id string, relationship string, weight double, attributes string"
EMBEDDING_IN = "node_id string, vector array<float>"
CATALOG_IN = "record_namespace string, record_key string, record_value string"
CATALOG_KEY_IN = "record_namespace string, record_key string"


class Direction(Enum):
    OUT = "out"
    IN = "in"
    BOTH = "both"


class Backend(Enum):
    ADAPTIVE = "adaptive"
    EXACT = "exact"
    APPROXIMATE = "approximate"


class Durability(Enum):
    FULL = "full"
    NORMAL = "normal"


class StoreError(Exception):
    """Base of all errors of the store."""


class InvalidInput(StoreError, ValueError):
    """Input that breaks a documented contract."""


class StorageError(StoreError):
    """A table or the manifest could not be read or written."""


class ConstraintViolation(StoreError):
    """A unique or foreign key, or the same-scope rule of edges, would be broken."""


class WriterLocked(StoreError):
    """Another process holds the writer lock."""


class ReadOnly(StoreError):
    """A change was asked of a read-only handle."""


class UnsupportedFormat(StoreError):
    """The manifest's format is not this version's."""


class ReindexRequired(StoreError):
    """The manifest's format is older and is not migrated."""


class IndexUnavailable(StoreError):
    """Approximate search was asked for and cannot be served."""


@dataclass(frozen=True)
class SearchFilter:
    scope_id: int | None = None
    kind: str | None = None


@dataclass(frozen=True)
class WriteBatch:
    """Any of the five parts; each a DataFrame or a list of tuples in the column order of its ``*_IN`` schema."""

    nodes: object = None
    edges: object = None
    embeddings: object = None
    catalog: object = None
    catalog_deletes: object = None


@dataclass(frozen=True)
class CommitReceipt:
    generation: int
    index_ready: bool


@dataclass(frozen=True)
class DeleteReceipt:
    generation: int
    deleted: int
    index_ready: bool


@dataclass(frozen=True)
class SearchResults:
    backend: Backend
    hits: DataFrame


@dataclass(frozen=True)
class StoreStats:
    generation: int
    nodes: int
    edges: int
    embeddings: int
    index_ready: bool
    read_only: bool


@dataclass(frozen=True)
class IntegrityReport:
    files_ok: bool
    index_ready: bool
    issues: list[str] = field(default_factory=list)

    @property
    def is_healthy(self) -> bool:
        return self.files_ok and self.index_ready and not self.issues
