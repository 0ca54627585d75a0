"""Vector expressions that stay in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def is_valid(vector: str, dimensions: int) -> Column:
    """Right length, no null and only finite coordinates."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & ~bad, F.lit(False))


def is_zero(vector: str) -> Column:
    return F.forall(vector, lambda x: x == 0)


def dot(a: Column, b: Column, kind: str = "double") -> Column:
    zero = F.lit(0.0).cast(kind)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast(kind) * y.cast(kind)), zero, lambda s, x: (s + x).cast(kind))


def norm(a: Column, kind: str = "double") -> Column:
    return F.sqrt(dot(a, a, kind)).cast(kind)


def cosine_distance(vector: Column, query: list[float], kind: str = "float") -> Column:
    """``1 - cosine`` by sequential sums in ``kind``; with ``float`` every step is rounded to 32 bits."""
    q = F.array(*[F.lit(float(x)).cast(kind) for x in query])
    return (F.lit(1.0).cast(kind) - (dot(vector, q, kind) / (norm(vector, kind) * norm(q, kind)).cast(kind)).cast(kind)).cast(kind)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of a binary column; null where the length is no multiple of four."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """The reverse of ``from_blob``."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
