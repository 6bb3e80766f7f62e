"""Columns of vectors: which rows can be used, and their components in tasks."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_whole(vector: Column) -> Column:
    """Neither the vector nor a component is null, and all components are finite."""

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def dimension(rows: DataFrame, vector: str, multiple: int = 1) -> int:
    """The length of most vectors, of equals the greatest, among positive multiples of
    ``multiple``; 0 if there is none."""
    n = F.size(vector)
    lengths = rows.where(is_whole(F.col(vector))).select(n.alias("n")).where((F.col("n") > 0) & (F.col("n") % multiple == 0))
    found = lengths.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return found["n"] if found else 0


def with_length(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """The rows whose vectors are whole and have that length."""
    return rows.where(is_whole(F.col(vector)) & (F.size(vector) == size))


def scaled(vectors: pa.Array, size: int, scale: int, factor: int) -> np.ndarray:
    """``floor(scale * x)`` as doubles, a row for each vector. Components whose sums of
    ``size`` products of numbers ``factor`` times as large would pass a long are refused."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = np.asarray(vectors.flatten().cast(pa.float64()))
    out = np.floor(flat * scale).reshape(-1, size)
    most = np.abs(out).max(initial=0)
    if most > isqrt((2**63 - 1) // max(size, 1)) // factor:
        raise ArithmeticError(f"a component of {most / scale:.3g} is too large: sums of products would not fit a long")
    return out
