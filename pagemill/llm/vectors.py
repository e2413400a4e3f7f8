"""Reading vectors from array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Not null, not empty, all components finite, and not all zero."""
    big = F.lit(float("inf"))
    return F.coalesce(
        (F.size(vec) > 0)
        & F.forall(vec, lambda x: F.coalesce((x > -big) & (x < big) & ~F.isnan(x), F.lit(False)))
        & F.exists(vec, lambda x: x != 0.0),
        F.lit(False),
    )


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without squares that leave the range of doubles."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def dimension(df: DataFrame, vec: str) -> int:
    """The one length of all vectors; 0 without rows, an error where lengths differ."""
    got = df.agg(F.min(F.size(vec)).alias("lo"), F.max(F.size(vec)).alias("hi")).first()
    if got["lo"] is None:
        return 0
    if got["lo"] != got["hi"]:
        raise ValueError(f"vectors of {got['lo']} to {got['hi']} components")
    return got["hi"]
