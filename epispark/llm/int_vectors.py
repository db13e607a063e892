"""Integer forms of float vectors, for operators that need exact sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MOST = float((1 << 31) - 1)


def int_rows(vectors: DataFrame, vector_col: str, scale: int, *columns: Column) -> DataFrame:
    """``columns`` and ``_v``: every component x as floor(scale * x), x taken
    as double.

    Rows whose vector is null, or holds a null or non-finite component, or one
    whose integer does not fit in 32 bits, are left out."""
    vector = F.col(vector_col)
    scaled = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    good = F.forall(vector, lambda x: x.isNotNull()) & F.forall(scaled, lambda x: (F.abs(x) <= MOST) & ~F.isnan(x))
    return vectors.where(F.coalesce(good, F.lit(False))).select(
        *columns, F.transform(scaled, lambda x: F.floor(x).cast("int")).alias("_v"))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """Rows of an Arrow list column, all of one length, as an int32 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(column), length)


def largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def exact(bound: int):
    """The narrowest kind of number that holds integers up to ``bound``."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
