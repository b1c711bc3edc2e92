"""What the vector operators share: which vectors take part, and vectors as matrices of integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 256
"""A component x becomes floor(SCALE * x)."""
LIMIT = 1 << 26
"""Larger whole components count as this one: sums of squares of 64 of them still fit 64 bits."""


def finite(vec_col: str, dims: int | None = None) -> Column:
    """Whether the vector is there, has the number of components, and none of them is null or not finite."""
    usable = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    present = F.col(vec_col).isNotNull()
    if dims is not None:
        present &= F.size(vec_col) == dims
    return F.coalesce(present & usable, F.lit(False))


def whole(column: pa.Array, dims: int) -> np.ndarray:
    """A column of lists as one row of integers each; components beyond ``dims`` go, missing ones are 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    flat = np.clip(np.floor(SCALE * flat), -LIMIT, LIMIT).astype(np.int64)
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), dtype=np.int64)
    ends = np.cumsum(lengths)
    for i, (end, n) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
        out[i, : min(n, dims)] = flat[end - n : end - n + min(n, dims)]
    return out
