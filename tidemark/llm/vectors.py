"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: str) -> Column:
    """True where the vector is there and no component is null, NaN or infinite."""
    inside = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(c).isNotNull() & F.coalesce(inside, F.lit(False))


def stacked(rows, dim: int, dtype) -> np.ndarray:
    """Arrays as a matrix of dim columns; shorter ones are filled with zeros."""
    out = np.zeros((len(rows), dim), dtype)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out
