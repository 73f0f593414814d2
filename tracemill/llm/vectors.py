"""Reading vector columns out of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(col: str) -> Column:
    """Not null, and neither null nor non-finite in any component."""
    ok = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.coalesce(F.col(col).isNotNull() & ok, F.lit(False))


def matrix(column: pa.Array, dim: int, dtype: type = np.float64) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``dim``."""
    off = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(off)
    if len(sizes) and (sizes == dim).all():
        return values[off[0] : off[-1]].reshape(-1, dim).astype(dtype)
    out = np.zeros((len(sizes), dim), dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], sizes)] = values[off[0] : off[-1]]
    return out
