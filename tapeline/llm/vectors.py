"""What the vector operators share: which vectors take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN and infinite components; false for a null one."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)
