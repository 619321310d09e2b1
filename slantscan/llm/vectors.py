"""Reading vector columns inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the rows whose vector takes part: not null, not zero, no
    null or non-finite component, and with an id."""
    kind = "array<float>" if dict(df.dtypes).get(vec_col) == "array<float>" else "array<double>"
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vec", lambda x: x != 0)
    return v.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True)) & some)


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long vectors as a matrix."""
    import pyarrow as pa

    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(a), -1).astype(np.float64)  # exact for single precision
