"""What the two vector operators share: which vectors take part, and equal vectors as one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding"):
    """True for vectors that aren't null or zero and hold no null or non-finite component."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(c.isNotNull() & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def hyperplanes(dim: int, count: int, seed: int) -> np.ndarray:
    """dim x count standard normal numbers, the same in every process."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def doubles(df: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the usable rows; a float widens without change."""
    return df.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
