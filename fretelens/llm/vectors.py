"""Reading vector tables: what takes part, and in which form it travels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", allow_zero: bool = True) -> DataFrame:
    """(id long, v array<double>) of the vectors that take part.

    Left out: null ids, null vectors, vectors holding null or non-finite
    components, empty ones, those of another dimension than most rows (ties:
    the larger dimension), and all-zero ones unless ``allow_zero``.  Of rows
    that repeat an id one stays (the smallest vector).  Other columns are
    ignored.
    """
    v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
    if not allow_zero:
        v = v.where(F.exists("v", lambda x: x != 0))
    v = v.groupBy("id").agg(F.min("v").alias("v"))
    most = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return v.where(F.size("v") == (most["d"] if most else 0))


def matrix(column: pd.Series, d: int | None = None) -> np.ndarray:
    """A column of float64 vectors, as lists or as raw bytes, as one matrix."""
    if not len(column):
        return np.zeros((0, d or 0))
    if isinstance(column.iloc[0], (bytes, bytearray, memoryview)):
        return np.frombuffer(b"".join(column), dtype="<f8").reshape(len(column), -1)
    return np.stack(column.to_numpy()).astype(np.float64)
