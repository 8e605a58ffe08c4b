"""What the vector operators share: which vectors take part, and blocks of them as matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(embedding: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame, *columns: str) -> DataFrame:
    """One row for each vec_id that takes part, with ``dim``; where rows of an id differ, the least in order of its columns and vector."""
    vectors = vectors.where(F.col("vec_id").isNotNull()).where(takes_part(F.col("embedding")))
    one = vectors.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(*columns, "embedding")).alias("x"))
    return one.select("vec_id", *(F.col(f"x.{c}").alias(c) for c in columns), F.col("x.embedding").alias("embedding"), F.size("x.embedding").alias("dim"))


def matrix(column: pd.Series | pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows, in double precision."""
    return np.array([np.asarray(x, np.float64) for x in column])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision: dot product over the product of the norms."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
