"""What the operators on vectors share."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Not null, without null or non-finite components, not zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(column, lambda x: x != 0)
    return F.col(column).isNotNull() & F.coalesce(~bad, F.lit(False)) & F.coalesce(some, F.lit(False))


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, label, vector (doubles) and dim of the vectors that take part; equal rows once, null ids left out."""
    return (
        table.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
        .where(usable() & F.col("vec_id").isNotNull())
        .dropDuplicates(["vec_id", "label", "embedding"])
        .select("vec_id", "label", F.col("embedding").alias("vector"), F.size("embedding").alias("dim"))
    )


def matrix(column) -> np.ndarray:
    """Rows of a column of lists of doubles."""
    return np.array(list(column), dtype=np.float64)


def unit(rows: np.ndarray) -> np.ndarray:
    scale = np.abs(rows).max(axis=1, keepdims=True)  # keeps squares in range
    rows = rows / scale
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def sample_of(rows: DataFrame, at_most: int, total: int) -> DataFrame:
    """About ``at_most`` rows, chosen by a hash of their ids."""
    scale = 1 << 30
    return rows.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(scale)) < int(scale * min(1.0, at_most / max(total, 1))))
