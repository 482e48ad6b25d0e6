"""Point sets: ``id`` (long) and ``v`` (array of double)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def points(df: DataFrame, id_col: str, coordinates: list[Column | str]) -> DataFrame:
    """Points from scalar columns."""
    cols = [F.col(c) if isinstance(c, str) else c for c in coordinates]
    return df.select(F.col(id_col).cast("long").alias("id"), F.array(*(c.cast("double") for c in cols)).alias("v"))


def from_array(df: DataFrame, id_col: str, column: str, dims: int | None = None) -> DataFrame:
    """Points from an array column, or from its first ``dims`` entries."""
    v = F.col(column) if dims is None else F.slice(F.col(column), 1, dims)
    return df.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def dimension(points_: DataFrame) -> int:
    """The first point's dimension; 1 for an empty set."""
    row = points_.select(F.size("v")).first()
    return row[0] if row else 1


def validated(points_: DataFrame, d: int) -> DataFrame:
    """The same points; a row with another dimension or a missing coordinate fails the job."""
    right = (F.size("v") == d) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    return points_.withColumn("v", F.when(F.coalesce(right, F.lit(False)), F.col("v")).otherwise(F.raise_error(F.concat(F.lit("not a point: id "), F.col("id").cast("string")))))


def wide(points_: DataFrame, d: int, prefix: str = "x") -> DataFrame:
    """id, x0 .. x(d-1): scalar columns stay inside generated code."""
    return points_.select("id", *(F.col("v")[i].alias(f"{prefix}{i}") for i in range(d)))


def squared(a: list[Column], b: list[Column]) -> Column:
    """Squared distance of coordinate columns, summed from the first on."""
    total = None
    for x, y in zip(a, b):
        total = (x - y) * (x - y) if total is None else total + (x - y) * (x - y)
    return total
