"""Agreement of two labellings of the same rows; natural logarithms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entropy(df: DataFrame, label: str | Column) -> DataFrame:
    """One row ``entropy``; 0 for an empty input."""
    counts = df.groupBy(F.col(label) if isinstance(label, str) else label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return counts.join(F.broadcast(total)).agg(F.coalesce(-F.sum(p * F.log(p)), F.lit(0.0)).alias("entropy"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual_information, entropy_a, entropy_b, nmi.

    nmi is MI / sqrt(entropy_a * entropy_b): 1 if both labellings are constant,
    0 if one is. A single pass over the rows; the rest works on the table of counts.
    """
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("na"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    total = F.broadcast(cells.agg(F.sum("n").alias("t")))
    h = lambda side, n: side.join(total).agg(F.coalesce(-F.sum(F.col(n) / F.col("t") * F.log(F.col(n) / F.col("t"))), F.lit(0.0)).alias(f"entropy_{n[1]}"))
    joint = cells.join(rows, cells["a"].eqNullSafe(rows["a"])).join(cols, cells["b"].eqNullSafe(cols["b"])).join(total)
    mi = joint.agg(F.coalesce(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))), F.lit(0.0)).alias("mutual_information"))
    flat = F.lit(1e-12)
    ea, eb = F.col("entropy_a"), F.col("entropy_b")
    nmi = F.when((ea <= flat) & (eb <= flat), 1.0).when((ea <= flat) | (eb <= flat), 0.0).otherwise(F.col("mutual_information") / F.sqrt(F.greatest(ea, flat) * F.greatest(eb, flat)))
    return mi.join(F.broadcast(h(rows, "na"))).join(F.broadcast(h(cols, "nb"))).withColumn("nmi", nmi)
