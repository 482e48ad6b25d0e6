"""Joins whose small side is broadcast only after its size was measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, and units of ``weight``, of a side that may be broadcast; a larger one is joined by shuffle.
MOST_ROWS, MOST_WEIGHT = 50_000, 400_000


def sized(side: DataFrame, weight: Column | None = None) -> DataFrame:
    """``side`` (already materialised, as it is read for its size), marked for broadcast if it is small."""
    weight = F.lit(1) if weight is None else weight
    rows, total = side.select(weight.cast("long").alias("w")).limit(MOST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(side) if rows <= MOST_ROWS and total <= MOST_WEIGHT else side
