"""Point sets that change, and tables of neighbours that are kept."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halocline.operators.pairs import eps_pairs
from halocline.session import saved


class PointSet:
    """Points (id, v) under insertion and deletion, as a log of batches below a folder that executors share.

    A batch is written as a whole and then counts; of an id's entries the last
    batch's holds. A point that is inserted again is replaced, a deletion of an
    unknown id changes nothing, and ties of coordinates don't matter, as ids
    alone say what is deleted.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _write(self, rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{self.folder}/log")

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.folder}/log")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], "id long, v array<double>, batch int")
            raise

    def _next(self) -> int:
        return (self._log().agg(F.max("batch")).first()[0] or 0) + 1

    def insert(self, points: DataFrame) -> None:
        """Any number of points at once; of rows with the same id in one call the least vector stays."""
        self._write(points.groupBy(F.col("id").cast("long").alias("id")).agg(F.min("v").alias("v")), self._next())

    def delete(self, ids: DataFrame) -> None:
        """The points with these ids (column ``id``)."""
        self._write(ids.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v")).distinct(), self._next())

    def current(self) -> DataFrame:
        """(id, v) of the points that are there."""
        last = self._log().groupBy("id").agg(F.max_by("v", "batch").alias("v"))
        return last.where("v is not null")

    def compact(self) -> PointSet:
        """The same points as a set of one batch, in a folder of its own beside this one."""
        new = PointSet(self.spark, f"{self.folder}-{uuid.uuid4().hex}")
        new.insert(self.current())
        return new


class NeighborTable:
    """The pairs within ``eps`` of each other, computed once, for questions up to that radius; a point is not its own neighbour."""

    def __init__(self, points: DataFrame, eps: float, d: int | None = None):
        self.eps, self.points = float(eps), points
        self.pairs = saved(eps_pairs(points, eps, d).where("a <> b"))

    def within(self, r: float) -> DataFrame:
        """(id, other, d2) of the neighbours within ``r``."""
        if r > self.eps:
            raise ValueError(f"{r}: the table reaches as far as {self.eps}")
        return self.pairs.where(F.col("d2") <= F.lit(float(r)) * F.lit(float(r))).select(F.col("a").alias("id"), F.col("b").alias("other"), "d2")

    def count(self, r: float) -> DataFrame:
        """(id, n) of every point."""
        met = self.within(r).groupBy("id").agg(F.count("*").alias("n"))
        return self.points.select("id").join(met, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))

    def nearest(self, r: float) -> DataFrame:
        """(id, other, d2): the nearest neighbour within ``r`` of the points that have one, the smaller id on a tie."""
        first = Window.partitionBy("id").orderBy("d2", "other")
        return self.within(r).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
