"""Epsilon-range joins, counts and nearest neighbours.

In up to three dimensions, points fall into buckets of side epsilon; one side is
repeated into the adjacent buckets and joined by bucket, so that what Spark
sees is an equi-join with the distance as residual condition.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halocline.functions.vectors import distance_squared
from halocline.operators.points import dimension, squared
from halocline.session import cut, scratch, ship

#: Highest dimension for buckets: 3**d of them surround a point.
GRID_DIMENSIONS = 3
#: Rounding of a quotient can't carry a pair in range beyond the next bucket.
SLACK = 1 + 1e-9
#: A centre set, or a block of queries, up to this many rows is broadcast.
FEW = 10_000
#: Distances of queries and points that are held at once.
MATRIX = 1 << 20


def cells(df: DataFrame, d: int, side: float, prefix: str = "x", name: str = "c") -> DataFrame:
    """Adds c0 .. c(d-1), the bucket of side ``side``."""
    return df.withColumns({f"{name}{i}": F.floor(F.col(f"{prefix}{i}") / F.lit(side)).cast("long") for i in range(d)})


def surrounded(df: DataFrame, d: int, reach: int = 1, name: str = "c") -> DataFrame:
    """Each row once for every bucket within ``reach`` of its own."""
    offsets = F.array(*(F.struct(*(F.lit(o).cast("long").alias(f"o{i}") for i, o in enumerate(step))) for step in product(range(-reach, reach + 1), repeat=d)))
    opened = df.withColumn("_o", F.explode(offsets))
    return opened.withColumns({f"{name}{i}": F.col(f"{name}{i}") + F.col(f"_o.o{i}") for i in range(d)}).drop("_o")


def range_join(left: DataFrame, right: DataFrame, eps: float, d: int | None = None, how: str = "inner") -> DataFrame:
    """(a, b, d2) for points of ``left`` and ``right`` at most ``eps`` apart; how="left_semi": (a) of those with any.

    Above GRID_DIMENSIONS the buckets use the first dimensions only, which is
    exact too but prunes less; see voronoi.py for a better way there.
    """
    d = d or dimension(left)
    g = min(d, GRID_DIMENSIONS)
    one, two = ["id", "v"], [F.col("id").alias("b"), F.col("v").alias("w")]
    a = cells(left.select(*one, *(F.col("v")[i].alias(f"x{i}") for i in range(g))), g, eps * SLACK).withColumnRenamed("id", "a")
    b = cells(right.select(*two, *(F.col("v")[i].alias(f"y{i}") for i in range(g))), g, eps * SLACK, "y")
    keys = [f"c{i}" for i in range(g)]
    a = surrounded(a, g)
    d2 = squared([F.col(f"x{i}") for i in range(g)], [F.col(f"y{i}") for i in range(g)]) if d == g else distance_squared(F.col("v"), F.col("w"))
    near = d2 <= F.lit(float(eps)) * F.lit(float(eps))
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    met = near
    for k in keys:
        met = met & (F.col(k) == F.col(f"_{k}"))
    if how == "left_semi":
        return a.join(b, met, "left_semi").select("a").distinct()
    return a.join(b, met).select("a", "b", d2.alias("d2"))


def eps_pairs(points: DataFrame, eps: float, d: int | None = None) -> DataFrame:
    """Ordered pairs (a, b, d2) within ``eps``, each point with itself included."""
    return range_join(points, points, eps, d)


def range_count(points: DataFrame, eps: float, d: int | None = None) -> DataFrame:
    """(id, n): how many points are within ``eps`` of each, itself included.

    In up to three dimensions, cells that lie wholly within ``eps`` of a point's
    cell count as a whole; only points of the cells around those are compared.
    """
    from halocline.operators.dbscan import Grid

    d = d or dimension(points)
    if d > GRID_DIMENSIONS:
        return eps_pairs(points, eps, d).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    grid = Grid(points, eps, d)
    xs, ys = ([F.col(f"{p}{i}") for i in range(d)] for p in "xy")
    whole = grid.near.where("inside").groupBy("cell").agg(F.sum("m").alias("n"))
    rim = grid.placed.drop("n").join(grid.near.where("not inside").select("cell", "other"), "cell").join(grid.other(), "other")
    met = rim.where(squared(xs, ys) <= F.lit(grid.eps * grid.eps)).groupBy("id").agg(F.count("*").alias("more"))
    return grid.placed.select("id", "cell").join(whole, "cell").join(met, "id", "left").select("id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))


def range_query(points: DataFrame, queries: DataFrame, r: float, d: int | None = None) -> DataFrame:
    """(query, id, d2) of the points within ``r`` of each query point."""
    return range_join(queries, points, r, d).select(F.col("a").alias("query"), F.col("b").alias("id"), "d2")


def has_neighbor(points: DataFrame, others: DataFrame, r: float, d: int | None = None) -> DataFrame:
    """(id) of the points with any of ``others`` within ``r``."""
    return range_join(points, others, r, d, "left_semi").select(F.col("a").alias("id"))


def listed(centers: DataFrame) -> DataFrame:
    """One row ``cs``: the centres (cell, center) as a sorted list. A set beyond FEW rows is refused."""
    rows = centers.select("cell", "center").limit(FEW + 1).agg(F.sort_array(F.collect_list(F.struct("cell", "center"))).alias("cs"))
    return rows.withColumn("cs", F.when(F.size("cs") <= FEW, F.col("cs")).otherwise(F.raise_error(F.lit(f"more than {FEW} centres"))))


def nearest(points: DataFrame, centers: DataFrame) -> DataFrame:
    """id, v, cell, d2: the nearest centre, the smaller cell on a tie. No shuffle: the list of centres is broadcast."""
    options = F.transform("cs", lambda c: F.struct(distance_squared(F.col("v"), c["center"]).alias("d2"), c["cell"].alias("cell")))
    return points.join(F.broadcast(listed(centers))).withColumn("_n", F.array_min(options)).select("id", "v", F.col("_n.cell").alias("cell"), F.col("_n.d2").alias("d2"))


def knn(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, rank, id, d2): the k nearest points of each query; ties by id. k <= 0: none.

    Queries go in blocks of at most FEW, one job after the other. A block is
    broadcast; each task holds the k best so far for each of its queries over all
    points that it reads, so that k rows a query and task are all that is shuffled.
    """
    spark, schema = points.sparkSession, "query long, id long, d2 double"
    asked = cut(queries.select(F.col("id").alias("query"), F.col("v").alias("w")))
    n = max(1, math.ceil(2 * asked.count() / FEW)) if asked.limit(FEW + 1).count() > FEW else 1
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    ship(spark)
    for i in range(n if k > 0 else 0):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(n)) == i).collect()
        if not rows:
            continue
        block = spark.sparkContext.broadcast((np.array([r["query"] for r in rows], np.int64), np.array([r["w"] for r in rows], float)))
        best = points.select("id", "v").mapInArrow(partial(_nearest_of, block=block, k=k), schema)
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d2", "id"))).where(F.col("rank") <= k)
        ranked.select("query", "rank", "id", "d2").write.mode("append").parquet(folder)
        block.unpersist()
    spark.createDataFrame([], "query long, rank int, id long, d2 double").write.mode("append").parquet(folder)
    return spark.read.schema("query long, rank int, id long, d2 double").parquet(folder)


def _nearest_of(batches: Iterator[pa.RecordBatch], block, k: int) -> Iterator[pa.RecordBatch]:
    """The k points of a task nearest to each query of the block; squared distances are summed from the first coordinate on."""
    names, at = block.value
    held_id, held_d2 = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))
    for batch in batches:
        for low in range(0, batch.num_rows, part := max(k, MATRIX // len(names))):
            ids = batch.column(0).slice(low, part).to_numpy()
            lists = batch.column(1).slice(low, part)
            lengths = np.diff(lists.offsets.to_numpy())
            if (lengths != at.shape[1]).any():
                raise ValueError("vectors differ in length")
            v = lists.flatten().to_numpy().reshape(len(ids), -1)
            d2 = np.zeros((len(names), len(ids)))
            for j in range(at.shape[1]):
                gap = at[:, j, None] - v[None, :, j]
                d2 += gap * gap
            held_id, held_d2 = np.concatenate([held_id, np.broadcast_to(ids, d2.shape)], 1), np.concatenate([held_d2, d2], 1)
            order = np.lexsort((held_id, held_d2), axis=1)[:, :k]
            held_id, held_d2 = np.take_along_axis(held_id, order, 1), np.take_along_axis(held_d2, order, 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, held_id.shape[1])), pa.array(held_id.ravel()), pa.array(held_d2.ravel())], names=["query", "id", "d2"])


def side_distance(v: Column, low: Column, high: Column) -> Column:
    """Distance along one axis from a value to an interval."""
    return F.greatest(low - v, v - high, F.lit(0.0))
