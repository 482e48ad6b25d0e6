"""Exact DBSCAN on DataFrames.

Core: at least ``min_pts`` points within ``eps``, itself included. Clusters:
components of core points at most ``eps`` apart, named by their smallest core
id. Border: not core, with a core neighbour; it gets the smallest of their
clusters. Noise: the rest, cluster -1.

Points fall into cells of diagonal ``eps``; what is joined are cells first, by the
boxes around their points, and points only where cells leave something open:

- a cell with ``min_pts`` points is dense, all its points are core, and its core
  points are one vertex of the graph (as those of any cell are);
- the points of other cells, fewer than ``min_pts`` each, meet the points of the
  cells in reach. A point is met by that many at most, so the rows grow with the
  points however they lie. They give the counts, the links of these cells, and
  the borders;
- two dense cells are linked if their boxes lie wholly within ``eps``, or by their
  outermost points. Pairs that are still apart after all this are divided into
  parts with boxes of their own, and only points of parts that are neither surely
  near nor surely far are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.operators.components import connected_components
from halocline.operators.pairs import GRID_DIMENSIONS, cells, side_distance, surrounded
from halocline.operators.points import dimension, squared, validated, wide
from halocline.session import cut, saved

CORE, BORDER, NOISE = "core", "border", "noise"
#: Cells are so much smaller than they might be that rounding can't put two points of one beyond eps.
MARGIN = 1 - 1e-6
#: Cells that hold points within eps of each other are at most so far apart, along each axis.
REACH = 2
#: About so many points come into a part of a dense cell that has to be compared with another.
PART_POINTS = 64


def _columns(prefix: str, d: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(d)]


def _within(eps: float, d: int) -> Column:
    return squared([F.col(c) for c in _columns("x", d)], [F.col(c) for c in _columns("y", d)]) <= F.lit(eps * eps)


def _box(d: int) -> list[Column]:
    return [f(f"x{i}").alias(f"{k}{i}") for i in range(d) for k, f in (("low", F.min), ("high", F.max))]


def _gap(d: int) -> Column:
    """Squared distance of two boxes (low*, high* and _low*, _high*), rounded down a little."""
    total = F.lit(0.0)
    for i in range(d):
        apart = F.greatest(F.col(f"_low{i}") - F.col(f"high{i}"), F.col(f"low{i}") - F.col(f"_high{i}"), F.lit(0.0))
        total = total + apart * apart
    return total * (1 - 1e-9)


def _span(d: int) -> Column:
    """Squared distance of two boxes' farthest places, rounded up a little."""
    total = F.lit(0.0)
    for i in range(d):
        far = F.greatest(F.col(f"_high{i}") - F.col(f"low{i}"), F.col(f"high{i}") - F.col(f"_low{i}"))
        total = total + far * far
    return total * (1 + 1e-9)


def celled(points: DataFrame, eps: float, d: int) -> DataFrame:
    """id, x*, c*: points with their cell of diagonal ``eps``."""
    return cells(wide(validated(points, d), d), d, eps / math.sqrt(d) * MARGIN)


class Grid:
    """The points with their cells, and which cells are in reach of which.

    ``cells``: cell (its smallest id), n, the box of its points; ``near``: (cell,
    other, n, m, inside) of cells in reach, itself included, with their points
    and whether all of them surely are within eps; ``placed``: id, x*, cell, n.
    """

    def __init__(self, points: DataFrame, eps: float, d: int):
        self.eps, self.d = float(eps), d
        keys, box = _columns("c", d), [f"{k}{i}" for i in range(d) for k in ("low", "high")]
        raw = celled(points, self.eps, d)
        self.cells = saved(raw.groupBy(*keys).agg(F.min("id").alias("cell"), F.count("*").alias("n"), *_box(d)))
        self.placed = saved(raw.join(self.cells.select(*keys, "cell", "n"), keys).select("id", *_columns("x", d), "cell", "n"))
        other = self.cells.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("cell").alias("other"), F.col("n").alias("m"), *(F.col(b).alias(f"_{b}") for b in box))
        met = _gap(d) <= F.lit(self.eps * self.eps)
        for k in keys:
            met = met & (F.col(k) == F.col(f"_{k}"))
        inside = (_span(d) <= F.lit(self.eps * self.eps)) | (F.col("cell") == F.col("other"))
        self.near = saved(surrounded(self.cells, d, REACH).join(other, met).select("cell", "other", "n", "m", inside.alias("inside")))

    def other(self, rows: DataFrame | None = None) -> DataFrame:
        """Points as the far side of a join: oid, y*, other."""
        rows = self.placed if rows is None else rows
        return rows.select(F.col("id").alias("oid"), *(F.col(f"x{i}").alias(f"y{i}") for i in range(self.d)), F.col("cell").alias("other"))


def _neighbours(grid: Grid, min_pts: int) -> DataFrame:
    """(id, cell, oid, other, dense) of each point of a cell with fewer than ``min_pts``, and its neighbours, itself included; dense: whether theirs is a dense cell."""
    xs = _columns("x", grid.d)
    few = grid.placed.where(F.col("n") < min_pts).select("id", *xs, "cell")
    reach = grid.near.where(F.col("n") < min_pts).select("cell", "other", (F.col("m") >= min_pts).alias("dense"))
    return saved(few.join(reach, "cell").join(grid.other(), "other").where(_within(grid.eps, grid.d)).select("id", "cell", "oid", "other", "dense"))


def _flagged(grid: Grid, pairs: DataFrame, min_pts: int) -> DataFrame:
    """id, x*, cell, is_core of every point."""
    enough = pairs.groupBy("id").agg((F.count("*") >= min_pts).alias("enough"))
    return grid.placed.join(enough, "id", "left").select("id", *_columns("x", grid.d), "cell", ((F.col("n") >= min_pts) | F.coalesce("enough", F.lit(False))).alias("is_core"))


def core_points(points: DataFrame, eps: float, min_pts: int, d: int | None = None) -> DataFrame:
    """id, x*, cell, is_core for every point (up to three dimensions)."""
    grid = Grid(points, eps, d or dimension(points))
    return _flagged(grid, _neighbours(grid, min_pts), min_pts)


def _between_parts(grid: Grid, apart: DataFrame) -> DataFrame:
    """(u, v): those pairs of dense cells (cell, other) that have points within eps, found over their parts."""
    d, eps, xs = grid.d, grid.eps, _columns("x", grid.d)
    box = [f"{k}{i}" for i in range(d) for k in ("low", "high")]
    own = grid.cells.select("cell", "n", *box)
    theirs = grid.cells.select(F.col("cell").alias("other"), F.col("n").alias("m"), *(F.col(b).alias(f"_{b}") for b in box))
    pairs = cut(apart.select("cell", "other").join(own, "cell").join(theirs, "other"))

    def parts(side: str, n: str, mine: str, far: str) -> DataFrame:
        """Points of one side that are in reach of the other's box, with their part of the cell."""
        reach = F.lit(0.0)
        for i in range(d):
            gap = side_distance(F.col(f"x{i}"), F.col(f"{far}low{i}"), F.col(f"{far}high{i}"))
            reach = reach + gap * gap
        steps = F.ceil(F.pow(F.col(n) / PART_POINTS, 1 / d))
        place = [F.floor((F.col(f"x{i}") - F.col(f"{mine}low{i}")) / (F.col(f"{mine}high{i}") - F.col(f"{mine}low{i}") + F.lit(1e-300)) * steps * MARGIN).cast("long").alias(f"p{i}") for i in range(d)]
        points = grid.placed.select(F.col("cell").alias(side), *xs)
        return pairs.join(points, side).where(reach * (1 - 1e-9) <= F.lit(eps * eps)).select("cell", "other", *xs, *place)

    left, right = parts("cell", "n", "", "_"), parts("other", "m", "_", "")
    keys = ["cell", "other", *_columns("p", d)]
    boxes = [p.groupBy(*keys).agg(*_box(d)) for p in (left, right)]
    far = boxes[1].select("cell", "other", *(F.col(f"p{i}").alias(f"q{i}") for i in range(d)), *(F.col(b).alias(f"_{b}") for b in box))
    met = cut(boxes[0].join(far, ["cell", "other"]).where(_gap(d) <= F.lit(eps * eps)).select(*keys, *_columns("q", d), (_span(d) <= F.lit(eps * eps)).alias("sure")))
    sure = met.where("sure").select("cell", "other").distinct()
    open_ = met.join(sure, ["cell", "other"], "left_anti").drop("sure")
    other = right.select("cell", "other", *(F.col(f"p{i}").alias(f"q{i}") for i in range(d)), *(F.col(f"x{i}").alias(f"y{i}") for i in range(d)))
    found = open_.join(left, keys).join(other, ["cell", "other", *_columns("q", d)]).where(_within(eps, d)).select("cell", "other").distinct()
    return sure.union(found).toDF("u", "v")


def _clusters(grid: Grid, pairs: DataFrame, flagged: DataFrame, min_pts: int) -> DataFrame:
    """(cell, cluster_id) of the cells with core points."""
    d, xs = grid.d, _columns("x", grid.d)
    core = flagged.where("is_core").select("id", "cell")
    linked = pairs.where("cell <> other").join(core.select("id"), "id").join(core.select(F.col("id").alias("oid")), "oid").select(F.col("cell").alias("u"), F.col("other").alias("v"))
    dense = grid.near.where((F.col("n") >= min_pts) & (F.col("m") >= min_pts) & (F.col("cell") < F.col("other")))
    sure = dense.where("inside").select(F.col("cell").alias("u"), F.col("other").alias("v"))
    maybe = dense.where("not inside").select("cell", "other")
    outer = [f(F.struct(*xs), x) for x in xs for f in (F.min_by, F.max_by)]
    tips = grid.placed.where(F.col("n") >= min_pts).groupBy("cell").agg(F.array_distinct(F.array(*outer)).alias("p")).select("cell", F.explode("p").alias("p")).select(F.lit(0).alias("id"), "cell", *(F.col(f"p.{x}").alias(x) for x in xs))
    touched = maybe.join(tips, "cell").join(grid.other(tips), "other").where(_within(grid.eps, d)).select("cell", "other")
    edges = saved(linked.union(sure).union(touched).distinct())
    joined = connected_components(edges, kept=True)
    one, two = joined.select(F.col("vertex").alias("cell"), F.col("component").alias("a")), joined.select(F.col("vertex").alias("other"), F.col("component").alias("b"))
    apart = saved(maybe.join(one, "cell", "left").join(two, "other", "left").where(F.coalesce("a", "cell") != F.coalesce("b", "other")).select("cell", "other"))
    if not apart.isEmpty():
        joined = connected_components(edges.union(_between_parts(grid, apart)))
    least = core.groupBy("cell").agg(F.min("id").alias("least"))
    named = least.join(joined, least["cell"] == joined["vertex"], "left").select("cell", "least", F.coalesce("component", "cell").alias("component"))
    return named.join(named.groupBy("component").agg(F.min("least").alias("cluster_id")), "component").select("cell", "cluster_id")


def dbscan(points: DataFrame, eps: float, min_pts: int, d: int | None = None) -> DataFrame:
    """id, kind (core, border, noise), cluster_id of every point; empty in, empty out. Beyond three dimensions see voronoi.dbscan()."""
    d = d or dimension(points)
    if d > GRID_DIMENSIONS:
        raise ValueError(f"{d} dimensions: use halocline.operators.voronoi.dbscan")
    grid = Grid(points, eps, d)
    pairs = _neighbours(grid, min_pts)
    flagged = saved(_flagged(grid, pairs, min_pts).select("id", "cell", "is_core"))
    clusters = saved(_clusters(grid, pairs, flagged, min_pts))
    core = flagged.where("is_core").select("id", "cell").join(clusters, "cell").select("id", "cluster_id")
    others = flagged.where("not is_core").select("id")
    reached = pairs.join(others, "id").join(core.withColumnRenamed("id", "oid"), "oid").groupBy("id").agg(F.min("cluster_id").alias("cluster_id"))
    rest = others.join(reached, "id", "left").select("id", F.when(F.col("cluster_id").isNull(), NOISE).otherwise(BORDER).alias("kind"), F.coalesce("cluster_id", F.lit(-1).cast("long")).alias("cluster_id"))
    return core.select("id", F.lit(CORE).alias("kind"), "cluster_id").union(rest)


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """cluster_id, n_core, n_border of each cluster."""
    return labels.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count_if(F.col("kind") == CORE).alias("n_core"), F.count_if(F.col("kind") == BORDER).alias("n_border"))


def n_clusters(labels: DataFrame) -> int:
    return labels.where(F.col("kind") == CORE).select("cluster_id").distinct().count()


def members(labels: DataFrame, kind: str) -> DataFrame:
    """(cluster_id, ids): the core or border points of each cluster."""
    return labels.where(F.col("kind") == kind).groupBy("cluster_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
