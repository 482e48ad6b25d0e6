"""Cell centres: samples, lattices, k-means, farthest points, contraction.

Centre sets are small by contract (pairs.FEW); what scans the data does so in
DataFrame aggregates.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocline.functions.vectors import distance_squared
from halocline.operators.components import union_find
from halocline.operators.pairs import FEW, nearest
from halocline.session import cut

CENTERS = T.StructType([T.StructField("cell", T.IntegerType(), False), T.StructField("center", T.ArrayType(T.DoubleType(), False), False)])


def centers(spark: SparkSession, rows: list | np.ndarray) -> DataFrame:
    """(cell, center) numbered from 0; equal rows once."""
    seen = dict.fromkeys(tuple(float(x) for x in r) for r in rows)
    return spark.createDataFrame([(i, list(r)) for i, r in enumerate(seen)], CENTERS)


def _bounded(df: DataFrame) -> np.ndarray:
    rows = df.select("v").limit(FEW + 1).collect()
    if len(rows) > FEW:
        raise ValueError(f"more than {FEW} rows: sample first")
    return np.array([r[0] for r in rows], float)


def hash_sample(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n distinct ids, the same for the same seed: the first by MD5 of seed and id. A top-n, cut inside partitions first."""
    return points.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(n)


def line_sample(points: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """About n rows with replacement."""
    total = points.count()
    return points.sample(True, min(1.0, n / total) if n <= total else n / total, seed) if total else points


def bounding_box(points: DataFrame, d: int) -> DataFrame:
    """(axis, low, high) of each axis."""
    ends = points.agg(*(f(F.col("v")[i]).alias(f"{k}{i}") for i in range(d) for k, f in (("low", F.min), ("high", F.max))))
    return ends.select(F.explode(F.array(*(F.struct(F.lit(i).alias("axis"), F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high")) for i in range(d)))).alias("e")).select("e.*")


def lattice_counts(spans: list[float], n: int) -> list[int]:
    """How many lattice points each axis gets for about n in all: in proportion to the spans, then one step at a time towards n (which may be overshot)."""
    volume = math.prod(spans)
    if volume <= 0:
        raise ValueError("the bounding box has no volume")
    density = (n / volume) ** (1 / len(spans))
    counts = [min(max(1, math.floor(s * density + 0.5)), n) for s in spans]
    while math.prod(counts) > n and max(counts) > 1:
        counts[counts.index(max(counts))] -= 1
    while (now := math.prod(counts)) < n:
        best = min(range(len(counts)), key=lambda i: abs(now // counts[i] * (counts[i] + 1) - n))
        if counts[best] >= n:
            break
        counts[best] += 1
    return counts


def lattice(spark: SparkSession, box: list[tuple[float, float]], n: int) -> tuple[DataFrame, list[int]]:
    """Row-major lattice centres over a box, both ends included; and the counts of the axes."""
    counts = lattice_counts([high - low for low, high in box], n)
    axes = [[low] if k == 1 else [low + i * ((high - low) / (k - 1)) for i in range(k)] for (low, high), k in zip(box, counts)]
    return centers(spark, list(product(*axes))), counts


def lattice_edges(spark: SparkSession, counts: list[int]) -> DataFrame:
    """(u, v), u < v: row-major lattice cells one step apart along one axis."""
    cells_ = spark.range(math.prod(counts)).select(F.col("id").cast("int").alias("u"))
    steps, stride = [], 1
    for k in reversed(counts):
        place = F.expr(f"(u div {stride}) % {k}")
        steps.append(F.when(place + 1 < k, (F.col("u") + stride).cast("int")))
        stride *= k
    return cells_.select("u", F.explode(F.array_compact(F.array(*steps))).alias("v"))


def plus_plus(rows: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """k-means++ seeds of a bounded sample."""
    if k > len(rows):
        raise ValueError("more clusters than points")
    rng = np.random.default_rng(seed)
    chosen = [rows[rng.integers(len(rows))]]
    d2 = ((rows - chosen[0]) ** 2).sum(1)
    for _ in range(k - 1):
        at = rng.choice(len(rows), p=d2 / d2.sum()) if d2.sum() > 0 else int(rng.integers(len(rows)))
        chosen.append(rows[at])
        d2 = np.minimum(d2, ((rows - rows[at]) ** 2).sum(1))
    return np.array(chosen)


def kmeans(points: DataFrame, start: DataFrame, d: int, iterations: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """Centres (cell, center) after Lloyd's iterations from ``start``; an empty cluster stays where it was. Each round is one aggregate over the data."""
    spark, now = points.sparkSession, start
    for _ in range(iterations):
        means = nearest(points, now).groupBy("cell").agg(*(F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(d)))
        moved = {r["cell"]: [r[f"m{i}"] for i in range(d)] for r in means.collect()}
        before = {r["cell"]: list(r["center"]) for r in now.collect()}
        after = {c: moved.get(c, v) for c, v in before.items()}
        now = spark.createDataFrame(sorted(after.items()), CENTERS)
        if all(sum((a - b) ** 2 for a, b in zip(after[c], before[c])) < tolerance for c in after):
            break
    return now


def kmeans_centers(points: DataFrame, d: int, n: int, seed: int = 42, iterations: int = 20) -> DataFrame:
    """Centres fitted on a hash sample of 500 rows a centre, from k-means++ seeds of FEW of them at most."""
    sample = cut(hash_sample(points, 500 * n, seed))
    rows = _bounded(hash_sample(sample, FEW, seed))
    return kmeans(sample, centers(points.sparkSession, plus_plus(rows, min(n, len(rows)), seed)), d, iterations)


def farthest_points(sample: DataFrame, n: int, first: int = 0, least: float | None = None) -> list[tuple[int, float]]:
    """(row, distance to those before): greedy max-min seeds of a bounded set in the order of ids, ties to the first; fails below ``least`` if given."""
    rows = _bounded(sample.orderBy("id"))
    if n > len(rows):
        raise ValueError("more seeds than points")
    chosen, gap = [(first, math.inf)], np.sqrt(((rows - rows[first]) ** 2).sum(1))
    while len(chosen) < n:
        at = int(gap.argmax())
        if least is not None and gap[at] < least:
            raise ValueError(f"no point is {least} away from the others")
        chosen.append((at, float(gap[at])))
        gap = np.minimum(gap, np.sqrt(((rows - rows[at]) ** 2).sum(1)))
    return chosen


def farthest_seeds(points: DataFrame, n: int) -> list[tuple[int, float | None]]:
    """(id, distance to those before): greedy max-min seeds of a table of any size from its smallest id on, ties to the smaller id; one aggregate a seed."""
    if points.limit(n).count() < n:
        raise ValueError("more seeds than points")
    first = points.agg(F.min_by(F.struct("id", "v"), "id").alias("s")).first()["s"]
    chosen, at = [(first["id"], None)], [first["v"]]
    while len(chosen) < n:
        seeds = [F.array(*(F.lit(float(x)) for x in v)) for v in at]
        gap = F.sqrt(F.least(*(distance_squared(F.col("v"), s) for s in seeds))) if len(seeds) > 1 else F.sqrt(distance_squared(F.col("v"), seeds[0]))
        best = points.select("id", "v", gap.alias("gap")).agg(F.max_by(F.struct("id", "v", "gap"), F.struct("gap", -F.col("id"))).alias("s")).first()["s"]
        chosen.append((best["id"], best["gap"]))
        at.append(best["v"])
    return chosen


def contract(centers_: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(cell, center, merged): centres joined along edges shorter than ``threshold`` (transitively) become their mean; cells are renumbered by smallest member."""
    from halocline.operators.delaunay import collected

    rows = {r["cell"]: r["center"] for r in sorted(collected(centers_, FEW, "centres"), key=lambda r: r["cell"])}
    at = centers_.select("cell", "center")
    ends = edges.join(at.toDF("u", "a"), "u").join(at.toDF("v", "b"), "v")
    short = [(r["u"], r["v"]) for r in collected(ends.where(distance_squared(F.col("a"), F.col("b")) < threshold * threshold).select("u", "v"), FEW * 100, "edges")]
    root = {c: c for c in rows} | union_find(short)
    groups: dict[int, list[int]] = {}
    for c in rows:
        groups.setdefault(root[c], []).append(c)
    made = [(i, [sum(rows[c][k] for c in groups[g]) / len(groups[g]) for k in range(len(rows[g]))], len(groups[g])) for i, g in enumerate(sorted(groups))]
    return centers_.sparkSession.createDataFrame(made, T.StructType([*CENTERS.fields, T.StructField("merged", T.IntegerType(), False)]))


def random_centers(points: DataFrame, d: int, n: int, eps: float, factor: float, workers: int = 1, seed: int = 42) -> DataFrame:
    """Hash-sampled centres, contracted until they are ``factor * eps`` apart; the largest of ten sets, then up to five relaxations by 5 % (not below 2 eps)."""
    from halocline.operators.delaunay import edges as adjacent

    n, threshold, best = max(n, workers, d + 1), factor * eps, None
    for attempt in range(15):
        if attempt >= 10:
            threshold = max(2 * eps, 0.95 * threshold)
        got = contract(c := centers(points.sparkSession, _bounded(hash_sample(points, n, seed + attempt))), adjacent(c, d), threshold).select("cell", "center")
        if best is None or got.count() > best.count():
            best = got
        if best.count() >= n:
            break
    if best is None or best.count() < min(n, d + 1):
        raise ValueError("too few centres that far apart")
    return best
