"""The whole job: read, choose centres, cluster, write labels, report."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.operators import sampling, voronoi
from halocline.operators.dbscan import dbscan
from halocline.operators.pairs import GRID_DIMENSIONS
from halocline.operators.points import dimension
from halocline.session import cut
from halocline.sources import csv

SAMPLERS = ("kmeans", "grid", "random")
#: All implementations give the same labels; ``standard`` and the grid ones use the grid plan where the dimension allows.
IMPLEMENTATIONS = ("grid", "grid-seq", "grid-par", "grid-actor", "standard", "voronoi")


@dataclass(frozen=True)
class Configuration:
    """What a run is asked for. ``cells`` and ``factor`` shape the Voronoi plan; a negative seed is none."""

    epsilon: float
    min_pts: int
    cells: int = 16
    factor: float = 2.0
    input: str | None = None
    header: bool = True
    batch: int = 10_000
    workers: int = 1
    sink: str = "ignored"
    metrics: str | None = None
    sampler: str = "kmeans"
    implementation: str = "grid"
    seed: int = -1

    def __post_init__(self):
        if self.epsilon <= 0 or self.min_pts < 1 or self.cells < 1:
            raise ValueError("epsilon, min_pts and cells must be positive")
        if self.sampler not in SAMPLERS or self.implementation not in IMPLEMENTATIONS:
            raise ValueError(f"sampler is one of {SAMPLERS}, implementation one of {IMPLEMENTATIONS}")


def choose_centers(points: DataFrame, d: int, config: Configuration) -> DataFrame:
    seed = max(config.seed, 0)
    if config.sampler == "random":
        return sampling.random_centers(points, d, config.cells, config.epsilon, config.factor, config.workers, seed)
    if config.sampler == "grid":
        box = [(r["low"], r["high"]) for r in sampling.bounding_box(points, d).orderBy("axis").collect()]
        return sampling.lattice(points.sparkSession, box, config.cells)[0]
    return sampling.kmeans_centers(points, d, config.cells, seed)


def labels(points: DataFrame, config: Configuration, d: int | None = None) -> DataFrame:
    """id, kind, cluster_id of every point."""
    d = d or dimension(points)
    if points.isEmpty():
        return points.select("id", F.lit("noise").alias("kind"), F.lit(-1).cast("long").alias("cluster_id"))
    if config.implementation != "voronoi" and d <= GRID_DIMENSIONS:
        return dbscan(points, config.epsilon, config.min_pts, d)
    return voronoi.dbscan(points, cut(choose_centers(points, d, config)), config.epsilon, config.min_pts)


def fit_transform(spark: SparkSession, x: np.ndarray | list, config: Configuration) -> list[int]:
    """The label of each row of ``x``, in order; -1 is noise. Labels are smallest core row numbers."""
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    return csv.write_labels(labels(spark.createDataFrame(rows, "id long, v array<double>"), config), "memory") if rows else []


def statistics(points: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row: n_points, n_core, n_border, n_noise, n_clusters."""
    kinds = labelled.agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("core", "border", "noise")), F.count_distinct(F.when(F.col("kind") == "core", F.col("cluster_id"))).alias("n_clusters"))
    return points.agg(F.count("*").alias("n_points")).join(F.broadcast(kinds))


def measurement(config: Configuration, dataset: str, ms: int, more: dict) -> dict:
    return {"algo": config.implementation, "algoTimeMs": ms, "clusterParameters": {"eps": config.epsilon, "minPts": config.min_pts}, "datasetParameters": {"datasetName": dataset}, "additionalMetrics": more}


def write_metrics(folder: str, record: dict) -> Path:
    """``folder``/dataset/algo/eps_minPts/metrics.json on the driver."""
    p = record["clusterParameters"]
    at = Path(folder) / record["datasetParameters"]["datasetName"] / record["algo"] / f"{p['eps']}_{p['minPts']}" / "metrics.json"
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(record, indent=2))
    return at


def run(spark: SparkSession, config: Configuration) -> list[int] | None:
    """Read ``config.input``, cluster, write to the sink, and report."""
    began = time.time()
    points = csv.read_points(spark, config.input, config.header)
    found = cut(labels(points, config))
    out = csv.write_labels(found, config.sink, config.input)
    if config.metrics:
        counts = statistics(points, found).first().asDict()
        write_metrics(config.metrics, measurement(config, Path(config.input).stem, int(1000 * (time.time() - began)), counts | {"configuration": asdict(config)}))
    return out
