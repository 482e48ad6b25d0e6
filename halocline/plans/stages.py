"""What each stage of the Voronoi plan takes and sends."""

from __future__ import annotations

import csv
import time
from dataclasses import astuple, dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.operators import voronoi
from halocline.session import cut


@dataclass(frozen=True)
class Stage:
    """``points`` that a stage handles or copies, ``edges`` that it finds or passes on, and its wall milliseconds.

    partitioning: all points, cells; extension: copies in margins, pairs of cells
    that share points; clustering: core points, local clusters; merging: core
    points in several cells, merges; labelling: points of clusters, clusters.
    """

    stage: str
    points: int
    edges: int
    ms: int


def staged_dbscan(points: DataFrame, centers: DataFrame, eps: float, min_pts: int) -> tuple[DataFrame, list[Stage]]:
    """(labels as of voronoi.dbscan(), the stages in order)."""
    stages: list[Stage] = []
    began = time.perf_counter()

    def done(name: str, n: int, m: int) -> None:
        nonlocal began
        now = time.perf_counter()
        stages.append(Stage(name, n, m, round(1000 * (now - began))))
        began = now

    done("partitioning", points.count(), centers.count())
    held = cut(voronoi.memberships(points, centers, eps))
    border = voronoi.shared_border(held)
    done("extension", held.where("not owned").count(), border.select("left", "right").distinct().count())
    flags = cut(voronoi.core_flags(held, eps, min_pts))
    local = cut(voronoi.local_clusters(held, flags, eps))
    done("clustering", flags.where("is_core").count(), local.where("is_core").select("cell", "local_label").distinct().count())
    shared = local.where("is_core").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    done("merging", shared.count(), voronoi.pairwise_merges(local).count())
    labels = cut(voronoi.named(flags, local.where("owned or is_core")))
    found = labels.where("cluster_id >= 0")
    done("labelling", found.count(), found.select("cluster_id").distinct().count())
    return labels, stages


def write_stages(folder: str, stages: list[Stage]) -> list[Path]:
    """A CSV with a header for each stage, on the driver."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    names, paths = [f.name for f in fields(Stage)], []
    for s in stages:
        paths.append(Path(folder) / f"{s.stage}.csv")
        with paths[-1].open("w", newline="") as out:
            csv.writer(out).writerows([names, astuple(s)])
    return paths
