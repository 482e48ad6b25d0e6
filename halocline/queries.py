"""The registered queries: each operator over a whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.functions import metrics
from halocline.functions import vectors as V
from halocline.operators import components, delaunay, pairs, sampling, voronoi
from halocline.operators import dbscan as D
from halocline.operators.maintenance import NeighborTable, PointSet
from halocline.operators.points import from_array, points
from halocline.plans.clustering import statistics
from halocline.plans.stages import staged_dbscan
from halocline.session import cut, scratch, table
from halocline.sources import csv
from halocline.streaming.components import StreamingComponents

EPS2, EPS3, MIN_PTS = 0.015, 0.05, 5
#: Cells of the Voronoi queries, and centres of the adjacency ones.
N_CELLS, N_PLANE = 8, 128


def emb(spark: SparkSession, sf: str, d: int | None) -> DataFrame:
    return from_array(table(spark, sf, "embeddings"), "vec_id", "embedding", d)


def customer(spark: SparkSession, sf: str) -> DataFrame:
    return points(table(spark, sf, "customer"), "c_custkey", ["c_nationkey", F.col("c_acctbal").cast("double") / 100])


def part(spark: SparkSession, sf: str) -> DataFrame:
    return points(table(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"])


def clicks(spark: SparkSession, sf: str) -> DataFrame:
    return points(table(spark, sf, "events").where("event_type = 'click'"), "event_id", ["user_id", "value"])


def first_centers(spark: SparkSession, sf: str, n: int = N_CELLS, d: int = 2) -> DataFrame:
    """The n points with the smallest ids as centres."""
    return emb(spark, sf, d).where(F.col("id") < n).select(F.col("id").cast("int").alias("cell"), F.col("v").alias("center"))


def _r(c: Column | str, name: str, digits: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(name)


def eps_pairs_emb2d(spark, sf):
    return pairs.eps_pairs(emb(spark, sf, 2), EPS2, 2).select("a", "b", _r("d2", "d2", 12))


def range_count_part(spark, sf):
    return pairs.range_count(part(spark, sf), 1.505, 2)


def range_query_fixed_point(spark, sf):
    queries = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.1, -0.1])], "id long, v array<double>")
    return pairs.range_query(emb(spark, sf, 2), queries, 0.05, 2).select("query", "id", _r("d2", "d2", 12))


def has_neighbor_semi(spark, sf):
    """Which points have one of the labelled kind 0 in reach."""
    zero = from_array(table(spark, sf, "embeddings").where("label = 0"), "vec_id", "embedding", 2)
    return pairs.has_neighbor(emb(spark, sf, 2), zero, EPS2, 2)


def knn_k3(spark, sf):
    every = emb(spark, sf, None)
    return pairs.knn(every, every.where("id % 20 = 0"), 3).select("query", F.col("rank").cast("long").alias("rank"), "id", _r("d2", "d2"))


def grid_cells(spark, sf):
    placed = D.celled(emb(spark, sf, 2), EPS3, 2)
    return placed.groupBy("c0", "c1").agg(F.count("*").alias("n"))


def neighbor_cells(spark, sf):
    """How many points lie in the cells around each occupied cell, its own included."""
    own = grid_cells(spark, sf)
    other = own.select(F.col("c0").alias("_c0"), F.col("c1").alias("_c1"), F.col("n").alias("m"))
    around = pairs.surrounded(own.withColumnsRenamed({"n": "own"}).withColumns({"a0": F.col("c0"), "a1": F.col("c1")}), 2, D.REACH)
    return around.join(other, (F.col("c0") == F.col("_c0")) & (F.col("c1") == F.col("_c1"))).groupBy(F.col("a0").alias("c0"), F.col("a1").alias("c1")).agg(F.sum("m").alias("n_around"))


def vector_ops(spark, sf):
    """Each reducing vector function of an embedding and its reverse."""
    rows = emb(spark, sf, None).withColumn("w", F.reverse("v"))
    a, b = F.col("v"), F.col("w")
    return rows.select("id", _r(V.vec_dot(a, b), "dot"), _r(V.distance(a, b), "distance"), _r(V.distance_squared(a, b), "distance_squared"), _r(V.norm(a), "norm"), _r(V.norm_squared(a), "norm_squared"), _r(V.vec_sum(a), "total"), _r(V.vec_mean(a), "mean"), V.is_same(a, b).alias("same"))


def vector_elements(spark, sf):
    """Each element-wise vector function, one row an element."""
    rows = emb(spark, sf, None).withColumn("w", F.reverse("v"))
    a, b = F.col("v"), F.col("w")
    made = {"added": V.vec_add(a, b), "less": V.vec_sub(a, b), "product": V.vec_mul(a, b), "scaled": V.vec_scale(a, 2.5), "divided": V.vec_div(a, 4), "unit": V.normalize(a), "minmax": V.min_max_scale(a), "standard": V.standardize(a)}
    wide = rows.select("id", *(v.alias(k) for k, v in made.items()))
    opened = wide.select("id", F.posexplode(F.arrays_zip(*made)).alias("axis", "e"))
    return opened.select("id", F.col("axis").cast("long").alias("axis"), *(_r(f"e.{k}", k) for k in made))


def distances_to_first(spark, sf):
    """Every row's distance to each of 20 stated query points, which are one broadcast block."""
    every = emb(spark, sf, None)
    asked = every.where("id < 20").select(F.col("id").alias("query"), F.col("v").alias("w"))
    return every.join(F.broadcast(asked)).select("query", "id", _r(V.distance(F.col("w"), F.col("v")), "distance"))


def core_flags_emb2d(spark, sf):
    return D.core_points(emb(spark, sf, 2), EPS2, MIN_PTS, 2).select("id", "is_core")


def dbscan_emb2d(spark, sf):
    return D.dbscan(emb(spark, sf, 2), EPS2, MIN_PTS, 2)


def dbscan_emb3d(spark, sf):
    return D.dbscan(emb(spark, sf, 3), EPS3, MIN_PTS, 3)


def dbscan_customer(spark, sf):
    return D.dbscan(customer(spark, sf), 1.2, MIN_PTS, 2)


def dbscan_part(spark, sf):
    return D.dbscan(part(spark, sf), 1.505, MIN_PTS, 2)


def dbscan_events(spark, sf):
    return D.dbscan(clicks(spark, sf), 2.035, 8, 2)


def dbscan_emb64(spark, sf):
    return voronoi.dbscan(emb(spark, sf, None), first_centers(spark, sf, 2, 64), 1.15, 4)


def dbscan_voronoi_emb2d(spark, sf):
    return voronoi.dbscan(emb(spark, sf, 2), first_centers(spark, sf), EPS2, MIN_PTS)


def cluster_sizes(spark, sf):
    return D.cluster_sizes(dbscan_emb2d(spark, sf))


def noise_points(spark, sf):
    return dbscan_emb2d(spark, sf).where("kind = 'noise'").select("id")


def cluster_members(spark, sf):
    """The core points of each cluster as a list; and the border points."""
    found = cut(dbscan_emb2d(spark, sf))
    listed = lambda kind: D.members(found, kind).select("cluster_id", F.lit(kind).alias("kind"), F.array_join("ids", ",").alias("ids"))
    return listed("core").union(listed("border"))


def run_statistics(spark, sf):
    return statistics(emb(spark, sf, 2), dbscan_emb2d(spark, sf))


def connected_components_edges(spark, sf):
    return components.connected_components(pairs.eps_pairs(emb(spark, sf, 2), EPS2, 2), "a", "b")


def connected_components_stars(spark, sf):
    """The same without the driver's part."""
    return components.connected_components(pairs.eps_pairs(emb(spark, sf, 2), EPS2, 2), "a", "b", few=0)


def streaming_components(spark, sf):
    """Edges in four batches, merged one after the other."""
    edges = cut(pairs.eps_pairs(emb(spark, sf, 2), EPS2, 2).select(F.col("a").alias("u"), F.col("b").alias("v")))
    table_ = StreamingComponents(spark, f"{scratch(spark)}/components-{uuid.uuid4().hex}")
    for k in range(4):
        table_.merge(edges.where((F.col("u") + F.col("v")) % 4 == k), k)
    return table_.current()


def voronoi_assign(spark, sf):
    return voronoi.owned(emb(spark, sf, 2), first_centers(spark, sf)).select("id", "cell", _r("d2", "d2", 12))


def margin_replicas(spark, sf):
    return voronoi.memberships(emb(spark, sf, 2), first_centers(spark, sf), EPS2).select("cell", "id", "owned")


def interior_points(spark, sf):
    return voronoi.interior(emb(spark, sf, 2), first_centers(spark, sf), EPS2)


def shared_border(spark, sf):
    return voronoi.shared_border(voronoi.memberships(emb(spark, sf, 2), first_centers(spark, sf), EPS2))


def cell_stats(spark, sf):
    return voronoi.cell_stats(voronoi.memberships(emb(spark, sf, 2), first_centers(spark, sf), EPS2))


def _local(spark, sf):
    held = cut(voronoi.memberships(emb(spark, sf, 2), first_centers(spark, sf), EPS2))
    return cut(voronoi.local_clusters(held, voronoi.core_flags(held, EPS2, MIN_PTS), EPS2))


def local_clusters(spark, sf):
    """Local clusters of each cell with their sizes."""
    return _local(spark, sf).where("is_core").groupBy("cell", "local_label").agg(F.count("*").alias("n_core"))


def pairwise_merges(spark, sf):
    return voronoi.pairwise_merges(_local(spark, sf))


def cluster_map(spark, sf):
    return voronoi.cluster_map(_local(spark, sf))


def bounding_box(spark, sf):
    return sampling.bounding_box(customer(spark, sf), 2)


def _lattice(spark, sf):
    box = [(r["low"], r["high"]) for r in bounding_box(spark, sf).orderBy("axis").collect()]
    return sampling.lattice(spark, box, 20)


def lattice_centers(spark, sf):
    return _lattice(spark, sf)[0].select(F.col("cell").cast("long").alias("cell"), _r(F.col("center")[0], "x", 6), _r(F.col("center")[1], "y", 6))


def lattice_edges(spark, sf):
    return sampling.lattice_edges(spark, _lattice(spark, sf)[1])


def hash_sample(spark, sf):
    return sampling.hash_sample(customer(spark, sf), 50, 7).select("id")


def kmeans_fixed_iters(spark, sf):
    got = sampling.kmeans(emb(spark, sf, 2), first_centers(spark, sf, 4), 2, 3, 0.0)
    return got.select(F.col("cell").cast("long").alias("cell"), _r(F.col("center")[0], "x"), _r(F.col("center")[1], "y"))


def farthest_point_seeds(spark, sf):
    """The seeds of the whole table."""
    rows = sampling.farthest_seeds(emb(spark, sf, 2), 6)
    return spark.createDataFrame([(i, r, g if g is None else round(g, 9)) for i, (r, g) in enumerate(rows)], "step long, id long, gap double")


def line_sample(spark, sf):
    """Rows drawn with replacement: how many there are, and whether all are rows of the table."""
    every = customer(spark, sf)
    drawn = sampling.line_sample(every, 500, 3)
    return drawn.join(every.select("id"), "id", "left_semi").agg((F.count("*").between(300, 700)).alias("about_as_many"), F.count_if(F.col("id").isNull()).alias("strange"))


def _sampled(spark, centers, every, n, least):
    """One row: how many centres, whether they lie in the points' box, and whether they are ``least`` apart."""
    far = centers.toDF("other", "b")
    gap = centers.join(far, F.col("cell") < F.col("other")).agg(F.min(V.distance(F.col("center"), F.col("b"))).alias("gap"))
    d = len(centers.first()["center"])
    box = {r["axis"]: r for r in sampling.bounding_box(every, d).collect()}
    inside = F.lit(True)
    for i in range(d):
        inside = inside & F.col("center")[i].between(box[i]["low"], box[i]["high"])
    return centers.agg((F.count("*") >= n).alias("enough"), F.bool_and(inside).alias("inside")).join(F.broadcast(gap)).select("enough", "inside", (F.col("gap") >= least).alias("apart"))


def random_sampler(spark, sf):
    """128 centres of three-dimensional points, at least two radii apart."""
    every = emb(spark, sf, 3)
    return _sampled(spark, sampling.random_centers(every, 3, 128, 0.005, 3.0), every, 100, 0.01)


def kmeans_sampler(spark, sf):
    every = emb(spark, sf, 3)
    return _sampled(spark, sampling.kmeans_centers(every, 3, 16, 42, 3), every, 16, 0.0)


def contract_close_cells(spark, sf):
    centers = first_centers(spark, sf, N_PLANE)
    return sampling.contract(centers, delaunay.edges(centers, 2), 0.02).select(F.col("cell").cast("long").alias("cell"), _r(F.col("center")[0], "x"), _r(F.col("center")[1], "y"), "merged")


def delaunay2d_edges(spark, sf):
    return delaunay.edges(first_centers(spark, sf, N_PLANE), 2)


def csr_rows(spark, sf):
    got = delaunay.csr(delaunay2d_edges(spark, sf))
    return got.select("u", "start", "end", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


def round_robin_placement(spark, sf):
    return delaunay.place(delaunay2d_edges(spark, sf), 3, "round_robin")


def balanced_placement(spark, sf):
    """Whether the balanced placement has all cells, keeps to its bound, and cuts no more than half the edges that round robin does."""
    edges = cut(delaunay2d_edges(spark, sf))
    placed = cut(delaunay.place(edges, 3))
    cuts = [delaunay.edge_cut(edges, p) for p in (placed, delaunay.place(edges, 3, "round_robin"))]
    load = placed.groupBy("worker").agg(F.count("*").alias("n"))
    return load.agg(F.sum("n").alias("cells"), F.count("*").alias("workers"), (F.max("n") <= F.floor((1 + delaunay.IMBALANCE) * F.ceil(F.sum("n") / 3))).alias("balanced")).withColumn("few_cut", F.lit(2 * cuts[0] <= cuts[1]))


def merge_task_placement(spark, sf):
    """Merge tasks of cells that are placed round robin."""
    edges = delaunay2d_edges(spark, sf)
    return delaunay.merge_tasks(edges, delaunay.place(edges, 3, "round_robin"))


def delaunay3d_edges(spark, sf):
    return delaunay.edges(first_centers(spark, sf, 40, 3), 3)


def voronoi_faces(spark, sf):
    """Each cell's half-spaces, with the offsets moved out and in."""
    centers = first_centers(spark, sf, N_PLANE)
    got = voronoi.faces(centers, delaunay.edges(centers, 2), EPS2)
    return got.select("cell", "neighbor", _r(F.col("normal")[0], "x"), _r(F.col("normal")[1], "y"), *(_r(c, c) for c in ("offset", "extended", "shrunk")))


def point_set_maintenance(spark, sf):
    """Inserted in two batches, every seventh deleted, every 21st inserted again: how many are in reach of each."""
    every, points_ = emb(spark, sf, 2), PointSet(spark, f"{scratch(spark)}/points-{uuid.uuid4().hex}")
    points_.insert(every.where("id % 2 = 0"))
    points_.insert(every.where("id % 2 = 1"))
    points_.delete(every.where("id % 7 = 0"))
    points_.insert(every.where("id % 21 = 0"))
    return pairs.range_count(points_.compact().current(), EPS2, 2)


def neighbor_table(spark, sf):
    """Neighbours of each point, counted at two radii of one kept table, and the nearest one."""
    kept = NeighborTable(emb(spark, sf, 2), EPS2, 2)
    half = kept.count(EPS2 / 2).withColumnRenamed("n", "n_half")
    return kept.count(EPS2).join(half, "id").join(kept.nearest(EPS2).select("id", F.col("other").alias("nearest")), "id", "left")


def stage_statistics(spark, sf):
    """Points and edges of each stage of the Voronoi plan."""
    _, stages = staged_dbscan(emb(spark, sf, 2), first_centers(spark, sf), EPS2, MIN_PTS)
    return spark.createDataFrame([(x.stage, x.points, x.edges) for x in stages], "stage string, points long, edges long")


def vector_hashes(spark, sf):
    """Equal vectors have equal hashes: groups of the hash, of vectors and their copies."""
    rows = emb(spark, sf, None)
    return rows.union(rows).groupBy(V.vec_hash(F.col("v")).alias("h")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("vectors"), F.count_if(F.col("n") % 2 == 1).alias("odd"))


def entropy_labels(spark, sf):
    return metrics.entropy(table(spark, sf, "embeddings"), "label").select(_r("entropy", "entropy"))


def nmi_clusters(spark, sf):
    """Agreement of the clusters with the labels of the table."""
    found = dbscan_emb3d(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    return metrics.agreement(found, "cluster_id", "label").select(*(_r(c, c) for c in ("mutual_information", "entropy_a", "entropy_b", "nmi")))


def csv_roundtrip(spark, sf):
    path = f"{scratch(spark)}/points-{uuid.uuid4().hex}"
    csv.write_points(part(spark, sf), path, 2)
    return csv.read_points(spark, path).select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


def fixed_width_labels(spark, sf):
    return csv.fixed_width(dbscan_emb2d(spark, sf))


def sorted_points(spark, sf):
    """A total order of points, as places in it."""
    ranked = csv.numbered(part(spark, sf).select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")).orderBy("x", "y", "id"), "place")
    return ranked


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        dbscan_emb2d, dbscan_emb3d, dbscan_customer, dbscan_part, dbscan_events, dbscan_emb64, dbscan_voronoi_emb2d,
        eps_pairs_emb2d, range_count_part, range_query_fixed_point, has_neighbor_semi, knn_k3, grid_cells, neighbor_cells,
        vector_ops, vector_elements, vector_hashes, distances_to_first, core_flags_emb2d, cluster_sizes, noise_points, cluster_members, run_statistics,
        connected_components_edges, connected_components_stars, streaming_components,
        voronoi_assign, margin_replicas, interior_points, shared_border, cell_stats, local_clusters, pairwise_merges, cluster_map,
        bounding_box, lattice_centers, lattice_edges, hash_sample, kmeans_fixed_iters, farthest_point_seeds, contract_close_cells, line_sample, random_sampler, kmeans_sampler,
        delaunay2d_edges, delaunay3d_edges, csr_rows, round_robin_placement, balanced_placement, merge_task_placement, voronoi_faces,
        point_set_maintenance, neighbor_table, stage_statistics, entropy_labels, nmi_clusters, csv_roundtrip, fixed_width_labels, sorted_points,
    )
}
