import json
import math

import pytest
from pyspark.sql import functions as F

from halocline.__main__ import parse
from halocline.functions import metrics
from halocline.functions import vectors as V
from halocline.operators import delaunay, pairs, sampling
from halocline.operators.components import connected_components
from halocline.oracles import ORACLES
from halocline.plans.clustering import run
from halocline.queries import QUERIES
from halocline.sources import csv
from halocline.streaming.components import StreamingComponents
from tests.compare import against_oracle

POINTS = "id long, v array<double>"


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["component"], set()).add(r["vertex"])
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("few", [0, 100])
def test_components(spark, few):
    edges = lambda rows, kind="long": spark.createDataFrame(rows, f"u {kind}, v {kind}")
    chain = [(i, i + 1) for i in (*range(1, 5), *range(6, 10))]
    assert groups(connected_components(edges(chain), few=few)) == [[1, 2, 3, 4, 5], [6, 7, 8, 9, 10]]
    assert groups(connected_components(edges([(1, 2), (2, 3), (5, 6), (8, 9), (2, 1), (None, 4)]), few=few)) == [[1, 2, 3], [5, 6], [8, 9]]
    assert groups(connected_components(edges([(1, 1)]), few=few)) == [[1]]
    assert groups(connected_components(edges([]), few=few)) == []
    long = [(i, i + 1) for i in range(200)]
    assert groups(connected_components(edges(long), few=few)) == [list(range(201))]
    assert groups(connected_components(edges([("A", "B"), ("C", "C")], "string"), few=few)) == [["A", "B"], ["C"]]


def test_streaming_components(spark, tmp_path):
    table = StreamingComponents(spark, f"file://{tmp_path}/t")
    assert table.current().collect() == []
    for k, rows in enumerate(([(1, 2), (7, 7)], [(2, 3)], [(3, 9)])):
        spark.createDataFrame(rows, "u long, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        table.start(spark.readStream.schema("u long, v long").parquet(str(tmp_path / "in")), str(tmp_path / "check")).awaitTermination()
        assert table.is_connected(1, 2)
        assert table.is_connected(1, 9) == (k == 2)
    assert groups(table.current()) == [[1, 2, 3, 9], [7]]
    table.merge(spark.createDataFrame([(3, 9)], "u long, v long"), 2)  # the same batch again
    assert groups(table.current()) == [[1, 2, 3, 9], [7]]


def test_ranges_and_neighbours(spark):
    p = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], POINTS)
    q = lambda *v: spark.createDataFrame([(9, [float(x) for x in v])], POINTS)
    assert pairs.range_query(p, q(0, 0), 1e-9).count() == 1
    assert pairs.range_query(p, q(0.5, 0.5), 1.5).count() == 3
    assert pairs.range_query(p, q(10, 10), 0.1).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 1.0])], POINTS)
    assert pairs.range_query(twice, q(1, 1), 0.1).count() == 2
    r = pairs.knn(spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [1.0, 1.0])], POINTS), q(6, 8), 1).first()
    assert (r["id"], math.sqrt(r["d2"])) == (1, 5.0)
    assert pairs.knn(p, q(0, 0), 0).collect() == []
    five = spark.createDataFrame([(i, [float(i + k) for k in range(5)]) for i in range(10)], POINTS)
    assert [r["id"] for r in pairs.range_query(five, q(5, 6, 7, 8, 9), 2.0).collect()] == [5]
    assert {r["id"] for r in pairs.has_neighbor(five, q(5, 6, 7, 8, 9), 2.3).collect()} == {4, 5, 6}


def test_vectors_fail_where_undefined(spark):
    row = spark.createDataFrame([([1.0, 2.0], [1.0], [0.0, 0.0], [])], "a array<double>, b array<double>, z array<double>, e array<double>")
    for bad in (V.vec_add(F.col("a"), F.col("b")), V.vec_dot(F.col("a"), F.col("b")), V.normalize(F.col("z"))):
        with pytest.raises(Exception, match="differ in length|no direction"):
            row.select(bad).collect()
    with pytest.raises(ZeroDivisionError):
        V.vec_div(F.col("a"), 0)
    got = row.select(V.vec_mean(F.col("e")), V.min_max_scale(F.col("z")), V.standardize(F.col("z"))).first()
    assert list(got) == [0.0, [0.5, 0.5], [0.0, 0.0]]


def test_metrics(spark):
    def of(a, b):
        return metrics.agreement(spark.createDataFrame(list(zip(a, b)), "a int, b int"), "a", "b").first()

    assert of([0, 1, 2, 3], [0, 1, 2, 3])["mutual_information"] == pytest.approx(math.log(4))
    assert of([0, 0, 1, 1], [2, 3, 4, 5])["mutual_information"] == pytest.approx(math.log(2))
    assert of([0, 0, 1, 1, 2, 2], [1, 1, 0, 0, 2, 2])["nmi"] == pytest.approx(1.0)
    assert of([7, 7], [3, 3])["nmi"] == 1.0
    assert of([7, 7], [3, 4])["nmi"] == 0.0


def test_adjacency(spark):
    corners = [(0.0, 0.0), (1.0, 0.05), (0.03, 1.0), (1.02, 1.01), (0.5, 0.52)]
    edges = {tuple(r) for r in delaunay.edges(sampling.centers(spark, corners), 2).collect()}
    assert {(0, 4), (1, 4), (2, 4), (3, 4)} <= edges
    triangle = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "u int, v int")
    assert [(r["start"], r["end"]) for r in delaunay.csr(triangle).orderBy("u").collect()] == [(0, 2), (2, 4), (4, 6)]
    k4 = spark.createDataFrame([(a, b) for a in range(4) for b in range(a)], "u int, v int")
    placed = delaunay.place(k4, 2)
    assert sorted(r["count"] for r in placed.groupBy("worker").count().collect()) == [2, 2] and delaunay.edge_cut(k4, placed) == 4
    assert delaunay.place(k4, 2, "single").where("worker <> 0").isEmpty()
    assert delaunay.merge_tasks(k4, placed).count() == 6
    line = delaunay.edges(sampling.centers(spark, [(3.0,), (1.0,), (2.0,)]), 1)
    assert {tuple(r) for r in line.collect()} == {(1, 2), (0, 2)}


@pytest.mark.parametrize("d,n", [(2, 20), (3, 12), (4, 10), (5, 9)])
def test_edges_are_those_of_empty_spheres(d, n):
    from itertools import combinations

    import numpy as np

    def every_simplex(at):
        found = set()
        for s in combinations(range(len(at)), d + 1):
            p = at[list(s)]
            a, b = 2 * (p[1:] - p[0]), (p[1:] ** 2).sum(1) - (p[0] ** 2).sum()
            if abs(np.linalg.det(a)) > 1e-12:
                c = np.linalg.solve(a, b)
                if not (((at - c) ** 2).sum(1) < ((p[0] - c) ** 2).sum() * (1 - 1e-9)).any():
                    found |= set(combinations(s, 2))
        return found

    lattice = np.array([[i >> k & 1 for k in range(d)] for i in sorted(range(2**d), key=int.bit_count)], float)[: n + 2]
    for at in (np.random.default_rng(d).normal(size=(n, d)), lattice):
        assert delaunay._empty_spheres(at) == every_simplex(at)


def test_no_set_of_centres_is_cut(spark, monkeypatch):
    monkeypatch.setattr(delaunay, "FEW", 5)
    six = sampling.centers(spark, [(float(i), float(i * i)) for i in range(6)])
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "u int, v int")
    for call in (lambda: delaunay.edges(six, 2), lambda: delaunay.place(chain, 2)):
        with pytest.raises(ValueError, match="more than 5"):
            call()


def test_placement_keeps_joined_cells_together(spark):
    """Two cliques with one edge between them: one is cut."""
    pairs_ = [(a, b) for k in (0, 6) for a in range(k, k + 6) for b in range(k, a)] + [(0, 6)]
    edges = spark.createDataFrame(pairs_, "u int, v int")
    placed = delaunay.place(edges, 2)
    assert sorted(r["count"] for r in placed.groupBy("worker").count().collect()) == [6, 6] and delaunay.edge_cut(edges, placed) == 1


def test_random_centres_in_three_dimensions(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    p = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.uniform(0, 10, (3000, 3)))], POINTS)
    assert sampling.random_centers(p, 3, 128, 0.05, 2.0).count() == 128


def test_point_set(spark, tmp_path):
    from halocline.operators.maintenance import NeighborTable, PointSet

    points = PointSet(spark, f"file://{tmp_path}/p")
    of = lambda rows: spark.createDataFrame(rows, POINTS)
    assert points.current().collect() == []
    points.insert(of([(1, [0.0]), (2, [1.0]), (3, [1.0])]))
    points.delete(of([(2, [1.0]), (9, [0.0])]).select("id"))
    points.insert(of([(1, [5.0]), (4, [1.0]), (4, [0.5])]))
    assert {r["id"]: r["v"] for r in points.current().collect()} == {1: [5.0], 3: [1.0], 4: [0.5]}
    assert {r["id"] for r in points.compact().current().collect()} == {1, 3, 4}
    kept = NeighborTable(of([(1, [0.0]), (2, [1.0]), (3, [1.5])]), 2.0)
    assert {r["id"]: r["n"] for r in kept.count(1.0).collect()} == {1: 1, 2: 2, 3: 1}
    with pytest.raises(ValueError, match="reaches"):
        kept.within(2.5)


def test_stages(spark, tmp_path):
    from halocline.plans.stages import staged_dbscan, write_stages

    p = spark.createDataFrame([(i, [0.1 * i, 0.0]) for i in range(20)] + [(99, [9.0, 9.0])], POINTS)
    labels, stages = staged_dbscan(p, sampling.centers(spark, [(0.0, 0.0), (2.0, 0.0)]), 0.15, 3)
    assert labels.where("cluster_id = 1").count() == 20 and [s.stage for s in stages] == ["partitioning", "extension", "clustering", "merging", "labelling"]
    paths = write_stages(str(tmp_path), stages)
    assert paths[0].read_text().splitlines()[0] == "stage,points,edges,ms" and paths[0].read_text().splitlines()[1].startswith("partitioning,21,2,")


def test_no_quadratic_rows_where_points_crowd(spark):
    """Half of all points in one spot: what meets point by point stays in proportion."""
    import numpy as np

    from halocline.operators.dbscan import Grid, _neighbours, dbscan

    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(0, 0.001, (1500, 2)), rng.uniform(-3, 3, (1500, 2))])
    p = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], POINTS).repartition(4)
    grid = Grid(p, 0.2, 2)
    assert _neighbours(grid, 5).count() <= 25 * 5 * len(v)
    assert dbscan(p, 0.2, 5, 2).where("kind = 'core' and cluster_id = 0").count() >= 1500
    counts = {r["id"]: r["n"] for r in pairs.range_count(p, 0.2, 2).collect()}
    assert all(counts[i] == int((((v - v[i]) ** 2).sum(1) <= 0.2 * 0.2).sum()) for i in range(0, 3000, 97))


def test_sampling(spark):
    assert sampling.lattice_counts([1.0, 1.0], 9) == [3, 3]
    with pytest.raises(ValueError, match="volume"):
        sampling.lattice_counts([1.0, 0.0], 4)
    p = spark.createDataFrame([(i, [float(i)]) for i in range(50)], POINTS)
    a, b = ({r["id"] for r in sampling.hash_sample(p.repartition(n), 10, 3).collect()} for n in (1, 5))
    assert a == b and len(a) == 10
    assert [r for r, _ in sampling.farthest_points(p, 3)] == [0, 49, 24]
    with pytest.raises(ValueError, match="away"):
        sampling.farthest_points(p, 3, least=40)
    assert sampling.line_sample(p, 20, 1).count() > 5


@pytest.mark.parametrize("name", ["farthest_point_seeds", "distances_to_first"])
def test_no_row_is_left_out(spark, name, tmp_path):
    """On 1,000 rows, of which the later 500 lie farther out."""
    rows = [(i, [float((i * 37) % 101) * (1 + (i >= 500)), float((i * 53) % 97) * (1 + (i >= 500))]) for i in range(1000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    against_oracle(df, ORACLES[name], tmp_path)
    assert df.where("id >= 500").count() > 0


def test_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(pairs, "FEW", 4)
    at = [(i, [float(i * i % 41), float(i % 7)]) for i in range(30)]
    p = spark.createDataFrame(at, POINTS)
    got = {(r["query"], r["rank"], r["id"]) for r in pairs.knn(p, p.where("id % 2 = 0"), 3).collect()}
    near = lambda q: sorted((sum((x - y) ** 2 for x, y in zip(q, v)), i) for i, v in at)[:3]
    assert got == {(q, k + 1, i) for q, v in at if q % 2 == 0 for k, (_, i) in enumerate(near(v))}


def test_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("dim0,dim1\n" + "".join(f"{i}.5,{-i}\n" for i in range(30)))
    got = csv.read_points(spark, str(tmp_path / "p.csv"))
    assert [(r["id"], r["v"]) for r in got.orderBy("id").collect()] == [(i, [i + 0.5, -float(i)]) for i in range(30)]
    (tmp_path / "n.csv").write_text("1,2\n3,4\n")
    assert csv.read_points(spark, str(tmp_path / "n.csv"), header=False).count() == 2
    (tmp_path / "q.csv").write_text('a,b\n"1","2"\n')
    assert csv.read_points(spark, str(tmp_path / "q.csv"), quote='"').first()["v"] == [1.0, 2.0]
    (tmp_path / "bad.csv").write_text("a,b\n1,x\n")
    with pytest.raises(Exception, match="CAST|cast"):
        csv.read_points(spark, str(tmp_path / "bad.csv")).collect()
    with pytest.raises(ValueError, match="no points"):
        csv.write_points(got.limit(0), str(tmp_path / "out"), 2)
    with pytest.raises(ValueError, match="no sink"):
        csv.write_labels(got, "nowhere")


def test_row_numbers_of_several_and_split_files(spark, tmp_path):
    """Files of different sizes, written in the order of their names, the larger ones read in several parts."""
    folder, said = tmp_path / "many", []
    folder.mkdir()
    for k, n in enumerate((3, 400, 0, 50, 900, 1)):
        (folder / f"part-{k:05}.csv").write_text("dim0\n" + "".join(f"{len(said) + i}.5\n" for i in range(n)))
        said += range(n)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (kept, "1000", "200"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = csv.read_points(spark, str(folder)).collect()
            assert sorted((r["id"], r["v"][0]) for r in rows) == [(i, i + 0.5) for i in range(len(said))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_command_line(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("x,y\n" + "".join(f"{0.01 * i},0\n" for i in range(20)) + "9,9\n")
    args = ["-i", str(path), "-e", "0.05", "-m", "3", "-c", "4", "-f", "2", "-M", str(tmp_path / "m")]
    assert run(spark, parse([*args, "-s", "memory"])) == [0] * 20 + [-1]
    run(spark, parse([*args, "-s", "csv", "-D", "standard"]))
    lines = [r["value"] for r in spark.read.text(f"{path}_labels.csv").collect()]
    assert sorted(lines) == sorted([" " * 9 + "0"] * 20 + [" " * 8 + "-1"])
    record = json.loads(next((tmp_path / "m").rglob("metrics.json")).read_text())
    assert record["additionalMetrics"]["n_clusters"] == 1
    with pytest.raises(SystemExit):
        parse(["-i", str(path)])
