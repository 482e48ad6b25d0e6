import numpy as np
import pytest

from halocline.operators import sampling, voronoi
from halocline.operators.dbscan import cluster_sizes, dbscan, n_clusters
from halocline.plans.clustering import Configuration, fit_transform


def frame(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")


def brute(v, eps, min_pts):
    v = np.asarray(v, float)
    near = ((v[:, None] - v[None]) ** 2).sum(2) <= eps * eps
    core, label = near.sum(1) >= min_pts, np.full(len(v), -1)
    for i in np.flatnonzero(core):
        line = [i] if label[i] < 0 else []
        while line:
            x = line.pop()
            if label[x] < 0:
                label[x] = i
                line += list(np.flatnonzero(near[x] & core & (label < 0)))
    out = []
    for i in range(len(v)):
        reached = label[near[i] & core]
        out.append((i, "core", label[i]) if core[i] else (i, "border", reached.min()) if len(reached) else (i, "noise", -1))
    return [(a, b, int(c)) for a, b, c in out]


def labels(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("d,n,eps,min_pts", [(1, 120, 0.3, 4), (2, 200, 0.6, 4), (2, 300, 1.2, 14), (3, 200, 1.0, 4)])
def test_grid_equals_brute_force(spark, d, n, eps, min_pts):
    v = np.random.default_rng(n).uniform(0, 8, (n, d)).round(3)
    assert labels(dbscan(frame(spark, v), eps, min_pts)) == brute(v, eps, min_pts)


@pytest.mark.parametrize("d,eps", [(2, 0.7), (5, 2.2)])
def test_voronoi_equals_brute_force(spark, d, eps):
    v = np.random.default_rng(d).uniform(0, 6, (180, d))
    assert labels(voronoi.dbscan(frame(spark, v), sampling.centers(spark, v[:7]), eps, 4)) == brute(v, eps, 4)


def test_large_cells_are_compared_block_by_block(spark, monkeypatch):
    """Two cells of which one has most points: no task gets a whole cell, each pair of points meets in one, and labels stay the same."""
    monkeypatch.setattr(voronoi, "LEAST_POINTS", 20)
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(0, 1, (150, 16)), rng.normal(0.5, 0.3, (60, 16))]).astype(np.float32).astype(float)
    v[30:40] = v[30]
    for eps in (1.8, 4.0):
        centers = sampling.centers(spark, [v[0], v[170]])
        rows, pairs = voronoi._blocks(frame(spark, v), centers, eps)
        groups, near = {}, ((v[:, None] - v[None]) ** 2).sum(2) <= eps * eps
        for r in rows.select("cell", "a", "b", "right", "id").collect():
            groups.setdefault((r["cell"], r["a"], r["b"]), ([], []))[r["right"]].append(r["id"])
        assert pairs >= len(groups) > 8 and max(len(a) + len(b) for a, b in groups.values()) <= 120
        met = [p for (_, a, b), (x, y) in groups.items() for p in ([(i, j) for i in x for j in x if i <= j] if a == b else [(min(i, j), max(i, j)) for i in x for j in y])]
        assert len(met) == len(set(met)) and set(zip(*np.nonzero(np.triu(near)))) <= set(met)
        assert labels(voronoi.dbscan(frame(spark, v), centers, eps, 4)) == brute(v, eps, 4)


@pytest.mark.parametrize("d,scale,shift,kind", [(64, 1, 0, np.float32), (64, 1, 0, float), (3, 1, 1e4, float), (2, 1, 1e9, float), (5, 1e-30, 0, float), (5, 1e170, 0, float)])
def test_near_pairs_are_exact(d, scale, shift, kind):
    """Distances at eps to the last bit, copies, coordinates far from the origin, and too small or large for products."""
    rng = np.random.default_rng(d)
    v, w = ((rng.integers(0, 4, (n, d)) / 4 * scale + shift).astype(kind) for n in (300, 500))
    w[:100] = v[:100]
    d2 = np.zeros((300, 500))
    for k in range(d):
        d2 += (v[:, None, k].astype(float) - w[None, :, k]) ** 2
    for eps in (*np.sqrt(np.quantile(d2[np.isfinite(d2)], [0.01, 0.3])), 0.0):
        got = [p for i, j in voronoi._near(v, float(eps), w) for p in zip(i, j)]
        assert len(got) == len(set(got)) and set(got) == set(zip(*np.nonzero(d2 <= eps * eps)))
    own = {p for i, j in voronoi._near(w, 0.0) for p in zip(i, j)}
    assert own == {(i, j) for i in range(500) for j in range(500) if (w[i] == w[j]).all()}


def test_cells_that_only_inner_points_link(spark):
    """Outermost points of neighbouring cells are too far apart, others are not."""
    rng = np.random.default_rng(5)
    a = rng.uniform(0, 0.7, (60, 2))
    v = np.concatenate([a, a + [1.2, 0.0], [[0.65, 0.35]] * 5, [[1.5, 0.35]] * 5])
    assert labels(dbscan(frame(spark, v), 1.0, 5)) == brute(v, 1.0, 5)


def test_two_clusters_and_order(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 0.1, (60, 2)).clip(-0.2, 0.2), rng.normal(5, 0.1, (60, 2)).clip(4.8, 5.2)])
    found = dbscan(frame(spark, v), 0.3, 5).cache()
    assert n_clusters(found) == 2 and found.where("kind = 'noise'").isEmpty()
    assert sorted(r["n_core"] + r["n_border"] for r in cluster_sizes(found).collect()) == [60, 60]


def test_isolated_empty_and_dense(spark):
    assert {r["kind"] for r in dbscan(frame(spark, [(0, 0), (100, 100), (-100, -100)]), 0.5, 2).collect()} == {"noise"}
    assert dbscan(frame(spark, []), 0.5, 2, 2).collect() == []
    dense = [(0.001 * (i % 5), 0.001 * (i // 5)) for i in range(50)]
    assert {(r["kind"], r["cluster_id"]) for r in dbscan(frame(spark, dense), 0.05, 5).collect()} == {("core", 0)}


def test_ragged_points_fail(spark):
    with pytest.raises(Exception, match="not a point"):
        dbscan(frame(spark, [(0, 0), (1,)]), 0.5, 2, 2).collect()


@pytest.mark.parametrize("sampler,how", [("kmeans", "voronoi"), ("grid", "voronoi"), ("random", "voronoi"), ("kmeans", "grid")])
def test_fit_transform(spark, sampler, how):
    v = np.random.default_rng(3).uniform(0, 5, (120, 2))
    got = fit_transform(spark, v, Configuration(0.5, 4, cells=5, sampler=sampler, implementation=how))
    assert got == [c for _, _, c in brute(v, 0.5, 4)]
    assert fit_transform(spark, [], Configuration(0.5, 4)) == []
