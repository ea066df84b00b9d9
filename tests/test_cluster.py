"""k-means per type: invariants, bucketed path, nearest centroid, report."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import cluster as C
from wordloom.operators import nearest as N


def points(spark, n_per_type=(12, 40), dim=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for t, n in enumerate(n_per_type):
        for i in range(n):
            rows.append((f"t{t}", f"e{t}_{i}", rng.normal(size=dim).tolist()))
    return spark.createDataFrame(rows, "type string, entity string, vec array<double>")


def check(assign, df):
    a = assign.collect()
    assert len(a) == df.count()
    assert len({(r.type, r.entity) for r in a}) == len(a)  # every entity exactly once
    return a


def test_small_types_exact_k(spark):
    df = points(spark)
    a = check(C.kmeans_by_type(df, "type", "entity", "vec"), df)
    ks = {}
    for r in a:
        ks.setdefault(r.type, set()).add(r.cluster)
    assert len(ks["t0"]) == 12 // 5 and len(ks["t1"]) == 40 // 5


@pytest.mark.parametrize("size", [100, 1000])
def test_k_is_exact_at_every_bucket_size(spark, size):
    df = points(spark, (200, 37, 1003))
    a = check(C.kmeans_by_type(df, "type", "entity", "vec", max_bucket_rows=size), df)
    clusters = {}
    for r in a:
        clusters.setdefault(r.type, set()).add(r.cluster)
    assert {t: len(c) for t, c in clusters.items()} == {"t0": 40, "t1": 7, "t2": 200}
    assert all(c == set(range(len(c))) for c in clusters.values())


def test_identical_points_share_a_cluster(spark):
    rows = [("t", f"e{i}", [1.0, 1.0]) for i in range(120)] + [("t", f"f{i}", [float(i), 0.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "type string, entity string, vec array<double>")
    a = check(C.kmeans_by_type(df, "type", "entity", "vec", max_bucket_rows=16), df)
    assert len({r.cluster for r in a if r.entity.startswith("e")}) == 1
    assert len({r.cluster for r in a}) == 30


def test_lloyd_ends_at_a_fixed_point():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    lab = C._kmeans_np(x, np.ones(300), 20, 3)
    centers = np.stack([x[lab == j].mean(0) for j in range(20)])
    assert (((x[:, None] - centers[None]) ** 2).sum(2).argmin(1) == lab).mean() > 0.99
    near, dist = C._nearest(x, centers, block=7)
    full = ((x[:, None] - centers[None]) ** 2).sum(2)
    assert (near == full.argmin(1)).all() and np.allclose(dist, full.min(1))


def test_nearest_centroid_and_members(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.9, 1.0]), (3, [5.0, 5.0])], "id int, vec array<double>")
    out = {r.id: r.c for r in C.nearest_centroid(df, "vec", [(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [4.0, 4.0])], "c").collect()}
    assert out == {1: 0, 2: 1, 3: 2}
    m = spark.createDataFrame([("t", 0, "a"), ("t", 0, "b"), ("t", 1, "c")], "type string, cluster int, entity string")
    mem = C.cluster_members(m).collect()
    assert sorted(r.entity for r in mem) == ["a", "b"]
    assert C.cluster_sizes(m).where(F.col("type") == "t").first()["k"] == 1


@pytest.mark.parametrize("cell, pack", [(5, 7), (64, 2048)])
def test_nearest_of_many_is_exact(spark, monkeypatch, cell, pack):
    monkeypatch.setattr(N, "CELL", cell)
    monkeypatch.setattr(N, "PACK", pack)
    rng = np.random.default_rng(cell)
    cents = {t: np.round(rng.normal(size=(k, 2)) + 5 * rng.integers(0, 4, (k, 1)), 1) for t, k in (("a", 90), ("b", 3), ("c", 1))}
    pts = {t: np.round(rng.normal(size=(n, 2)) + 5 * rng.integers(0, 4, (n, 1)), 1) for t, n in (("a", 150), ("b", 20), ("d", 5))}
    rows = [(t, f"p{i}", v.tolist()) for t, x in pts.items() for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, ("a", "none", None)], "type string, id string, vec array<double>")
    # equal centroids: the smaller id wins
    cdf = spark.createDataFrame([(t, i, v.tolist()) for t, x in cents.items() for i, v in enumerate(x)] + [("b", 7, cents["b"][0].tolist())], "type string, cluster long, vec array<double>")
    stats = {}
    got = {(r.type, r.id): (r.cluster, r.distance) for r in N.assign_nearest(df, cdf, stats=stats).collect()}
    assert set(got) == {(t, i) for t, i, _ in rows if t != "d"}
    for t, i, v in rows:
        if t != "d":
            d = ((cents[t] - np.array(v)) ** 2).sum(1)
            assert got[t, i][0] == int(np.flatnonzero(d == d.min())[0]) and abs(got[t, i][1] - d.min() ** .5) < 1e-9
    assert cell > 5 or stats["visited"] < 0.7


def test_refinement_across_borders(spark):
    """Buckets of any size end near the cost of one unsplit k-means, with every cluster kept."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 3)) + 3 * rng.integers(0, 5, (1200, 1))
    df = spark.createDataFrame([("t", i, v.tolist()) for i, v in enumerate(x)], "type string, entity long, vec array<double>")

    def cost(a):
        lab = np.array([r.cluster for r in sorted(a.collect(), key=lambda r: r.entity)])
        assert set(lab) == set(range(240))
        return sum(((x[lab == j] - x[lab == j].mean(0)) ** 2).sum() for j in range(240))

    whole = cost(C.kmeans_by_type(df))
    costs = []
    split = cost(C.kmeans_by_type(df, max_bucket_rows=100, costs=costs))
    assert split < 1.05 * whole and all(b <= a + 1e-9 for a, b in zip(costs, costs[1:])) and len(costs) > 1


def test_distances_are_held_a_step_at_a_time():
    """Many points against many pivots or centroids: memory is bounded, results are those of the whole matrix."""
    import tracemalloc

    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(6000, 4)), rng.normal(size=(4096, 4))
    d = ((x[:50, None] - c) ** 2).sum(2)
    tracemalloc.start()
    cell, dist = N.nearest_pivot(x, c)
    best, ids = N.best_of(x, c, np.arange(4096))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert (ids[:50] == d.argmin(1)).all() and (cell == ids).all()
    assert np.allclose(best[:50], d.min(1)) and np.allclose(dist ** 2, best)
