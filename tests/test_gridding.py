"""Gridding by neighbours, smooth triangles, patches of radial functions and kriging, against plain versions and laws."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.functions.geometry import MapHeader
from terraspan.operators import gridding as gr
from terraspan.operators import surfaces as s

HEADER = MapHeader(31, 26, 100.0, 200.0, 10.0, 12.0, 25.0)


def place(i, j):
    return HEADER.at(i, j)


def points_of(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "x double, y double, z double")


def scattered(n, seed, clustered=False):
    r = np.random.default_rng(seed)
    u, v = r.uniform(0, 300, n), r.uniform(0, 300, n)
    if clustered:
        u[: n // 2], v[: n // 2] = 40 + r.normal(0, 1.5, n // 2), 60 + r.normal(0, 1.5, n // 2)
    return np.column_stack([HEADER.xori + u * HEADER.cos - v * HEADER.sin, HEADER.yori + u * HEADER.sin + v * HEADER.cos])


def values(out):
    return {(r.i, r.j): r.value for r in out.collect()}


@pytest.mark.parametrize("apart", [False, True])
def test_nearest_points_of_all_densities(spark, apart):
    xy = np.concatenate([scattered(300, 1, True), [[1e4, 1e4], [1e4, 1e4 + 1]]])
    table = points_of(spark, np.column_stack([xy, np.arange(len(xy))]))
    out = gr.nearest_points(table.select("x", "y"), table, 7, apart).collect()
    assert len(out) == len(xy)
    for r in out:
        d = np.hypot(xy[:, 0] - r.x, xy[:, 1] - r.y)
        want = sorted((float(a), *map(float, p), float(n)) for n, (a, p) in enumerate(zip(d, xy, strict=True)) if a > 0 or not apart)[:7]
        assert np.allclose([tuple(q) for q in r.near], want)
    assert gr.nearest_points(table.select("x", "y").limit(2), table.limit(3), 9).select(F.size("near")).first()[0] == 3
    assert gr.nearest_points(table.select("x", "y").limit(2), table.limit(0), 9).select(F.size("near")).first()[0] == 0


def test_cubic_meets_parabolas_across_tiles(spark):
    f = lambda x, y: 5 + 0.1 * x - 0.2 * y + 0.003 * x * x - 0.001 * x * y + 0.002 * y * y
    xy = scattered(160, 2)
    table = points_of(spark, np.column_stack([xy, f(*xy.T)]))
    for tile in (1000, 8):
        out = values(gr.cubic(table, HEADER, tile=tile))
        assert len(out) > 600 and all(v == pytest.approx(f(*place(*k)), abs=1e-6) for k, v in out.items())
    assert set(out) == set(values(gr.linear(table, HEADER)))
    rough = points_of(spark, np.column_stack([xy, np.random.default_rng(0).normal(size=len(xy))]))
    whole, tiles = values(gr.cubic(rough, HEADER, tile=1000)), values(gr.cubic(rough, HEADER, tile=7))
    assert whole.keys() == tiles.keys() and all(tiles[k] == pytest.approx(v, abs=1e-9) for k, v in whole.items())


def test_cubic_has_no_creases(spark):
    """The slope across the sides of two triangles changes as little as along a smooth curve; linear's jumps."""
    xy = np.array([(0, 0), (10, 0), (0, 10), (10, 10), (5, 5.2), (20, 5), (-8, 4)], float)
    table = points_of(spark, np.column_stack([xy, [0, 3, 1, -2, 4, 0, 1]]))
    fine = MapHeader(401, 3, 1.0, 4.0, 0.02, 0.5)
    bend = lambda out: np.abs(np.diff([out[i, 2] for i in range(1, 402)], 2)).max()
    assert bend(values(gr.cubic(table, fine, beyond=True))) < 0.1 * bend(values(gr.linear(table, fine, beyond=True)))


def plain_rbf(xy, z, nodes):
    """The thin-plate system of all points."""
    middle, width = xy.mean(axis=0), np.ptp(xy, axis=0).max()
    p, q, n = (xy - middle) / width, (nodes - middle) / width, len(xy)
    kernel = lambda d: np.where(d > 0, d**2 * np.log(np.where(d > 0, d, 1)), 0)
    far = lambda a, b: np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    system = np.block([[kernel(far(p, p)), np.ones((n, 1)), p], [np.ones((1, n)), np.zeros((1, 3))], [p.T, np.zeros((2, 3))]])
    w = np.linalg.solve(system, np.append(z, np.zeros(3)))
    return kernel(far(q, p)) @ w[:n] + w[n] + q @ w[n + 1 :]


def test_radial_functions_of_few_points_are_one_system(spark):
    xy = scattered(120, 3)
    z = np.sin(xy[:, 0] / 60) * 10 + xy[:, 1] / 30
    out = values(gr.rbf(points_of(spark, np.column_stack([xy, z])), HEADER))
    keys = sorted(out)
    assert len(keys) == 31 * 26
    assert np.allclose([out[k] for k in keys], plain_rbf(xy, z, np.array([place(*k) for k in keys])), atol=1e-6)


@pytest.mark.parametrize("clustered", [False, True])
def test_radial_functions_by_patches(spark, monkeypatch, clustered):
    monkeypatch.setattr(gr, "PATCH", 60)
    monkeypatch.setattr(gr, "FEW", 12)
    r = np.random.default_rng(4)
    known = sorted({(int(i), int(j)) for i, j in zip(r.integers(1, 32, 150), r.integers(1, 27, 150), strict=True)})
    xy = np.concatenate([scattered(500, 5, clustered), [place(i, j) for i, j in known]])
    z = np.sin(xy[:, 0] / 60) * 10 + np.cos(xy[:, 1] / 50) * 5
    table = points_of(spark, np.column_stack([xy, z]))
    out = values(gr.rbf(table, HEADER))
    assert len(out) == 31 * 26 and all(out[k] == pytest.approx(z[500 + n], abs=1e-6) for n, k in enumerate(known))
    keys = sorted(out)
    direct = plain_rbf(*(lambda u: (u[:, :2], u[:, 2]))(np.unique(np.column_stack([xy, z]), axis=0)), np.array([place(*k) for k in keys]))
    assert np.sqrt(np.mean((np.array([out[k] for k in keys]) - direct) ** 2)) < 0.25
    plane = values(gr.rbf(table.withColumn("z", F.col("x") * 0.5 - F.col("y") + 3), HEADER))
    assert all(v == pytest.approx(place(*k)[0] * 0.5 - place(*k)[1] + 3, abs=1e-5) for k, v in plane.items())


@pytest.mark.parametrize("function", sorted(gr.KERNELS))
def test_every_kernel_is_exact_in_patches(spark, monkeypatch, function):
    monkeypatch.setattr(gr, "PATCH", 40)
    known = [(i, j) for i in range(2, 31, 3) for j in range(2, 26, 3)]
    z = np.random.default_rng(6).normal(size=len(known))
    out = values(gr.rbf(points_of(spark, [(*place(i, j), v) for (i, j), v in zip(known, z, strict=True)]), HEADER, function))
    assert all(out[k] == pytest.approx(v, abs=1e-4) for k, v in zip(known, z, strict=True))


def test_variogram_and_its_model(spark):
    xy = scattered(250, 7)
    r = np.random.default_rng(8)
    far = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
    z = np.linalg.cholesky(4.0 * gr.VARIOGRAMS["exponential"](far / 90) + 1e-6 * np.eye(250)) @ r.normal(size=250)
    table = points_of(spark, np.column_stack([xy, z]))
    got = {q.lag: q for q in gr.variogram(table, HEADER, 10, 150.0).collect()}
    a, b = np.triu_indices(250, 1)
    d, q = far[a, b], (z[a] - z[b]) ** 2 / 2
    lag = np.minimum((d / 150 * 10).astype(int), 9)
    for k in range(10):
        own = (lag == k) & (d <= 150)
        assert (got[k].n, got[k].distance, got[k].gamma) == pytest.approx((own.sum(), d[own].mean(), q[own].mean()))
    model = gr.fitted(table, HEADER, "exponential")
    assert 30 < model["range_"] < 270 and 1 < model["variance"] < 12 and 0 <= model["nugget"] < 1.5
    assert set(values(gr.kriging_by_neighbours(table, HEADER, 12, "exponential", **model))) == {(i, j) for i in range(1, 32) for j in range(1, 27)}


@pytest.mark.parametrize("model", ["exponential", "matern", "matern52", "spherical"])
@pytest.mark.parametrize("mean", [None, 2.0])
def test_kriging_by_all_neighbours_is_kriging(spark, model, mean):
    xy = scattered(40, 9)
    table = points_of(spark, np.column_stack([xy, np.random.default_rng(1).normal(size=40)]))
    options = {"model": model, "range_": 400.0, "variance": 2.0, "nugget": 0.05, "angle": 20.0, "ratio": 0.7, "mean": mean}
    whole, near = values(gr.kriging(table, HEADER, **options)), values(gr.kriging_by_neighbours(table, HEADER, 40, **options))
    assert whole.keys() == near.keys() and all(near[k] == pytest.approx(v, abs=1e-5) for k, v in whole.items())


def test_kriging_by_neighbours_takes_the_nearest(spark):
    known = [(i, j) for i in range(1, 32, 4) for j in range(1, 27, 5)]
    z = np.random.default_rng(2).normal(size=len(known))
    table = points_of(spark, [(*place(i, j), v) for (i, j), v in zip(known, z, strict=True)])
    out = values(gr.kriging_by_neighbours(table, HEADER, 6, "matern", range_=80.0))
    assert all(out[k] == pytest.approx(v, abs=1e-6) for k, v in zip(known, z, strict=True))
    for node in ((3, 3), (17, 12), (31, 25)):
        p = np.array([place(*k) for k in known])
        d = np.hypot(*(p - place(*node)).T)
        at = sorted(range(len(known)), key=lambda n: (d[n], *p[n]))[:6]
        far = lambda a, b: np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]) / 80
        left = np.ones((7, 7))
        left[:6, :6], left[6, 6] = gr.VARIOGRAMS["matern"](far(p[at], p[at])) + 1e-10 * np.eye(6), 0
        w = np.linalg.solve(left, np.append(gr.VARIOGRAMS["matern"](d[at] / 80), 1))
        assert out[node] == pytest.approx(float(w[:6] @ z[at]), abs=1e-6)
    assert gr.VARIOGRAMS["matern"](np.array([1.0]))[0] == pytest.approx(0.05, abs=1e-3) == gr.VARIOGRAMS["matern52"](np.array([1.0]))[0]


@pytest.mark.parametrize("method", ["cubic", "radial"])
def test_filled_maps_keep_their_nodes(spark, method):
    f = lambda i, j: 100 + 2 * i - 3 * j + (0.05 * i * i if method == "cubic" else 0)
    header = MapHeader(14, 12, 0.0, 0.0, 10.0, 10.0)
    hole = {(i, j) for i in range(5, 9) for j in range(4, 9)}
    nodes = spark.createDataFrame([(i, j, float(f(i, j))) for i in range(1, 15) for j in range(1, 13) if (i, j) not in hole], "i int, j int, value double")
    out = values(s.fill(nodes, header, method=method))
    assert Counter(out.keys()) == Counter((i, j) for i in range(1, 15) for j in range(1, 13))
    assert all(v == pytest.approx(f(*k), abs=1e-5) for k, v in out.items()) and not math.isnan(out[6, 6])
