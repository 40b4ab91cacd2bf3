"""Cases with values worked out by hand, and laws that hold whatever the values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.functions import geometry as g
from terraspan.functions.geometry import MapHeader
from terraspan.operators import cells as c
from terraspan.operators import cubes as q
from terraspan.operators import gridding as gr
from terraspan.operators import polygons as p
from terraspan.operators import surfaces as s
from terraspan.operators import wells as w
from terraspan.streaming import ensemble


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_map_stack_statistics(spark):
    header = MapHeader(3, 4)
    stack = s.lattice(spark, header).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(100)))).withColumn("value", F.col("n").cast("double"))
    rows = s.statistics(stack).collect()
    assert len(rows) == 12 and all(r.mean == 50 and math.isclose(r.std, math.sqrt(sum((n - 50) ** 2 for n in range(101)) / 100)) and r.p50 == 50 for r in rows)


def test_depth_consistency(spark):
    flat = [(n, i, j, 100.0 * n) for n in (1, 2, 3) for i in range(1, 4) for j in range(1, 4)]
    good = spark.createDataFrame(flat, "n int, i int, j int, value double")
    bad = good.withColumn("value", F.when((F.col("n") == 2) & (F.col("i") == 1) & (F.col("j") == 1), 90.0).otherwise(F.col("value")))
    assert s.is_depth_consistent(good, "n").first().consistent and not s.is_depth_consistent(bad, "n").first().consistent
    mended = s.make_depth_consistent(bad, "n")
    assert s.is_depth_consistent(mended, "n").first().consistent and mended.where("n = 2 and i = 1 and j = 1").first().value == 100
    assert s.make_depth_consistent(mended, "n").exceptAll(mended).count() == 0


def test_sampling_at_nodes_is_exact(spark):
    header = MapHeader(7, 5, 100.0, 200.0, 10.0, 20.0, 25.0, -1)
    nodes = s.lattice(spark, header).withColumn("value", F.sin(F.col("i") * 7.0) + F.col("j"))
    out = s.sample(s.with_xy(nodes.withColumnRenamed("value", "own"), header), nodes, header)
    assert all(math.isclose(r.own, r.sampled, abs_tol=1e-9) for r in out.collect())
    far = s.sample(spark.createDataFrame([(0.0, 0.0)], "x double, y double"), nodes, header)
    assert far.first().sampled is None


def test_synthetic_surface(spark):
    flat = s.synthetic(spark, MapHeader(10, 10, xinc=10, yinc=10), top=1000, dip=45, azimuth=90)
    got = {(r.i, r.j): r.value for r in flat.collect()}
    assert got[1, 1] == 1000 and math.isclose(got[10, 5], 1090)
    dome = s.synthetic(spark, MapHeader(11, 11, xinc=10, yinc=10), 30, 30, 5, 500)
    assert dome.orderBy("value").first()[:2] == (6, 6) and dome.agg(F.max("value")).first()[0] == 505


SQUARES = {0: (3, 5), 1: (2, 6), 2: (4, 6), 10: (0, 10)}


def square(k):
    a, b = SQUARES[k]
    return [(k, n, float(x), float(y), 0.0) for n, (x, y) in enumerate(((a, a), (b, a), (b, b), (a, b), (a, a)))]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_polygons_either_join(spark, monkeypatch, limit):
    monkeypatch.setattr(p, "BROADCAST_EDGES", limit)
    points = spark.createDataFrame([(n, x + 0.5, y + 0.25, 4.0) for n, (x, y) in enumerate((x, y) for x in range(-1, 11) for y in range(-1, 11))], "pid int, x double, y double, z double")
    rings = spark.createDataFrame(square(0) + square(1) + square(10), "poly_id int, seq int, x double, y double, z double")
    out = {r.pid: r for r in p.covering(points, rings, "n").collect()}
    for r in out.values():
        assert r.n == sum(a < r.x < b and a < r.y < b for a, b in (SQUARES[k] for k in (0, 1, 10)))
    v1 = {r.pid: r.z for r in p.operate(points, rings, "add", 1.0, True, 1).collect()}
    assert all(v1[k] == 4 + r.n for k, r in out.items())
    assert p.operate(points, rings, "div", 0.0, True, 2).where("z = 0").count() == sum(r.n > 0 for r in out.values())


def test_point_in_square_is_eliminated(spark):
    one = spark.createDataFrame([(1, 4.0, 4.0, 4.0)], "pid int, x double, y double, z double")
    ring = spark.createDataFrame(square(0), "poly_id int, seq int, x double, y double, z double")
    assert p.operate(one, ring, "eli", inside=False).count() == 1 and p.operate(one, ring, "eli").count() == 0


def test_close_points_are_transitive(spark):
    rows = [(k, k * 1.0, 0.0, float(k)) for k in range(10)] + [(20, 50.0, 50.0, 1.0)]
    points = spark.createDataFrame(rows, "pid int, x double, y double, z double")
    out = {r.cluster: r for r in p.merge_close(points, 1.0).collect()}
    assert set(out) == {0, 20} and out[0].n == 10 and out[0].x == 4.5 and p.merge_close(points, 1.0, "max_z").where("cluster = 0").first().z == 9
    assert p.merge_close(points, 0.5).count() == 11


def test_zone_picks(spark):
    rows = [("a", 1, 1.0, 2.0, 3.0, 0.0, 1), ("a", 2, 4.0, 5.0, 6.0, 5.0, 2), ("a", 3, 7.0, 8.0, 9.0, 10.0, 3)]
    well = spark.createDataFrame(rows, "well string, seq int, x double, y double, z double, md double, zone int")
    assert [r.x for r in w.zone_tops(well, (1, 2)).collect()] == [4.0]
    assert sorted(r.x for r in w.zone_tops(well, (2, 3)).collect()) == [4.0, 7.0]
    assert w.zone_tops(well, (5, 10)).count() == 0 and sorted(r.x for r in w.zone_tops(well, (1, 3), use_undef=True).collect()) == [1.0, 4.0, 7.0]


def test_unit_box_transmissibility(spark):
    cells = c.box_grid(spark, (3, 4, 5)).withColumns({k: F.lit(1.0) for k in ("permx", "permy", "permz")})
    out = {(r.i, r.j, r.k): r for r in c.transmissibilities(cells, ntg=0.5).collect()}
    unit = c.DARCY["metric"]
    assert math.isclose(out[1, 1, 1].tranx, unit * 0.5) and math.isclose(out[1, 1, 1].tranz, unit) and out[3, 1, 1].tranx == out[1, 4, 1].trany == out[1, 1, 5].tranz == 0
    assert math.isclose(unit, 9.869233e-16 * 1e3 * 86400 * 1e5, rel_tol=1e-3)


def test_box_grid_geometry(spark):
    box = c.box_grid(spark, (4, 3, 2), (10, 20, 30), (2, 3, 4), rotation=30)
    row = box.agg(F.sum(c.bulk_volume()).alias("v"), F.avg(c.dx()).alias("dx"), F.avg(c.dy()).alias("dy"), F.avg(c.dz()).alias("dz")).first()
    assert all(math.isclose(x, y) for x, y in zip(row, (24 * 24, 2, 3, 4)))
    centred = c.with_centre(c.box_grid(spark, (1, 1, 1), (10, 20, 30), (2, 3, 4), oricenter=True)).first()
    assert all(math.isclose(x, y) for x, y in zip((centred.x, centred.y, centred.z), (10, 20, 30)))
    assert math.isclose(c.refine(box, 2, 3, 2).agg(F.sum(c.bulk_volume())).first()[0], 576)
    found = c.points_in_cells(c.with_centre(box).withColumn("pid", F.monotonically_increasing_id()).select("pid", "x", "y", "z", F.col("i").alias("a"), F.col("j").alias("b"), F.col("k").alias("d")), box, 2.5)
    assert found.where("i = a and j = b and k = d").count() == 24


def test_from_pillars_equals_box(spark):
    box = c.box_grid(spark, (2, 2, 3), (0, 0, 100), (10, 10, 5))
    pillars = spark.createDataFrame([(i, j, 10.0 * (i - 1), 10.0 * (j - 1), 0.0, 10.0 * (i - 1), 10.0 * (j - 1), 1000.0) for i in (1, 2, 3) for j in (1, 2, 3)], "i int, j int, x_top double, y_top double, z_top double, x_bot double, y_bot double, z_bot double")
    depths = box.select("i", "j", "k", "actnum", *(F.col(f"c{n}z").alias(f"z{n}") for n in range(8)))
    made = c.from_pillars(depths, pillars).select("i", "j", "k", *c.CORNERS)
    assert made.exceptAll(box.select("i", "j", "k", *c.CORNERS)).count() == 0


def test_trajectory_through_boxes(spark):
    rows = [("a", 1, 0.5, 0.5, 0.0, 0.0), ("a", 2, 0.5, 0.5, 3.0, 3.0), ("a", 3, 2.5, 0.5, 3.0, 5.0)]
    well = spark.createDataFrame(rows, "well string, seq int, x double, y double, z double, md double")
    out = c.trajectory_cells(well, (3, 1, 4), (0, 0, 0), (1, 1, 1)).orderBy("visit").collect()
    assert [(r.i, r.j, r.k, r.md_in, r.md_out) for r in out][:4] == [(1, 1, 1, 0, 1), (1, 1, 2, 1, 2), (1, 1, 3, 2, 3), (1, 1, 4, 3, 3.5)] and math.isclose(sum(r.length_md for r in out), 5)


def test_triangulation_covers_the_hull():
    r = np.random.default_rng(3)
    x, y = r.random(200), r.random(200)
    t = gr.delaunay(x, y)
    area = np.abs((x[t[:, 1]] - x[t[:, 0]]) * (y[t[:, 2]] - y[t[:, 0]]) - (x[t[:, 2]] - x[t[:, 0]]) * (y[t[:, 1]] - y[t[:, 0]])).sum() / 2
    edges, counts = np.unique(np.sort(t[:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2), axis=1), axis=0, return_counts=True)
    rim = edges[counts == 1]
    assert counts.max() == 2 and math.isclose(area, 0.5 * abs(sum(x[a] * y[b] - x[b] * y[a] for a, b in oriented(rim))), rel_tol=1e-9)


def oriented(rim):
    nxt = {}
    for a, b in rim.tolist():
        nxt.setdefault(a, []).append(b)
        nxt.setdefault(b, []).append(a)
    out, before, at = [], None, int(rim[0][0])
    for _ in range(len(rim)):
        to = next(v for v in nxt[at] if v != before)
        out.append((at, to))
        before, at = at, to
    return out


@pytest.fixture(scope="module")
def plane(spark):
    r = np.random.default_rng(42)
    rows = [(k, float(x), float(y), float(100 + 0.1 * x + 0.05 * y)) for k, (x, y) in enumerate(r.uniform(0, 490, (100, 2)))]
    return spark.createDataFrame(rows, "pid int, x double, y double, z double")


def test_gridding_a_plane(spark, plane):
    header = MapHeader(50, 50, 0.0, 0.0, 10.0, 10.0)
    want = lambda r: 100 + (r.i - 1) + 0.5 * (r.j - 1)
    for out in (gr.linear(plane, header), gr.rbf(plane, header), gr.rbf(plane, header, "multiquadric"), gr.rbf(plane, header, "gaussian")):
        rows = out.collect()
        assert len(rows) > 1500 and all(abs(r.value - want(r)) < 1e-3 for r in rows)


def test_kriging_and_idw_are_exact_at_points(spark):
    header = MapHeader(21, 21, 0.0, 0.0, 10.0, 10.0)
    rows = [(k, float(10 * (k * 7 % 21)), float(10 * (k * 5 % 21)), float(k * k % 17)) for k in range(15)]
    points = spark.createDataFrame(rows, "pid int, x double, y double, z double")
    for out in (gr.kriging(points, header, "exponential", 80.0), gr.kriging(points, header, "spherical", 80.0, mean=5.0), gr.idw(points, header), gr.idw(points, header, radius=60.0), gr.nearest(points, header)):
        got = {(r.i, r.j): r.value for r in out.collect()}
        assert all(math.isclose(got[x / 10 + 1, y / 10 + 1], z, abs_tol=1e-4) for _, x, y, z in rows)
    constant = gr.kriging(points.withColumn("z", F.lit(3.0)), header, "gaussian", 60.0)
    assert all(math.isclose(r.value, 3, abs_tol=1e-5) for r in constant.collect())


def test_kriging_uses_all_points(spark):
    header = MapHeader(25, 25, 0.0, 0.0, 10.0, 10.0)
    rows = [(10.0 * a, 10.0 * b, float((a * 7 + b * 5) % 17)) for a in range(25) for b in range(25)]
    points = spark.createDataFrame(rows, "x double, y double, z double")
    for out in (gr.kriging(points, header, "exponential", 80.0), gr.kriging(points, header, "exponential", 30.0, max_points=300)):
        got = {(r.i, r.j): r.value for r in out.collect()}
        assert len(got) == 625 and all(math.isclose(got[x / 10 + 1, y / 10 + 1], z, abs_tol=1e-4) for x, y, z in rows)


def test_outlines(spark):
    points = spark.createDataFrame([("a", float(x), float(y)) for x in range(8) for y in range(8) if not (2 <= x <= 5 and y >= 3)], "g string, x double, y double")
    ring = [(r.x, r.y) for r in gr.hull(points, "g").orderBy("seq").collect()]
    assert ring == [(0, 0), (7, 0), (7, 7), (0, 7), (0, 0)]
    shape = gr.alpha_shape(points, "g", 1.0).orderBy("poly_id", "seq").collect()
    ring = [(r.x, r.y) for r in shape]
    assert ring[0] == ring[-1] and math.isclose(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2, 7 * 2 + 2 * 1 * 5 + 2 * 0.5)


def test_simplify(spark):
    line = spark.createDataFrame([(0, k, float(k), 0.01 * (k % 2) if k < 10 else float(k - 9), 0.0) for k in range(20)], "poly_id int, seq int, x double, y double, z double")
    kept = [r.seq for r in gr.simplify(line, 0.1).orderBy("seq").collect()]
    assert kept[0] == 0 and kept[-1] == 19 and 9 in kept and len(kept) <= 4


def test_scalars(spark):
    p0 = [tuple(map(F.lit, map(float, x))) for x in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))]
    assert math.isclose(abs(value(spark, g.tetrahedron(*p0))), 1 / 6)
    box = [tuple(map(F.lit, map(float, x))) for x in ((0, 0, 0), (2, 0, 0), (2, 3, 0), (0, 3, 0), (0, 0, 4), (2, 0, 4), (2, 3, 4), (0, 3, 4))]
    assert all(math.isclose(value(spark, g.hexahedron(box, n)), 24) for n in (1, 2, 4))
    assert value(spark, g.angle_to_azimuth(F.lit(0.0))) == 90 and math.isclose(value(spark, g.mean_angle(F.lit(350.0), F.lit(20.0))), 5)
    assert value(spark, g.angle_difference(F.lit(10.0), F.lit(350.0))) == 20
    assert value(spark, g.short_well_name(F.lit("31/2-G-5 AH"))) == "G-5AH" and value(spark, g.safe_well_name(F.lit("31/2-E-4 AH"))) == "31_2-E-4_AH"
    assert str(value(spark, g.to_date(F.lit("2020-01-31")))) == "2020-01-31" == str(value(spark, g.to_date(F.lit(20200131))))


def test_cube_sampling_at_samples(spark):
    header = q.CubeHeader(MapHeader(4, 3, 0.0, 0.0, 10.0, 10.0, 20.0), 5, 100.0, 2.0)
    traces = s.lattice(spark, header.map).select("i", "j", F.lit(1).alias("traceid"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: (F.col("i") * 100 + F.col("j") * 10 + k).cast("float")).alias("amp"))
    for method in ("nearest", "trilinear", "catmull_rom"):
        out = q.resample(traces, header, header, method).collect()
        assert len(out) == 60 and all(math.isclose(r.value, r.i * 100 + r.j * 10 + r.k - 1, abs_tol=1e-6) for r in out)


def test_streaming_ensemble_follows_the_files(spark, tmp_path):
    schema = "realisation int, i int, j int, value double"
    folder, out = f"{tmp_path}/in", None
    rows = [(n, i, j, float(n * i + j)) for n in range(6) for i in (1, 2) for j in (1, 2)]
    for n in range(3):
        spark.createDataFrame([r for r in rows if r[0] % 3 == n], schema).coalesce(1).write.mode("append").parquet(folder)
    query = ensemble.run(ensemble.statistics(ensemble.arriving(spark, folder, schema, 1)), "ensemble", f"{tmp_path}/checkpoint")
    query.processAllAvailable()
    query.stop()
    out = {(r.i, r.j): (r.n, r.mean, r.std) for r in spark.table("ensemble").collect()}
    for (i, j), (n, mean, std) in out.items():
        own = [v for _, a, b, v in rows if (a, b) == (i, j)]
        assert n == 6 and math.isclose(mean, np.mean(own)) and math.isclose(std, np.std(own, ddof=1))


def by_node(df):
    return {(r.i, r.j): r.value for r in df.collect()}


def test_linear_by_tiles_is_linear_in_one(spark):
    r = np.random.default_rng(12)
    xy = np.column_stack([r.uniform(0, 400, 260), r.uniform(0, 300, 260)])
    xy = xy[(xy[:, 0] < 150) | (xy[:, 0] > 230)]  # with a gap that only long triangles span
    points = spark.createDataFrame([(float(x), float(y), float(np.sin(x / 50) * y)) for x, y in xy], "x double, y double, z double")
    header = gr.MapHeader(41, 31, 0.0, 0.0, 10.0, 10.0)
    whole, tiles = by_node(gr.linear(points, header, tile=1000)), by_node(gr.linear(points, header, tile=6))
    assert whole.keys() == tiles.keys() and len(whole) > 900
    assert all(abs(whole[k] - tiles[k]) < 1e-9 for k in whole)


def test_idw_means_the_same_for_any_number_of_points(spark, monkeypatch):
    r = np.random.default_rng(13)
    rows = [tuple(map(float, x)) for x in r.uniform(0, 100, (300, 3))]
    points, header = spark.createDataFrame(rows, "x double, y double, z double"), gr.MapHeader(6, 5, 0.0, 0.0, 20.0, 25.0)
    one = by_node(gr.idw(points, header))
    monkeypatch.setattr(gr, "CHUNK", 40)
    many = by_node(gr.idw(points, header))
    x, y, z = np.array(rows).T
    for (i, j), v in one.items():
        w = ((x - 20 * (i - 1)) ** 2 + (y - 25 * (j - 1)) ** 2) ** -1.0
        assert abs(v - (w @ z) / w.sum()) < 1e-9 and abs(v - many[i, j]) < 1e-9
    assert len(one) == len(many) == 30


def test_kriging_out_of_reach_is_the_mean(spark):
    points = spark.createDataFrame([(5.0, 5.0, 2.0), (15.0, 5.0, 4.0)], "x double, y double, z double")
    out = by_node(gr.kriging(points, gr.MapHeader(60, 3, 0.0, 0.0, 10.0, 10.0), "spherical", 20.0, block=5))
    assert len(out) == 180 and out[60, 3] == 3.0
    assert by_node(gr.kriging(points, gr.MapHeader(60, 3, 0.0, 0.0, 10.0, 10.0), "spherical", 20.0, mean=7.0, block=5))[60, 3] == 7.0


def test_alpha_shape_by_tiles(spark):
    """Two squares of points, apart by more than the radius: two rings around them, in tiles much smaller than the squares."""
    rows = [(1, float(a + s), float(b)) for s in (0, 100) for a in range(0, 41, 4) for b in range(0, 41, 4)]
    out = gr.alpha_shape(spark.createDataFrame(rows, "g int, x double, y double"), "g", 4.0).collect()
    rings = {}
    for r in out:
        rings.setdefault(r.poly_id, []).append((r.seq, r.x, r.y))
    assert len(rings) == 2
    for n, ring in rings.items():
        p = [(x, y) for _, x, y in sorted(ring)]
        assert p[0] == p[-1] and len(p) == 41
        assert abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:]))) / 2 == 1600.0


def test_cubic_windows_are_exact_for_cubics(spark):
    from terraspan.operators import cubes

    z = np.arange(30.0)
    cubic = lambda v: 0.01 * v**3 - 0.3 * v**2 + v - 5
    traces = spark.createDataFrame([(1, 1, 1, [float(x) for x in cubic(z)]), (1, 2, 1, [float(x) for x in -2 * cubic(z)]), (2, 1, 2, [0.0] * 30)], "i int, j int, traceid int, amp array<double>")
    header = cubes.CubeHeader(gr.MapHeader(2, 2), 30, 1000.0, 4.0)
    maps = [spark.createDataFrame([(i, j, v) for i in (1, 2) for j in (1, 2)], "i int, j int, value double") for v in (1020.0, 1050.0)]
    out = {(r.i, r.j): r for r in cubes.window_attributes(traces, header, *maps, ndiv=8, method="cubic").collect()}
    fine = cubic(np.arange(5 * 8, int(12.5 * 8) + 1) / 8)
    assert set(out) == {(1, 1), (1, 2)}
    for key, v in (((1, 1), fine), ((1, 2), -2 * fine)):
        got = out[key]
        assert np.allclose([got.min, got.max, got.mean, got.rms], [v.min(), v.max(), v.mean(), np.sqrt((v**2).mean())], rtol=0, atol=1e-3)
    near = cubes.window_around(traces, header, maps[0].withColumn("value", F.lit(1035.0)), 15.0, 8, "cubic").where("i = 1 and j = 1").first()
    assert abs(near["mean"] - out[1, 1]["mean"]) < 1e-9


def test_property_on_a_map(spark):
    from terraspan.operators import cells as c

    box = c.box_grid(spark, (8, 6, 4), (0, 0, 1000), (10, 10, 5)).withColumns({"zone": F.when(F.col("k") <= 2, 1).otherwise(2), "actnum": F.when((F.col("k") == 4), 0).otherwise(1)})
    cells = box.withColumn("poro", F.col("k") * 0.1 + (F.col("c0x") + F.col("c1x")) / 2 * 0.01)
    header = gr.MapHeader(7, 5, 5.0, 5.0, 11.0, 12.0)
    out = by_node(gr.from_cells(cells, header, "poro"))
    assert len(out) == 35 and all(abs(v - (0.2 + (5 + 11 * (i - 1)) * 0.01)) < 1e-6 for (i, j), v in out.items())
    zoned = by_node(gr.from_cells(cells, header, "poro", (1, 1), by_zone=True))
    assert all(abs(v - (0.15 + (5 + 11 * (i - 1)) * 0.01)) < 1e-6 for (i, j), v in zoned.items())
    thick = by_node(gr.from_cells(cells.withColumn("hc", F.lit(2.0)), header, "hc", summing=True))
    assert all(abs(v - 6.0) < 1e-6 for v in thick.values())
    assert set(by_node(gr.from_cells(cells, header, "poro", truncate_le=0.5))) == {k for k, v in out.items() if v >= 0.5}


def test_blocked_wells(spark, tmp_path):
    from terraspan.sources import tables

    (tmp_path / "b.csv").write_text("WELLNAME,X_UTME,Y_UTMN,Z_TVDSS,PHIT,I_INDEX,J_INDEX,K_INDEX\nW,1,2,3,0.1,4,5,6\nW,2,3,4,0.2,4,5,7\nW,3,4,5,0.3,,,\n")
    got = tables.blocked(tables.read_wells_csv(spark, str(tmp_path / "b.csv"))).orderBy("seq").collect()
    assert [(r.well, r.i, r.j, r.k, r.PHIT) for r in got] == [("W", 4, 5, 6, 0.1), ("W", 4, 5, 7, 0.2)]


def test_outline_of_cells_with_a_hole(spark):
    from terraspan.operators import cells as c

    box = c.box_grid(spark, (12, 10, 2), (0, 0, 1000), (10, 10, 5)).withColumn("actnum", F.expr("cast(not (i between 5 and 8 and j between 4 and 7) as int)"))
    rings = {}
    for r in gr.outline(box, 0.6).collect():
        rings.setdefault(r.poly_id, []).append((r.seq, r.x, r.y))
    area = lambda ring: abs(sum(a[1] * b[2] - b[1] * a[2] for a, b in zip(sorted(ring), sorted(ring)[1:]))) / 2
    assert sorted(map(area, rings.values())) == [2300.0, 9900.0]  # the hole's corners are cut
    assert area([tuple(x) for x in gr.outline(box, convex=True).select("seq", "x", "y").collect()]) == 9900.0


def test_shared_heights_of_slanted_faces(spark):
    from terraspan.operators import cells as c

    r = np.random.default_rng(21)
    rows = [tuple(map(float, v)) for v in np.sort(r.uniform(0, 10, (60, 4, 2)), axis=1)[:, [0, 2, 1, 3]].reshape(60, 8)] + [(0.0, 10.0, 10.0, 20.0, 10.0, 0.0, 20.0, 10.0)]
    got = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double, h double").select("*", c.shared_height(*((F.col(x), F.col(y)) for x, y in ("ab", "cd", "ef", "gh"))).alias("s")).collect()
    w = (np.arange(200000) + 0.5) / 200000
    for row in got:
        ta, ba, tb, bb = (row[k] + w * (row[k + 1] - row[k]) for k in (0, 2, 4, 6))
        assert abs(row.s - np.maximum(0, np.minimum(ba, bb) - np.maximum(ta, tb)).mean()) < 1e-4
    assert got[-1].s == 5.0


def test_fill_by_triangles_keeps_a_plane(spark):
    from terraspan.operators import surfaces as s

    header = gr.MapHeader(9, 8, 0.0, 0.0, 10.0, 10.0)
    nodes = spark.createDataFrame([(i, j, 2.0 * i + 3.0 * j) for i in range(1, 10) for j in range(1, 8) if not (3 <= i <= 6 and 3 <= j <= 5)], "i int, j int, value double")
    out = by_node(s.fill(nodes, header, method="linear"))
    assert len(out) == 72 and all(abs(v - (2 * i + 3 * min(j, 7))) < 1e-4 for (i, j), v in out.items())


def test_windowed_rates_close_by_watermark(spark, tmp_path):
    folder = f"{tmp_path}/in"
    schema = "ts timestamp, well string, value double"
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    batches = [[(start + timedelta(minutes=m), "A", float(m)) for m in (0, 30, 59)], [(start + timedelta(minutes=90), "A", 5.0)], [(start + timedelta(minutes=1), "A", 99.0), (start + timedelta(hours=4), "B", 1.0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    query = ensemble.run(ensemble.windowed_rates(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)), "rates", f"{tmp_path}/checkpoint", "append")
    query.processAllAvailable()
    query.stop()
    out = {(r.window.start, r.well): (r.n, r["mean"]) for r in spark.table("rates").collect()}
    assert out[start, "A"][0] in (3, 4)  # the late row may come in the order of the files
    assert out[start + timedelta(hours=1), "A"] == (1, 5.0) and (start + timedelta(hours=4), "B") not in out
