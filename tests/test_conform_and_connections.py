"""Grids brought to maps along slanted and faulted pillars, connections by tables and across holes, joins of intervals: by hand and against plain versions."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.functions import geometry as g
from terraspan.functions.geometry import MapHeader
from terraspan.operators import cells as c
from terraspan.operators import connections as cn
from terraspan.operators import surfaces as s
from terraspan.operators.intervals import overlapping

HEADER = MapHeader(6, 6, -100.0, -100.0, 100.0, 100.0)


def flat(spark, z, header=HEADER):
    return s.constant(spark, header, z)


def faulted(spark, nz=4, throw=50.0):
    """3 x 3 columns of 100 x 100, layers of 50; columns from the third on lie lower by the throw."""
    grid = c.box_grid(spark, (3, 3, nz), (0, 0, 1000), (100, 100, 50))
    return grid.withColumns({f"c{n}z": F.col(f"c{n}z") + F.when(F.col("i") == 3, throw).otherwise(0.0) for n in range(8)})


def nodes(out):
    """{(ni, nj, interface): {column: depth}}, interface 0 is the top; and the corners of each."""
    depths, places = defaultdict(dict), {}
    for r in out.collect():
        for n, (di, dj, dk) in enumerate(c.ENDS):
            depths[r.i + di, r.j + dj, r.k - 1 + dk][r.i, r.j] = r[f"c{n}z"]
            places[r.i + di, r.j + dj, r.k - 1 + dk, r.i, r.j] = (r[f"c{n}x"], r[f"c{n}y"], r[f"c{n}z"])
    return depths, places


def test_inclined_pillars_keep_their_lines(spark):
    grid = c.box_grid(spark, (3, 3, 4), (0, 0, 1000), (100, 100, 50))
    lean = {f"c{n}{a}": F.col(f"c{n}{a}") + by * (F.col(f"c{n}z") - 1000) for n in range(8) for a, by in (("x", 0.1), ("y", 0.05))}
    out = c.conform(grid.withColumns(lean), [flat(spark, 900.0), flat(spark, 1300.0)], HEADER, [4])
    depths, places = nodes(out)
    for (ni, nj, k), own in depths.items():
        assert all(z == pytest.approx(900 + 100 * k) for z in own.values())
    for (ni, nj, *_), (x, y, z) in places.items():
        assert (x, y) == pytest.approx(((ni - 1) * 100 + 0.1 * (z - 1000), (nj - 1) * 100 + 0.05 * (z - 1000)))


def test_throw_stays_and_its_mean_lies_on_the_maps(spark):
    out = c.conform(faulted(spark), [flat(spark, z) for z in (900.0, 1100.0, 1500.0)], HEADER, [2, 2])
    depths, _ = nodes(out)
    for (ni, nj, k), own in depths.items():
        want = (900, 1000, 1100, 1300, 1500)[k]
        assert np.mean(list(own.values())) == pytest.approx(want)
        for (i, _), z in own.items():
            assert z == pytest.approx(want + (0 if ni != 3 else 25 if i == 3 else -25))


def test_pinched_and_faulted(spark):
    """Layers 3 and 4 have no height east of the fault, on its pillars."""
    grid = faulted(spark, 6)
    pinch = {f"c{n}z": F.when((F.col("i") == 3) & (F.col("k") - 1 + d).between(2, 4), 1150.0).otherwise(F.col(f"c{n}z")) for n, (a, _, d) in enumerate(c.ENDS) if a == 0}
    out = c.conform(grid.withColumns(pinch), [flat(spark, z) for z in (900.0, 1200.0, 1500.0)], HEADER, [3, 3])
    depths, places = nodes(out)
    for ni in (1, 2, 4):
        for nj in range(1, 5):
            assert [np.mean(list(depths[ni, nj, k].values())) for k in (0, 3, 6)] == pytest.approx([900, 1200, 1500])
    for (ni, nj, k, i, j), (_, _, z) in places.items():
        assert k == 0 or z >= places[ni, nj, k - 1, i, j][2] - 1e-9


def test_skipped_faults_stay(spark):
    grid = faulted(spark)
    before, after = nodes(grid)[0], nodes(c.conform(grid, [flat(spark, 800.0), flat(spark, 1400.0)], HEADER, [4], faults="skip"))[0]
    for key, own in before.items():
        assert after[key] == own if key[0] == 3 else set(after[key].values()) == {800.0 + 150 * key[2]}


def test_pillars_off_the_maps_and_matching_maps_change_nothing(spark):
    grid = c.box_grid(spark, (3, 3, 4), (0, 0, 1000), (100, 100, 50))
    far = HEADER.moved(5000.0, 0.0)
    before = sorted(grid.collect())
    assert sorted(c.conform(grid, [flat(spark, 900.0, far), flat(spark, 1300.0, far)], far, [4]).collect()) == before
    same = sorted(c.conform(grid, [flat(spark, 1000.0), flat(spark, 1200.0)], HEADER, [4]).collect())
    assert all(np.allclose(list(a), list(b)) for a, b in zip(same, before, strict=True))


def test_crossing_maps_and_zones_without_height(spark):
    grid = c.box_grid(spark, (1, 1, 4), (0, 0, 1000), (100, 100, 50))
    out = nodes(c.conform(grid, [flat(spark, z) for z in (1000.0, 1100.0, 1050.0)], HEADER, [2, 2]))[0]
    assert [out[1, 1, k][1, 1] for k in range(5)] == [1000, 1050, 1100, 1100, 1100]
    thin = grid.withColumns({f"c{n}z": F.least(F.col(f"c{n}z"), F.lit(1100.0)) for n in range(8)})
    out = nodes(c.conform(thin, [flat(spark, z) for z in (1000.0, 1080.0, 1300.0)], HEADER, [2, 2]))[0]
    assert [out[1, 1, k][1, 1] for k in range(5)] == [1000, 1040, 1080, 1080, 1300]


def test_conform_refuses_what_does_not_fit(spark):
    grid = c.box_grid(spark, (1, 1, 2))
    with pytest.raises(ValueError):
        c.conform(grid, [flat(spark, 1.0)], HEADER, [2])
    with pytest.raises(ValueError):
        c.conform(grid, [flat(spark, 1.0)] * 3, HEADER, [2, 0])


def test_lines_meet_a_bumpy_map_where_a_fine_search_finds_it(spark):
    r = random.Random(8)
    header = MapHeader(9, 7, 10.0, 20.0, 30.0, 25.0, 20.0)
    z = {(i, j): 1000 + r.uniform(-15, 15) for i in range(1, 10) for j in range(1, 8) if (i, j) != (5, 4)}
    lines = [(n, *(r.uniform(-20, 260) for _ in "xy"), r.uniform(950, 990), *(r.uniform(-20, 260) for _ in "xy"), r.uniform(1010, 1060)) for n in range(300)]
    lines += [(300 + n, x, y, 900.0, x, y, 901.0) for n, (x, y) in enumerate((r.uniform(0, 250), r.uniform(0, 250)) for _ in range(40))]
    lines += [(400, 50.0, 60.0, 5.0, 90.0, 60.0, 5.0)]
    table = spark.createDataFrame(lines, "id int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    values = spark.createDataFrame([(i, j, v) for (i, j), v in z.items()], "i int, j int, value double")
    got = {q.id: q.depth for q in s.pierced(table, values, header, ["id"]).collect()}

    def height(x, y):
        u, v = ((x - 10) * header.cos + (y - 20) * header.sin) / 30, ((y - 20) * header.cos - (x - 10) * header.sin) / 25
        if not (0 <= u <= 8 and 0 <= v <= 6):
            return math.nan
        i, j = min(int(u), 7), min(int(v), 5)
        q = [z.get((i + 1 + a, j + 1 + b), math.nan) for b in (0, 1) for a in (0, 1)]
        p, w = u - i, v - j
        return q[0] * (1 - p) * (1 - w) + q[1] * p * (1 - w) + q[2] * (1 - p) * w + q[3] * p * w

    for n, x0, y0, z0, x1, y1, z1 in lines:
        if n >= 300:
            want = height(x0, y0) if n < 400 else math.nan
        else:
            ts = np.linspace(-0.5, 1.5, 20001)
            d = np.array([z0 + t * (z1 - z0) - height(x0 + t * (x1 - x0), y0 + t * (y1 - y0)) for t in ts])
            at = np.flatnonzero(d[:-1] * d[1:] <= 0)
            want = z0 + ts[at[0]] * (z1 - z0) if len(at) else math.nan
        assert (n in got) == (not math.isnan(want)), n
        assert math.isnan(want) or got[n] == pytest.approx(want, abs=2e-4 * abs(z1 - z0) + 1e-9)
    assert 100 < len(got) < 300


# ---- connections

C = c.DARCY["metric"]
AXES = {"i": ((5, 1, 1), "I+"), "j": ((1, 5, 1), "J+"), "k": ((1, 1, 5), "K+")}


def nested(spark, dimension, axis):
    """Cells of 1 x 1 x 1; along the axis: two of the mother, a hole, two refined."""
    at = F.col(axis)
    return c.box_grid(spark, dimension).withColumns({"nest_id": F.when(at <= 2, 1).when(at == 3, 0).otherwise(2), "perm": F.lit(1.0), "ntg": F.lit(1.0)})


@pytest.mark.parametrize("axis", "ijk")
@pytest.mark.parametrize("perm, ntg", [(1.0, 1.0), (2.0, 1.0), (1.0, 0.5)])
def test_a_hole_between_unit_cells(spark, axis, perm, ntg):
    dimension, direction = AXES[axis]
    grid = nested(spark, dimension, axis)
    table = cn.nested_table(grid)
    out = cn.table_connections(grid.withColumn("perm", F.lit(perm)), table, ("perm",) * 3, ntg).collect()
    assert len(out) == 1 and out[0].direction == direction and out[0].type == "NestedHybrid"
    assert out[0].tran == pytest.approx(C * perm * (1 if axis == "k" else ntg))
    assert (out[0][f"{axis}1"], out[0][f"{axis}2"]) == (2, 4)
    marked = [r for r in cn.refined_boundary(grid, table).collect() if r.refined_boundary]
    assert [r[axis] for r in marked] == [4]


def test_a_hole_of_three_columns_and_none_at_all(spark):
    assert cn.nested_table(nested(spark, (5, 3, 1), "i")).count() == 3
    whole = c.box_grid(spark, (3, 1, 1)).withColumns({"nest_id": F.lit(1), "perm": F.lit(1.0)})
    table = cn.nested_table(whole)
    out = cn.table_connections(whole, table, ("perm",) * 3)
    assert out.count() == 0 and out.columns == ["i1", "j1", "k1", "i2", "j2", "k2", "tran", "type", "direction"]
    assert cn.refined_boundary(whole, out).agg(F.sum("refined_boundary")).first()[0] == 0


def test_refined_cells_share_parts_of_a_mother_face(spark):
    """A mother cell of 100 x 100 x 10 next to 2 x 2 refined ones: each has a quarter of its face; inactive ones have none."""
    mother = c.box_grid(spark, (2, 1, 1), (0, 0, 0), (100, 100, 10)).withColumn("nest_id", F.when(F.col("i") == 1, 1).otherwise(0))
    fine = c.box_grid(spark, (1, 2, 2), (100, 0, 0), (50, 50, 5)).withColumns({"i": F.col("i") + 3, "nest_id": F.lit(2)})
    hole = c.box_grid(spark, (1, 2, 2), (50, 0, 0), (50, 50, 5)).withColumns({"i": F.col("i") + 2, "nest_id": F.lit(0), "actnum": F.lit(0)})
    grid = mother.unionByName(fine).unionByName(hole).withColumns({"px": F.when(F.col("nest_id") == 1, 100.0).otherwise(300.0)})
    out = cn.table_connections(grid, cn.nested_table(grid), ("px",) * 3).collect()
    h1, h2 = 100.0 * 250 / 50, 300.0 * 250 / 25
    assert {(r.i1, r.j1, r.k1, r.i2, r.j2, r.k2) for r in out} == {(1, 1, 1, 4, j, k) for j in (1, 2) for k in (1, 2)}
    assert all(r.tran == pytest.approx(C * h1 * h2 / (h1 + h2)) for r in out)
    closed = grid.withColumn("actnum", F.when((F.col("nest_id") == 2) & (F.col("k") == 2), 0).otherwise(F.col("actnum")))
    assert {r.k2 for r in cn.nested_table(closed).collect()} == {1}


def test_table_only_pairs_that_fit_count(spark):
    grid = c.box_grid(spark, (3, 3, 3)).withColumn("perm", F.lit(1.0))
    table = spark.createDataFrame([(1, 1, 1, 2, 1, 1, "I+"), (1, 1, 1, 2, 1, 1, "I+"), (2, 1, 1, 1, 1, 1, "I-"), (1, 1, 1, 9, 1, 1, "I+"), (1, 1, 1, 2, 1, 1, "X"), (1, 1, 1, 2, 1, 1, "K+"), (1, 1, 1, 2, 2, 1, "I+"), (1, 1, None, 2, 2, 1, "I+")], "i1 int, j1 int, k1 int, i2 int, j2 int, k2 int, direction string")
    out = sorted((r.i1, r.direction, r.tran) for r in cn.table_connections(grid, table, ("perm",) * 3).collect())
    assert [x[:2] for x in out] == [(1, "I+"), (1, "I+"), (2, "I-")] and all(x[2] == pytest.approx(C) for x in out)


def test_polygon_overlap_of_quadrilaterals(spark):
    def plain(p, q, n=400):
        """The share of a fine raster that lies in both."""
        inside = lambda poly, x, y: all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(poly, poly[1:] + poly[:1], strict=True))
        return sum(inside(p, x, y) and inside(q, x, y) for x in np.arange(n) / n * 4 for y in np.arange(n) / n * 4) * 16 / n / n

    shapes = [([(0, 0), (2, 0), (2, 2), (0, 2)], [(1, 1), (3, 1), (3, 3), (1, 3)], 1.0), ([(0, 0), (2, 0), (2, 2), (0, 2)], [(2, 0), (4, 0), (4, 2), (2, 2)], 0.0), ([(0, 0), (2, 0), (2, 2), (0, 2)], [(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1)], 0.25), ([(0, 1), (3, 0), (4, 3), (1, 4)], [(1, 0), (4, 1), (3, 4), (0, 3)], None)]
    ring = lambda p: F.array(*(g.plane_point(F.lit(x), F.lit(y)) for x, y in p))
    for p, q, want in shapes:
        area = g.polygon_area(g.polygon_overlap(ring(p), [g.plane_point(F.lit(x), F.lit(y)) for x, y in q]))
        assert spark.range(1).select(area.alias("a")).first().a == pytest.approx(plain(p, q) if want is None else want, abs=0.1 if want is None else 1e-12)


# ---- intervals


def test_intervals_of_all_lengths(spark):
    r = random.Random(4)
    rows = lambda: [(r.randrange(3), n, a, a + r.choice([0.0, -1.0, 1e-7, 0.01, 1.0, 3.0, 64.0, 5e3]) * r.choice([1, r.random()])) for n, a in enumerate(r.choice([r.uniform(-50, 50), float(r.randrange(-8, 8))]) for _ in range(150))]
    left, right = rows(), [*rows(), (1, 999, None, 3.0)]
    a = spark.createDataFrame(left, "g int, a int, lo double, hi double")
    b = spark.createDataFrame(right, "g int, b int, lo double, hi double")
    want = sorted((p[1], q[1]) for p in left for q in right if p[0] == q[0] and q[2] is not None and p[3] > p[2] and q[3] > q[2] and p[2] < q[3] and q[2] < p[3])
    out = overlapping(a, b, ["g"])
    assert sorted(out.columns) == ["a", "b", "g", "hi", "lo"] and sorted((x.a, x.b) for x in out.collect()) == want and len(want) > 1000
    mine = {x[1]: x[2:] for x in left}
    assert all((x.lo, x.hi) == mine[x.a] for x in out.collect())


def test_faces_across_a_fault_are_looked_at_where_they_touch(spark):
    """200 layers against 200: some 400 pairs touch; what the join makes grows with those, not with 40 000."""
    grid = c.box_grid(spark, (2, 1, 200), (0, 0, 0), (10, 10, 1)).withColumns({f"c{n}z": F.col(f"c{n}z") + F.when(F.col("i") == 2, 3.25).otherwise(0.0) for n in range(8)} | {"permx": F.lit(1.0), "permy": F.lit(1.0)})
    out = c.fault_connections(grid)
    assert out.count() == 196 + 197
    top = lambda i, of: grid.where(f"i = {i}").select(F.lit(0).alias("g"), F.col("k").alias(of), F.col("c0z").alias("lo"), F.col("c4z").alias("hi"))
    met = overlapping(top(1, "a"), top(2, "b"), ["g"])
    plan = met._jdf.queryExecution()
    met.collect()
    join = [float(x) for x in looked_at(plan.executedPlan())]
    assert sum(join) < 5 * met.count() < 40_000 / 10


def looked_at(plan):
    """Rows that the joins of the executed plan put out, before their conditions count."""
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        yield from looked_at(plan.executedPlan())
        return
    if "QueryStage" in plan.nodeName():
        yield from looked_at(plan.plan())
        return
    if "Generate" in plan.nodeName():
        yield plan.metrics().apply("numOutputRows").value() / 2
    for k in range(plan.children().size()):
        yield from looked_at(plan.children().apply(k))
