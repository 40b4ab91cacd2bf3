"""Queries over corner-point cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraspan.functions.geometry import cell_index, linear_index, rounded
from terraspan.operators import cells as c
from terraspan.operators import connections as cn
from terraspan.plans.registry import Registry
from terraspan.sources.simulator import dual_order

R = Registry()
INC, ORI = (100.0, 80.0, 10.0), (1000.0, 2000.0, 1500.0)
#: Corner columns of the same cells in SQL: boxes, tilted a little, with a fault between columns 10 and 11.
_XYZ = [(f"1000e0 + (i - {1 - a}) * 100e0", f"2000e0 + (j - {1 - b}) * 80e0", f"1500e0 + (k - {1 - d}) * 10e0 + 0.5e0 * (i - {1 - a}) + 0.25e0 * (j - {1 - b}) + CASE WHEN i > 10 THEN 7e0 ELSE 0e0 END") for a, b, d in c.ENDS]
BOX = "box AS (SELECT *, " + ", ".join(f"{e} AS c{n}{x}" for n, xyz in enumerate(_XYZ) for e, x in zip(xyz, "xyz", strict=True)) + " FROM cells)"


def boxes(cells):
    """Cells with corners: level boxes, then tilted, with a fault."""
    own = c.with_box_corners(cells, ORI, INC)
    up = lambda n: F.col(f"c{n}z") + 0.5 * (F.col("i") - (1 - c.ENDS[n][0])) + 0.25 * (F.col("j") - (1 - c.ENDS[n][1])) + F.when(F.col("i") > 10, 7.0).otherwise(0.0)
    return own.withColumns({f"c{n}z": up(n) for n in range(8)})


def avg(*columns: str) -> str:
    return f"(({' + '.join(columns)}) / {len(columns)})"


TOP, BASE = avg(*(f"c{n}z" for n in range(4))), avg(*(f"c{n}z" for n in range(4, 8)))
CX, CY, CZ = (avg(*(f"c{n}{a}" for n in range(8))) for a in "xyz")


@R.query(f"WITH {BOX} SELECT i AS IX, j AS JY, k AS KZ, {CX} AS X_UTME, {CY} AS Y_UTMN, {CZ} AS Z_TVDSS, round(poro, 6) AS poro, zone FROM box WHERE actnum = 1", "cells")
def grid_table(cells):
    return c.table(boxes(cells), ["poro", "zone"]).withColumn("poro", rounded("poro"))


@R.query(f"WITH {BOX} SELECT actnum AS ACTNUM, i AS IX, j AS JY, k AS KZ, {CZ} AS Z_TVDSS, CASE WHEN actnum = 1 THEN round(poro, 6) END AS poro, CASE WHEN actnum = 1 THEN zone ELSE 0 END AS zone FROM box", "cells")
def grid_table_all(cells):
    return c.table(boxes(cells), ["poro", "zone"], False, ["zone"]).withColumn("poro", rounded("poro")).drop("X_UTME", "Y_UTMN")


@R.query("SELECT i, j, k, 100.0 AS dx, 80.0 AS dy, 10.0 AS dz, round(sqrt(10000 + 0.25), 6) AS dx_euclid, 0.25 AS dz_along_j FROM cells", "cells")
def grid_cell_sizes(cells):
    mean_z = c.mean(*(c.METRICS["z projection"](c.corner(a), c.corner(b)) for a, b in ((0, 3), (1, 2), (4, 7), (5, 6))))
    return boxes(cells).select("i", "j", "k", c.dx().alias("dx"), c.dy().alias("dy"), c.dz().alias("dz"), rounded(c.dx("euclid")).alias("dx_euclid"), mean_z.alias("dz_along_j"))


@R.query("SELECT i, j, k, 80000.0 AS volume, 80000.0 AS volume1, 80000.0 AS volume4 FROM cells WHERE actnum = 1", "cells")
def grid_bulk_volume(cells):
    return boxes(cells).where("actnum = 1").select("i", "j", "k", rounded(c.bulk_volume()).alias("volume"), rounded(c.bulk_volume(1)).alias("volume1"), rounded(c.bulk_volume(4)).alias("volume4"))


@R.query(f"""WITH {BOX}, v AS (SELECT *, CASE WHEN actnum = 1 THEN 80000.0 ELSE 0 END AS v, {TOP} AS t, {BASE} AS b FROM box)
SELECT i, j, k, round(greatest(0, least(b, 1520.0) - t) / (b - t) * v, 4) AS gas, round(greatest(0, least(b, 1540.0) - greatest(t, 1520.0)) / (b - t) * v, 4) AS oil, round(greatest(0, b - greatest(t, 1540.0)) / (b - t) * v, 4) AS water FROM v""", "cells")
def grid_phase_volumes(cells):
    return c.phase_volumes(boxes(cells), 1540.0, 1520.0).select("i", "j", "k", *(rounded(x, 4).alias(x) for x in ("gas", "oil", "water")))


@R.query("""SELECT i, j, k, round(degrees(acos(0.5 * 0.25 / (sqrt(10000.25) * sqrt(6400.0625)))), 5) AS lo, round(180 - degrees(acos(0.5 * 0.25 / (sqrt(10000.25) * sqrt(6400.0625)))), 5) AS hi, 90.0 AS proj, 0 AS bad FROM cells""", "cells")
def grid_quality(cells):
    q = c.quality(boxes(cells))
    return q.select("i", "j", "k", rounded("minangle_topbase", 5).alias("lo"), rounded("maxangle_topbase", 5).alias("hi"), rounded("maxangle_topbase_proj", 5).alias("proj"), (F.col("collapsed") + F.col("negative_thickness") + F.col("concave_proj")).alias("bad"))


@R.query("SELECT a.i, a.j, a.k, CASE WHEN EXISTS (SELECT 1 FROM cells b WHERE b.j = a.j AND b.k = a.k AND ((a.i = 10 AND b.i = 11) OR (a.i = 11 AND b.i = 10))) THEN 1 ELSE 0 END AS faulted FROM cells a", "cells")
def grid_faulted(cells):
    return c.faulted(boxes(cells)).select("i", "j", "k", "faulted")


@R.query(f"WITH {BOX} SELECT i, j, k, greatest(0, 1550.0 - {TOP}) AS htop, greatest(0, 1550.0 - {BASE}) AS hbot, greatest(0, 1550.0 - ({TOP} + {BASE}) / 2) AS hmid FROM box", "cells")
def grid_heights_above_ffl(cells):
    return c.heights_above(boxes(cells), F.lit(1550.0)).select("i", "j", "k", "htop", "hbot", "hmid")


@R.query(f"""WITH {BOX} SELECT i, j, k, n AS seq, CASE n % 4 WHEN 0 THEN c0x WHEN 1 THEN c1x WHEN 2 THEN c2x ELSE c3x END AS x, CASE n % 4 WHEN 0 THEN c0y WHEN 1 THEN c1y WHEN 2 THEN c2y ELSE c3y END AS y, CASE n % 4 WHEN 0 THEN c0z WHEN 1 THEN c1z WHEN 2 THEN c2z ELSE c3z END AS z
FROM box, (SELECT cast(r AS int) AS n FROM range(5) t(r)) WHERE k = 3 AND actnum = 1""", "cells")
def grid_layer_slice(cells):
    return c.layer_outline(boxes(cells), 3)


@R.query(f"""WITH {BOX}, o AS (SELECT *, {CX} AS x, {CY} AS y, {CZ} AS z FROM box WHERE actnum = 1) SELECT arg_min(x, (k, j, i)) AS xori, arg_min(y, (k, j, i)) AS yori, arg_min(z, (k, j, i)) AS zori, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax,
100.0 AS avg_dx, 80.0 AS avg_dy, 10.0 AS avg_dz, 0.0 AS avg_rotation, true AS regular FROM o""", "cells")
def grid_geometrics(cells):
    return c.geometrics(boxes(cells))


@R.query("SELECT i, j, k, actnum FROM cells WHERE false UNION ALL SELECT i, j, k, CASE WHEN (i + j) % 5 = 0 THEN 0 ELSE actnum END FROM cells", "cells")
def grid_inactivate_by_dz(cells):
    thin = boxes(cells)
    for n in range(4):  # some cells are made thin
        thin = thin.withColumn(f"c{n + 4}z", F.when((F.col("i") + F.col("j")) % 5 == 0, F.col(f"c{n}z") + 0.5).otherwise(F.col(f"c{n + 4}z")))
    return c.inactivate_by_dz(thin, 1.0).select("i", "j", "k", "actnum")


@R.query(f"""WITH {BOX}, o AS (SELECT *, {CX} AS x, {CY} AS y FROM box), t AS (SELECT poly_id, seq, 2 * x + 900 AS x, 2 * y + 1900 AS y FROM polygons), e AS (SELECT poly_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM t WINDOW w AS (PARTITION BY poly_id ORDER BY seq)),
h AS (SELECT DISTINCT i, j, k FROM (SELECT i, j, k, poly_id FROM o, e WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY i, j, k, poly_id HAVING count(*) % 2 = 1))
SELECT i, j, k, CASE WHEN k BETWEEN 2 AND 5 AND EXISTS (SELECT 1 FROM h WHERE h.i = o.i AND h.j = o.j AND h.k = o.k) THEN 0 ELSE actnum END AS actnum FROM o""", "cells", "polygons")
def grid_inactivate_inside(cells, polygons):
    moved = polygons.withColumns({"x": 2 * F.col("x") + 900, "y": 2 * F.col("y") + 1900})
    return c.inactivate(boxes(cells), moved, (2, 5)).select("i", "j", "k", "actnum")


@R.query("SELECT i - 4 AS i, j - 2 AS j, k - 1 AS k, actnum, round(poro, 6) AS poro FROM cells WHERE i BETWEEN 5 AND 12 AND j BETWEEN 3 AND 15 AND k BETWEEN 2 AND 6", "cells")
def grid_crop(cells):
    return c.crop(cells, (5, 12), (3, 15), (2, 6)).select("i", "j", "k", "actnum", rounded("poro").alias("poro"))


@R.query(f"WITH {BOX} SELECT 21 - i AS i, j, k, c1x AS c0x, c0x AS c1x, c3z AS c2z, c2z AS c3z, c6y AS c7y FROM box", "cells")
def grid_reverse_columns(cells):
    return c.reverse(boxes(cells), "i", 20).select("i", "j", "k", "c0x", "c1x", "c2z", "c3z", "c7y")


@R.query(f"WITH {BOX} SELECT i, j, k, round(c0x * 3.28084, 6) AS x, round(c6z * 3.28084, 6) AS z FROM box", "cells")
def grid_convert_units(cells):
    return c.scale(boxes(cells), 3.28084).select("i", "j", "k", rounded("c0x").alias("x"), rounded("c6z").alias("z"))


@R.query(f"WITH {BOX} SELECT i, j, k, round((c2x - 1000) * cos(radians(30)) - (c2y - 2000) * sin(radians(30)) + 1000 + 5, 6) AS x, round((c2x - 1000) * sin(radians(30)) + (c2y - 2000) * cos(radians(30)) + 2000 - 5, 6) AS y, 9 - c2z AS z FROM box", "cells")
def grid_translate(cells):
    return c.translate(boxes(cells), (5, -5, 9), 30.0, (1000, 2000), True).select("i", "j", "k", rounded("c2x").alias("x"), rounded("c2y").alias("y"), F.col("c2z").alias("z"))


@R.query(f"""WITH {BOX} SELECT cast((i - 1) * 2 + a + 1 AS int) AS i, j, cast((k - 1) * 2 + d + 1 AS int) AS k, round(c0x + a * 50.0, 6) AS c0x, round(c0x + (a + 1) * 50.0, 6) AS c1x, round(c0z + a * 0.25 + d * 5.0, 6) AS c0z, round(c0z + (a + 1) * 0.25 + (d + 1) * 5.0 + 0.25, 6) AS c6z, zone
FROM box, range(2) t(a), range(2) u(d)""", "cells")
def grid_refine(cells):
    return c.refine(boxes(cells), 2, 1, 2).select(*(F.col(x).cast("int").alias(x) for x in c.IJK), *(rounded(x).alias(x) for x in ("c0x", "c1x", "c0z", "c6z")), "zone")


@R.query(f"""WITH {BOX}, f AS (SELECT *, CASE zone WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS f, CASE WHEN k <= 2 THEN (k - 1) * 3 WHEN k <= 5 THEN 6 + (k - 3) * 2 ELSE 12 + (k - 6) END AS b FROM box)
SELECT i, j, cast(b + d + 1 AS int) AS k, round(c0z + 10.0 * d / f, 6) AS c0z, round(c0z + 10.0 * (d + 1) / f, 6) AS c4z, zone FROM f, range(3) t(d) WHERE d < f""", "cells")
def grid_refine_vertically(cells):
    return c.refine_vertically(boxes(cells), {1: 3, 2: 2}, "zone").select("i", "j", "k", rounded("c0z").alias("c0z"), rounded("c4z").alias("c4z"), "zone")


@R.query("SELECT i, j, k, actnum, round(poro, 6) AS poro, CAST(NULL AS DOUBLE) AS perm FROM cells WHERE i <= 10 UNION ALL SELECT i + 1, j, k, actnum, NULL, round(perm, 6) FROM cells WHERE i > 10", "cells")
def grid_merge(cells):
    left = cells.where("i <= 10").select("i", "j", "k", "actnum", rounded("poro").alias("poro"))
    right = cells.where("i > 10").select((F.col("i") - 10).alias("i"), "j", "k", "actnum", rounded("perm").alias("perm"))
    return c.merge(left, right, 10)


@R.query("""WITH m AS (SELECT i, j, k, actnum, poro FROM cells WHERE i <= 10 UNION ALL SELECT i + 1, j, k, actnum, NULL FROM cells WHERE i > 10), x AS (SELECT max(i) AS ni, max(j) AS nj, max(k) AS nk FROM m),
b AS (SELECT cast(i AS int) AS i, cast(j AS int) AS j, cast(k AS int) AS k FROM (SELECT unnest(range(1, ni + 1)) AS i FROM x) p, (SELECT unnest(range(1, nj + 1)) AS j FROM x) q, (SELECT unnest(range(1, nk + 1)) AS k FROM x) r)
SELECT b.i, b.j, b.k, coalesce(actnum, 0) AS actnum, round(poro, 6) AS poro FROM b LEFT JOIN m ON m.i = b.i AND m.j = b.j AND m.k = b.k""", "cells")
def grid_merge_filled(cells):
    """The two halves of grid_merge() with a cell at every place, also between them."""
    own = boxes(cells).drop("perm", "zone")
    out = c.merge(own.where("i <= 10"), own.where("i > 10").withColumn("i", F.col("i") - 10).drop("poro"), 10)
    size = out.agg(*(F.max(a) for a in "ijk")).first()
    return c.rectangular(out, tuple(size)).select("i", "j", "k", "actnum", rounded("poro").alias("poro"))


@R.query("""WITH d AS (SELECT i, j, k, (i + 2 * j + 3 * k) % 4 AS a FROM cells), m AS (SELECT 'matrix' AS medium, i, j, k, row_number() OVER (ORDER BY k, j, i) - 1 AS pos FROM d WHERE a IN (1, 3)), f AS (SELECT 'fracture' AS medium, i, j, k, row_number() OVER (ORDER BY k, j, i) - 1 + (SELECT count(*) FROM m) AS pos FROM d WHERE a IN (2, 3))
SELECT * FROM m UNION ALL SELECT * FROM f""", "cells")
def grid_dual_order(cells):
    """Places of the cells of both media in a dual-porosity run's records."""
    return dual_order(cells.withColumn("actnum", (F.col("i") + 2 * F.col("j") + 3 * F.col("k")) % 4))


@R.query(f"WITH {BOX} SELECT i, j, 1 AS k, max(actnum) AS actnum, arg_min(c0z, k) AS c0z, arg_max(c6z, k) AS c6z FROM box GROUP BY i, j", "cells")
def grid_reduce_to_one_layer(cells):
    return c.reduce_to_one_layer(boxes(cells)).select("i", "j", "k", "actnum", "c0z", "c6z")


@R.query(f"""WITH {BOX}, u AS (SELECT *, last_value(CASE WHEN actnum = 1 THEN c4z END IGNORE NULLS) OVER a AS up, first_value(CASE WHEN actnum = 1 THEN c0z END IGNORE NULLS) OVER b AS dn FROM box WINDOW a AS (PARTITION BY i, j ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY i, j ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT i, j, k, CASE WHEN actnum = 1 THEN c0z ELSE coalesce(up, dn, c0z) END AS c0z, CASE WHEN actnum = 1 THEN c4z ELSE coalesce(up, dn, c4z) END AS c4z FROM u""", "cells")
def grid_collapse_inactive(cells):
    return c.collapse_inactive(boxes(cells)).select("i", "j", "k", "c0z", "c4z")


@R.query(f"""WITH {BOX}, t AS (SELECT i, j, k, 2 * k - 2 AS n, c0z - CASE WHEN k % 3 = 0 THEN 15.0 ELSE 0.0 END AS z FROM box UNION ALL SELECT i, j, k, 2 * k - 1, c4z FROM box), m AS (SELECT *, max(z - n * 0.5) OVER (PARTITION BY i, j ORDER BY n ROWS UNBOUNDED PRECEDING) + n * 0.5 AS zz FROM t)
SELECT i, j, k, max(CASE WHEN n % 2 = 0 THEN zz END) AS c0z, max(CASE WHEN n % 2 = 1 THEN zz END) AS c4z FROM m GROUP BY i, j, k""", "cells")
def grid_make_z_consistent(cells):
    bad = boxes(cells)
    for n in range(4):
        bad = bad.withColumn(f"c{n}z", F.col(f"c{n}z") - F.when(F.col("k") % 3 == 0, 15.0).otherwise(0.0))
    return c.make_z_consistent(bad, 0.5).select("i", "j", "k", "c0z", "c4z")


@R.query("SELECT zone, min(k) AS kmin, max(k) AS kmax FROM cells GROUP BY zone", "cells")
def grid_subgrids(cells):
    return c.subgrids(cells)


@R.query("SELECT i, j, k, zone FROM cells", "cells")
def grid_zoneprop_from_subgrids(cells):
    return c.zones_of(cells.drop("zone"), c.subgrids(cells)).select("i", "j", "k", "zone")


@R.query("SELECT zone, CASE WHEN max(n) = 1 THEN 'X' ELSE 'P' END AS design, 10.0 AS dzsim FROM (SELECT zone, i, j, count(*) AS n, sum(10.0) AS s FROM cells GROUP BY zone, i, j QUALIFY row_number() OVER (PARTITION BY zone ORDER BY s, i, j) = floor((count(*) OVER (PARTITION BY zone) + 1) / 2)) GROUP BY zone", "cells")
def grid_estimate_design(cells):
    return c.design(boxes(cells)).withColumn("dzsim", rounded("dzsim"))


@R.query("SELECT w.well, w.seq, w.i, w.j, w.k, round(poro, 6) AS poro FROM (SELECT well, seq, cast(seq % 25 AS int) AS i, cast(seq % 21 AS int) AS j, cast(seq % 8 AS int) AS k FROM wells) w LEFT JOIN (SELECT * FROM cells WHERE actnum = 1) c USING (i, j, k)", "wells", "cells")
def grid_values_by_ijk(samples, cells):
    places = samples.select("well", "seq", *((F.col("seq") % n).alias(a) for a, n in zip(c.IJK, (25, 21, 8), strict=True)))
    return c.lookup(places, cells, ["poro"]).select("well", "seq", "i", "j", "k", rounded("poro").alias("poro"))


@R.query("""WITH a AS (SELECT * FROM cells WHERE actnum = 1) SELECT a.i, a.j, a.k, max(CASE WHEN b.i IS NULL THEN 0 WHEN least(a.i, b.i) = 10 AND a.i <> b.i THEN 2 ELSE 1 END) AS flag FROM a LEFT JOIN a b ON b.zone = 2 AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1 WHERE a.zone = 1 GROUP BY a.i, a.j, a.k""", "cells")
def grid_adjacent_cells(cells):
    return c.adjacent(boxes(cells), "zone", 1, 2)


@R.query("""WITH a AS (SELECT * FROM (SELECT *, CASE WHEN (i + j) % 3 = 0 THEN 1 ELSE 2 END AS reg FROM cells) r WHERE actnum = 1) SELECT a.i, a.j, a.k, max(CASE WHEN b.i IS NULL THEN 0 WHEN least(a.i, b.i) = 10 AND a.i <> b.i THEN 2 ELSE 1 END) AS flag FROM a LEFT JOIN a b ON b.reg = 2 AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1 WHERE a.reg = 1 GROUP BY a.i, a.j, a.k""", "cells")
def grid_adjacent_regions(cells):
    return c.adjacent(boxes(cells).withColumn("reg", F.when((F.col("i") + F.col("j")) % 3 == 0, 1).otherwise(2)), "reg", 1, 2)


from terraspan.plans.surfaces import bilinear_sql  # noqa: E402
from terraspan.plans.views import MAP  # noqa: E402


@R.query(f"WITH {BOX}, {bilinear_sql(f'SELECT i, j, k, {CX} AS x, {CY} AS y, {CZ} AS z FROM box', 'p4.i, p4.j, p4.k, z', 'r').replace('SELECT p4.i, p4.j, p4.k, z', 'SELECT p4.i, p4.j, p4.k, p4.z')} SELECT i, j, k, CASE WHEN z BETWEEN sampled - 30 AND sampled + 10 THEN 1.0 ELSE 0.0 END AS between_surfaces FROM r", "cells", "depths")
def grid_between_surfaces(cells, nodes):
    shifted = lambda d: nodes.withColumn("value", F.col("value") + d)
    return c.between_surfaces(boxes(cells), shifted(-30.0), shifted(10.0), MAP).select("i", "j", "k", "between_surfaces")


_DIM, _O, _I = (20, 20, 10), (1000.0, 2000.0, 1500.0), (20.0, 25.0, 15.0)
_INDEX = "cast(least(floor((x - 1000.0) / 20), 19) + 1 AS int) AS i, cast(least(floor((y - 2000.0) / 25), 19) + 1 AS int) AS j, cast(least(floor((z - 1500.0) / 15), 9) + 1 AS int) AS k"
_INSIDE = "x BETWEEN 1000.0 AND 1400.0 AND y BETWEEN 2000.0 AND 2500.0 AND z BETWEEN 1500.0 AND 1650.0"


@R.query(f"SELECT well, seq, CASE WHEN ok THEN i END AS i, CASE WHEN ok THEN j END AS j, CASE WHEN ok THEN k END AS k FROM (SELECT well, seq, {_INSIDE} AS ok, {_INDEX} FROM wells) q", "wells")
def well_ijk_from_box_grid(samples):
    return c.box_index(samples, _DIM, _O, _I).select("well", "seq", "i", "j", "k")


@R.query(f"""WITH {BOX} SELECT well, seq, i, j, k FROM (SELECT well, seq, x + 3.125 AS x, y + 3.125 AS y, z - 30.0625 AS z FROM wells) p LEFT JOIN box b ON actnum = 1 AND x > c0x AND x < c1x AND y > c0y AND y < c3y
 AND z > c0z + 0.5 * (x - c0x) / 100 + 0.25 * (y - c0y) / 80 AND z < c4z + 0.5 * (x - c0x) / 100 + 0.25 * (y - c0y) / 80""", "wells", "cells")
def points_in_cells(samples, cells):
    own = samples.select(F.struct("well", "seq").alias("pid"), (F.col("x") + 3.125).alias("x"), (F.col("y") + 3.125).alias("y"), (F.col("z") - 30.0625).alias("z"))
    return c.points_in_cells(own, boxes(cells), 100.0).select("pid.*", "i", "j", "k")


def _path_sql(cells: str, sides: list[tuple[str, str]]) -> str:
    """Which parts of each segment are in which cells, by the sides' distances at both ends; then neighbouring pieces in a cell as one."""
    first = ", ".join(f"CASE WHEN {b} > {a} THEN -({a}) / (({b}) - ({a})) ELSE 0 END" for a, b in sides)
    last = ", ".join(f"CASE WHEN {b} < {a} THEN ({a}) / (({a}) - ({b})) ELSE 1 END" for a, b in sides)
    out = " OR ".join(f"({a} = {b} AND {a} < 0)" for a, b in sides)
    return f"""sg AS (SELECT well, seq, x + 3.125 AS x1, y + 3.125 AS y1, z - 30.0625 AS z1, md AS m1, lead(x + 3.125) OVER o AS x2, lead(y + 3.125) OVER o AS y2, lead(z - 30.0625) OVER o AS z2, lead(md) OVER o AS m2 FROM wells WINDOW o AS (PARTITION BY well ORDER BY seq)),
pc AS (SELECT well, seq, i, j, k, greatest(0, {first}) AS t1, least(1, {last}) AS t2, m1, m2 FROM sg JOIN {cells} WHERE x2 IS NOT NULL AND NOT ({out})),
pm AS (SELECT well, seq, i, j, k, t1, m1 + t1 * (m2 - m1) AS md_in, m1 + t2 * (m2 - m1) AS md_out FROM pc WHERE t2 - t1 > 1e-12),
pn AS (SELECT *, CASE WHEN i = lag(i) OVER o AND j = lag(j) OVER o AND k = lag(k) OVER o AND abs(md_in - lag(md_out) OVER o) < 1e-9 THEN 0 ELSE 1 END AS new FROM pm WINDOW o AS (PARTITION BY well ORDER BY seq, t1)),
pv AS (SELECT *, cast(sum(new) OVER (PARTITION BY well ORDER BY seq, t1 ROWS UNBOUNDED PRECEDING) AS int) AS visit FROM pn)
SELECT well, visit, i, j, k, round(min(md_in), 6) AS md_in, round(max(md_out), 6) AS md_out, round(max(md_out) - min(md_in), 6) AS length_md FROM pv GROUP BY well, visit, i, j, k"""


def _moved(samples):
    """Paths that don't run along the sides of cells."""
    return samples.withColumns({"x": F.col("x") + 3.125, "y": F.col("y") + 3.125, "z": F.col("z") - 30.0625})


def _path(out):
    return out.select("well", "visit", "i", "j", "k", *(rounded(x).alias(x) for x in ("md_in", "md_out", "length_md")))


_BOXES = "(SELECT cast(a.i AS int) AS i, cast(b.j AS int) AS j, cast(d.k AS int) AS k, 1000.0 + (a.i - 1) * 20.0 AS xl, 2000.0 + (b.j - 1) * 25.0 AS yl, 1500.0 + (d.k - 1) * 15.0 AS zl FROM range(1, 21) a(i), range(1, 21) b(j), range(1, 11) d(k)) bx ON x1 < 1440 AND x2 > 960"
_BOX_SIDES = [(f"{a}1 - {a}l", f"{a}2 - {a}l") for a in "xyz"] + [(f"{a}l + {n} - {a}1", f"{a}l + {n} - {a}2") for a, n in zip("xyz", (20.0, 25.0, 15.0), strict=True)]


@R.query(f"WITH {_path_sql(_BOXES, _BOX_SIDES)}", "wells")
def well_cell_intersections(samples):
    return _path(c.trajectory_cells(_moved(samples), _DIM, _O, _I))


def _above(n: int, e: int) -> str:
    """How far the segment's end lies below a cell's tilted top (0) or base (4)."""
    return f"z{e} - (c{n}z + 0.5 * (x{e} - c0x) / 100 + 0.25 * (y{e} - c0y) / 80)"


_TILTED = [("x1 - c0x", "x2 - c0x"), ("c1x - x1", "c1x - x2"), ("y1 - c0y", "y2 - c0y"), ("c3y - y1", "c3y - y2"), (_above(0, 1), _above(0, 2)), (f"-({_above(4, 1)})", f"-({_above(4, 2)})")]


@R.query(f"WITH {BOX}, {_path_sql('(SELECT * FROM box WHERE actnum = 1) bx ON least(x1, x2) <= c1x AND greatest(x1, x2) >= c0x AND least(y1, y2) <= c3y AND greatest(y1, y2) >= c0y', _TILTED)}", "wells", "cells")
def well_intersections_of_corner_cells(samples, cells):
    return _path(c.trajectory_in_cells(_moved(samples), boxes(cells), 100.0))


_CENTRES = f"o AS (SELECT *, {CX} AS x, {CY} AS y FROM box), t AS (SELECT poly_id, seq, 2 * x + 900 AS x, 2 * y + 1900 AS y FROM polygons), e AS (SELECT poly_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM t WINDOW w AS (PARTITION BY poly_id ORDER BY seq))"


def _outline(polygons):
    return polygons.withColumns({"x": 2 * F.col("x") + 900, "y": 2 * F.col("y") + 1900})


for _op, _sql, _inside in (("add", "poro + 5.0", True), ("set", "5.0", False), ("mul", "poro * 5.0", True), ("div", "poro / 5.0", False), ("sub", "poro - 5.0", True)):

    def _operated(cells, polygons, op=_op, inside=_inside):
        return c.operate(boxes(cells), _outline(polygons), "poro", op, 5.0, inside).select("i", "j", "k", rounded("poro").alias("poro"))

    _operated.__name__ = f"grid_property_{_op}_{'inside' if _inside else 'outside'}"
    R.query(f"""WITH {BOX}, {_CENTRES}, h AS (SELECT DISTINCT i, j, k FROM (SELECT i, j, k, poly_id FROM o, e WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY i, j, k, poly_id HAVING count(*) % 2 = 1))
SELECT o.i, o.j, o.k, round(CASE WHEN (h.i IS {'NOT ' if _inside else ''}NULL) THEN {_sql} ELSE poro END, 6) AS poro FROM o LEFT JOIN h ON h.i = o.i AND h.j = o.j AND h.k = o.k""", "cells", "polygons")(_operated)


@R.query(f"""WITH {BOX}, u AS (SELECT box.*, c0x + 100.0 * (a + 0.5) / 3 AS x, c0y + 80.0 * (b + 0.5) / 3 AS y, c0z + 0.5 * (a + 0.5) / 3 + 0.25 * (b + 0.5) / 3 + 5.0 * d AS t FROM box, range(3) ra(a), range(3) rb(b), range(2) rd(d) WHERE actnum = 1),
tt AS (SELECT poly_id, seq, 2 * x + 900 AS x, 2 * y + 1900 AS y FROM polygons), e AS (SELECT poly_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM tt WINDOW w AS (PARTITION BY poly_id ORDER BY seq)),
xy AS (SELECT DISTINCT x, y FROM u), h AS (SELECT DISTINCT x, y FROM (SELECT x, y, poly_id FROM xy, e WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY x, y, poly_id HAVING count(*) % 2 = 1))
SELECT i, j, k, round(sum(CASE WHEN h.x IS NULL THEN 0 ELSE 80000.0 / 18 * greatest(0, least(t + 5, 1520.0) - t) / 5 END), 3) AS gas, round(sum(CASE WHEN h.x IS NULL THEN 0 ELSE 80000.0 / 18 * greatest(0, least(t + 5, 1540.0) - greatest(t, 1520.0)) / 5 END), 3) AS oil,
 round(sum(CASE WHEN h.x IS NULL THEN 0 ELSE 80000.0 / 18 * greatest(0, t + 5 - greatest(t, 1540.0)) / 5 END), 3) AS water FROM u LEFT JOIN h USING (x, y) GROUP BY i, j, k""", "cells", "polygons")
def grid_phase_volumes_in_boundary(cells, polygons):
    out = c.phase_volumes_in_parts(boxes(cells), 1540.0, 1520.0, _outline(polygons), (3, 3, 2))
    return out.select("i", "j", "k", *(rounded(x, 3).alias(x) for x in ("gas", "oil", "water")))


@R.query("SELECT i, j, cast(k + 1 AS int) AS k, actnum FROM cells WHERE i <= 10 AND k <= 3 UNION ALL SELECT i + 1, j, cast(CASE k WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 6 END AS int), actnum FROM cells WHERE i > 10 AND k <= 3", "cells")
def grid_merge_with_layer_maps(cells):
    left, right = cells.where("i <= 10 and k <= 3"), cells.where("i > 10 and k <= 3").withColumn("i", F.col("i") - 10)
    return c.merge(left, right, 10, [2, 3, 4], [1, 3, 6]).select("i", "j", "k", "actnum")


_D = c.DARCY["metric"]


@R.query(f"""WITH {BOX}, a AS (SELECT i, j, k, perm, {TOP} AS t, {BASE} AS b FROM box WHERE actnum = 1),
n AS (SELECT a.*, x.perm AS px, x.t AS tx, x.b AS bx, y.perm AS py, y.t AS ty, y.b AS by_, z.perm AS pz FROM a LEFT JOIN a x ON x.i = a.i + 1 AND x.j = a.j AND x.k = a.k LEFT JOIN a y ON y.i = a.i AND y.j = a.j + 1 AND y.k = a.k LEFT JOIN a z ON z.i = a.i AND z.j = a.j AND z.k = a.k + 1),
h AS (SELECT *, 80.0 * CASE WHEN i = 10 THEN 3.0 ELSE 10.0 END / 50 AS ax, 100.0 * 10 / 40 AS ay, 8000.0 / 5 AS az FROM n)
SELECT i, j, k, round(coalesce({_D!r} * ax * perm * px / nullif(perm + px, 0), 0), 6) AS tranx, round(coalesce({_D!r} * ay * perm * py / nullif(perm + py, 0), 0), 6) AS trany, round(coalesce({_D!r} * az * 0.1 * perm * pz / nullif(perm + pz, 0), 0), 6) AS tranz FROM h""", "cells")
def grid_transmissibilities(cells):
    own = boxes(cells).withColumns({"permx": F.col("perm"), "permy": F.col("perm"), "permz": F.col("perm") * 0.1})
    return c.transmissibilities(own).select("i", "j", "k", *(rounded(x).alias(x) for x in ("tranx", "trany", "tranz")))


@R.query(f"""WITH a AS (SELECT i, j, k, perm, lead(k) OVER o AS k2, lead(perm) OVER o AS p2 FROM cells WHERE actnum = 1 WINDOW o AS (PARTITION BY i, j ORDER BY k))
SELECT i, j, k AS k1, k2, round({_D!r} * 1600 * perm * p2 / (perm + p2), 6) AS tran FROM a WHERE k2 > k + 1""", "cells")
def grid_nnc_pinchouts(cells):
    return c.pinchout_connections(boxes(cells), "perm").withColumn("tran", rounded("tran"))


@R.query(f"""WITH {BOX}, a AS (SELECT i, j, k, perm, {TOP} AS t, {BASE} AS b FROM box WHERE actnum = 1)
SELECT 'i' AS axis, a.i, a.j, a.k AS k1, x.k AS k2, round({_D!r} * 80.0 / 50 * 7.0 * a.perm * x.perm / (a.perm + x.perm), 9) AS tran FROM a JOIN a x ON a.i = 10 AND x.i = 11 AND x.j = a.j AND x.k = a.k - 1""", "cells")
def grid_nnc_faults(cells):
    return c.fault_connections(boxes(cells), ("perm", "perm")).withColumn("tran", rounded("tran", 9))


@R.query("SELECT i, j, round(avg(poro), 9) AS value FROM cells WHERE actnum = 1 AND zone BETWEEN 1 AND 2 AND poro > 0.03 GROUP BY i, j", "cells")
def grid_average_map(cells):
    return c.average_map(boxes(cells), "poro", (1, 2), truncate_le=0.03).withColumn("value", rounded("value", 9))


@R.query("SELECT i, j, round(sum(poro * 10), 6) AS value FROM cells WHERE actnum = 1 GROUP BY i, j", "cells")
def grid_hc_thickness_map(cells):
    return c.thickness_map(boxes(cells).withColumn("hc", F.col("poro") * c.dz()), "hc").withColumn("value", rounded("value"))


@R.query(f"""WITH {BOX}, u AS (SELECT i, j, k, least(c0z, 1530.0) AS z0, least(c4z, 1530.0) AS z4 FROM box), l AS (SELECT i, j, k + 11 AS k, greatest(c0z, 1550.0) AS z0, greatest(c4z, 1550.0) AS z4 FROM box), o AS (SELECT i, j, arg_min(c0z, k) AS t, arg_max(c4z, k) AS b FROM box GROUP BY i, j),
m AS (SELECT i, j, cast(n + 7 AS int) AS k, greatest(t, least(b, 1530.0 + 5.0 * (n - 1))) AS z0, greatest(t, least(b, 1530.0 + 5.0 * n)) AS z4 FROM o, range(1, 5) r(n)) SELECT * FROM u UNION ALL SELECT * FROM l UNION ALL SELECT * FROM m""", "cells")
def grid_hybrid(cells):
    return c.hybrid(boxes(cells), 4, 1530.0, 1550.0, 7).select("i", "j", "k", F.col("c0z").alias("z0"), F.col("c4z").alias("z4"))


@R.query("SELECT i, j, k, cast(round_even(perm, 0) AS int) AS discrete, CASE WHEN k = 3 THEN NULL ELSE poro END AS masked FROM cells", "cells")
def grid_property_types(cells):
    raw = F.when(F.col("k") == 3, 1e33).otherwise(F.col("poro"))
    return cells.select("i", "j", "k", c.to_discrete(F.col("perm")).alias("discrete"), c.mask_undefined(raw).alias("masked"))


@R.query("SELECT count(poro) AS n, round(min(poro), 6) AS min, round(avg(poro), 6) AS mean, round(max(poro), 6) AS max, round(stddev_pop(poro), 6) AS std FROM cells WHERE actnum = 1", "cells")
def grid_property_describe(cells):
    return c.describe(cells, "poro").select("n", *(rounded(x).alias(x) for x in ("min", "mean", "max", "std")))


@R.query("SELECT i, j, k, cast((k - 1) * 400 + (j - 1) * 20 + i - 1 AS bigint) AS ib, i AS i2, j AS j2, k AS k2 FROM cells", "cells")
def calc_linear_index(cells):
    own = cells.withColumn("ib", linear_index(F.col("i"), F.col("j"), F.col("k"), 20, 20))
    i, j, k = cell_index(F.col("ib"), 20, 20)
    return own.select("i", "j", "k", "ib", i.alias("i2"), j.alias("j2"), k.alias("k2"))


from terraspan.functions.geometry import MapHeader  # noqa: E402
from terraspan.operators import surfaces as s_  # noqa: E402

#: A map of cell corners' size, whose nodes lie within cells.
FINE = MapHeader(30, 25, 1013.0, 2017.0, 61.0, 55.0)
_NODES = f"nd AS (SELECT cast(a.i AS int) AS ni, cast(b.j AS int) AS nj, 1013.0 + 61.0 * (a.i - 1) AS x, 2017.0 + 55.0 * (b.j - 1) AS y FROM range(1, {FINE.ncol + 1}) a(i), range(1, {FINE.nrow + 1}) b(j))"


def _on(alias: str) -> str:
    return f"x >= {alias}.c0x AND x < {alias}.c1x AND y >= {alias}.c0y AND y < {alias}.c3y"


@R.query(f"""WITH {BOX}, {_NODES}, t AS (SELECT i, j, min(k) AS k FROM box WHERE actnum = 1 GROUP BY i, j), o AS (SELECT box.* FROM box JOIN t USING (i, j, k))
SELECT ni AS i, nj AS j, round(c0z + 0.5 * (x - c0x) / 100 + 0.25 * (y - c0y) / 80, 6) AS value FROM nd JOIN o ON {_on('o')}""", "cells")
def grid_to_surface_top(cells):
    return c.layer_map(boxes(cells), FINE).withColumn("value", rounded("value"))


@R.query(f"WITH {BOX}, {_NODES} SELECT ni AS i, nj AS j, round(poro, 6) AS value FROM nd JOIN box ON actnum = 1 AND k = 3 AND {_on('box')}", "cells")
def grid_to_surface_property(cells):
    return c.layer_map(boxes(cells), FINE, 3, "poro").withColumn("value", rounded("value"))


@R.query(f"""WITH {BOX}, {_NODES}, q AS (SELECT *, 1520.03125 + 0.0625 * ni AS z FROM nd) SELECT ni AS i, nj AS j, round(poro, 6) AS value FROM q LEFT JOIN box ON actnum = 1 AND {_on('box')}
 AND z > c0z + 0.5 * (x - c0x) / 100 + 0.25 * (y - c0y) / 80 AND z < c4z + 0.5 * (x - c0x) / 100 + 0.25 * (y - c0y) / 80""", "cells")
def grid_slice_surface(cells):
    nodes = s_.lattice(cells.sparkSession, FINE).withColumn("value", 1520.03125 + 0.0625 * F.col("i"))
    return c.slice_surface(nodes, FINE, boxes(cells), "poro", 100.0).withColumn("value", rounded("value"))


from terraspan.plans.polygons import _FENCE  # noqa: E402


@R.query(f"""WITH {BOX}, {_FENCE}, pl AS (SELECT poly_id, seq, h, x + 3.125 AS x, y + 3.125 AS y, 1500.0 + 5.0 * n AS z FROM fn, range(13) r(n))
SELECT poly_id, seq, round(h, 6) + 0.0 AS h, z, round(poro, 6) AS value FROM pl LEFT JOIN box ON actnum = 1 AND {_on('box')}
 AND z > c0z + 0.5 * (x - c0x) / 100 + 0.25 * (y - c0y) / 80 AND z < c4z + 0.5 * (x - c0x) / 100 + 0.25 * (y - c0y) / 80""", "cells", "fence")
def grid_randomline(cells, fence):
    from terraspan.operators.polygons import fence as fence_of

    places = fence_of(fence, 60.0).withColumns({"x": F.col("x") + 3.125, "y": F.col("y") + 3.125})
    out = c.random_line(places, boxes(cells), "poro", 1500.0, 1560.0, 5.0, 100.0)
    return out.select("poly_id", "seq", rounded("h").alias("h"), "z", rounded("value").alias("value"))


_PILLARS = "SELECT cast(a.i AS int) AS i, cast(b.j AS int) AS j, 1300.0 + (a.i - 1) * 50.0 * cos(radians(30)) - (b.j - 1) * 40.0 * sin(radians(30)) AS x, 2400.0 + (a.i - 1) * 50.0 * sin(radians(30)) + (b.j - 1) * 40.0 * cos(radians(30)) AS y FROM range(1, 10) a(i), range(1, 8) b(j)"


@R.query(f"""WITH {bilinear_sql(_PILLARS, 'i, j', 'r')}, s AS (SELECT i, j, sampled, sampled IS NULL AS miss FROM r)
SELECT a.i, a.j, cast(l.k AS int) AS k, CASE WHEN a.miss OR b.miss OR c.miss OR d.miss THEN 0 ELSE 1 END AS actnum, round(coalesce(a.sampled + 10.0 * (l.k - 1), 1000.0), 6) AS c0z, round(coalesce(d.sampled + 10.0 * (l.k - 1), 1000.0), 6) AS c2z, round(coalesce(d.sampled + 10.0 * l.k, 1000.0), 6) AS c6z
FROM s a JOIN s b ON b.i = a.i + 1 AND b.j = a.j JOIN s c ON c.i = a.i AND c.j = a.j + 1 JOIN s d ON d.i = a.i + 1 AND d.j = a.j + 1, range(1, 4) l(k)""", "depths")
def grid_from_surfaces(nodes):
    stack = [nodes.withColumn("value", F.col("value") + 10.0 * n) for n in range(4)]
    out = c.from_surfaces(stack, MAP, (8, 6), (1300.0, 2400.0), (50.0, 40.0), 30.0)
    return out.select("i", "j", "k", "actnum", *(rounded(x).alias(x) for x in ("c0z", "c2z", "c6z")))


_COLUMNS = "SELECT i, j, 1000.0 + (i - 1) * 100.0 AS x, 2000.0 + (j - 1) * 80.0 AS y FROM (SELECT DISTINCT i, j FROM cells)"


@R.query(f"""WITH {bilinear_sql(_COLUMNS, 'i, j', 'r')}, t AS (SELECT i, j, sampled, 1500.0 + 0.5 * (i - 1) + 0.25 * (j - 1) + CASE WHEN i > 10 THEN 7.0 ELSE 0.0 END AS t FROM r),
z AS (SELECT i, j, cast(l.k AS int) AS k, CASE WHEN l.k <= 2 THEN coalesce(sampled, t) ELSE coalesce(sampled + 15.0, t + 20.0) END AS hi, CASE WHEN l.k <= 2 THEN coalesce(sampled + 15.0, t + 20.0) ELSE coalesce(sampled + 60.0, t + 70.0) END AS lo, CASE WHEN l.k <= 2 THEN (l.k - 1) / 2.0 ELSE (l.k - 3) / 5.0 END AS a, CASE WHEN l.k <= 2 THEN l.k / 2.0 ELSE (l.k - 2) / 5.0 END AS b FROM t, range(1, 8) l(k))
SELECT i, j, k, round(hi + a * (lo - hi), 6) AS c0z, round(hi + b * (lo - hi), 6) AS c4z FROM z""", "cells", "depths")
def grid_conform_to_surfaces(cells, nodes):
    # each column that has cells gets all its seven layers
    full = boxes(cells.groupBy("i", "j").agg(F.max("actnum").alias("actnum")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(7)))))
    stack = [nodes.withColumn("value", F.col("value") + d) for d in (0.0, 15.0, 60.0)]
    return c.conform(full, stack, MAP, (2, 5), faults="level").select("i", "j", "k", *(rounded(x).alias(x) for x in ("c0z", "c4z")))


#: Of the slanted pillars: how far x and y go with a unit of depth; of a map's columns and rows with it, and how fast the maps fall along them.
_SX, _SY = 0.3, 0.2
_US, _VS = f"({_SX} * cos(radians(30)) + {_SY} * sin(radians(30))) / 25", f"({_SY} * cos(radians(30)) - {_SX} * sin(radians(30))) / 20"


@R.query(f"""WITH cor AS (SELECT i, j, cast(a AS int) AS a, cast(b AS int) AS b, i + a AS ni, j + b AS nj, 1500.0 + 0.5 * (i + a - 1) + 0.25 * (j + b - 1) + CASE WHEN i > 10 THEN 7.0 ELSE 0.0 END AS t FROM (SELECT DISTINCT i, j FROM cells), range(2) ra(a), range(2) rb(b)),
nd AS (SELECT ni, nj, min(t) AS lo, max(t) + 70.0 AS hi, avg(t) AS m, ((ni - 1) * 100.0 * cos(radians(30)) + (nj - 1) * 80.0 * sin(radians(30))) / 25 AS u0, ((nj - 1) * 80.0 * cos(radians(30)) - (ni - 1) * 100.0 * sin(radians(30))) / 20 AS v0 FROM cor GROUP BY ni, nj),
hit AS (SELECT *, u0 + {_US} * (z - 1500) AS u, v0 + {_VS} * (z - 1500) AS v FROM (SELECT nd.*, s, 1500.0 + (3.5 + d + 2 * u0 + 1.5 * v0) / (1 - 2 * {_US} - 1.5 * {_VS}) AS z FROM nd, (VALUES (0, 0.0), (1, 15.0), (2, 60.0)) q(s, d))),
ok AS (SELECT h.ni, h.nj, h.s, any_value(h.z) AS z, any_value(h.m) AS m FROM hit h JOIN depths d ON d.i - 1 - floor(least(greatest(u, 0), 48.999999)) IN (0, 1) AND d.j - 1 - floor(least(greatest(v, 0), 38.999999)) IN (0, 1) WHERE (z - lo) / (hi - lo) BETWEEN -0.5 AND 1.5 AND u BETWEEN -0.000001 AND 49.000001 AND v BETWEEN -0.000001 AND 39.000001 GROUP BY h.ni, h.nj, h.s HAVING count(*) = 4),
al AS (SELECT ni, nj, any_value(m) AS m, max(CASE WHEN s = 0 THEN z END) AS z0, max(CASE WHEN s = 1 THEN z END) AS z1, max(CASE WHEN s = 2 THEN z END) AS z2 FROM ok GROUP BY ni, nj HAVING count(*) = 3),
bd AS (SELECT cor.*, coalesce(z0 + t - m, t) AS b0, coalesce(z1 + t - m, t + 20.0) AS b1, coalesce(z2 + t - m, t + 70.0) AS b2 FROM cor LEFT JOIN al USING (ni, nj)),
ly AS (SELECT bd.*, cast(k AS int) AS k, CASE WHEN k <= 2 THEN b0 + (k - 1) / 2.0 * (b1 - b0) ELSE b1 + (k - 3) / 5.0 * (b2 - b1) END AS top, CASE WHEN k <= 2 THEN b0 + k / 2.0 * (b1 - b0) ELSE b1 + (k - 2) / 5.0 * (b2 - b1) END AS base FROM bd, range(1, 8) l(k))
SELECT p.i, p.j, p.k, round(p.top, 6) AS c0z, round(q.base, 6) AS c6z, round(1000 + (p.ni - 1) * 100 + {_SX} * (p.top - 1500), 6) AS c0x, round(2000 + (q.nj - 1) * 80 + {_SY} * (q.base - 1500), 6) AS c6y FROM ly p JOIN ly q USING (i, j, k) WHERE p.a = 0 AND p.b = 0 AND q.a = 1 AND q.b = 1""", "cells", "depths")
def grid_conform_faulted(cells, nodes):
    """Slanted pillars, and a fault between columns 10 and 11: its throw stays, and the mean of its sides lies on the maps."""
    full = boxes(cells.groupBy("i", "j").agg(F.max("actnum").alias("actnum")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(7)))))
    full = full.withColumns({f"c{n}{a}": F.col(f"c{n}{a}") + by * (F.col(f"c{n}z") - 1500.0) for n in range(8) for a, by in (("x", _SX), ("y", _SY))})
    stack = [nodes.withColumn("value", F.col("value") + d) for d in (0.0, 15.0, 60.0)]
    return c.conform(full, stack, MAP, (2, 5)).select("i", "j", "k", *(rounded(x).alias(x) for x in ("c0z", "c6z", "c0x", "c6y")))


_ACROSS = f"{_D!r} * a.perm * b.perm / (a.perm + b.perm)"


#: A grid without gaps: three cells under each trace of the cube; its tenth row is a hole.
_DENSE = "dense AS (SELECT i, j, cast(k AS int) AS k, CASE WHEN traceid = 2 THEN 0 ELSE 1 END AS actnum, abs(cast(amp[k] AS double)) * 100.0 + 1.0 AS perm FROM (SELECT *, unnest(range(1, 4)) AS k FROM traces))"


def _nested(traces):
    own = traces.select("i", "j", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"), F.when(F.col("traceid") == 2, 0).otherwise(1).alias("actnum"), "amp")
    own = boxes(own.withColumn("perm", F.abs(F.element_at("amp", F.col("k")).cast("double")) * 100.0 + 1.0).drop("amp"))
    return own.withColumn("nest_id", F.when(F.col("j") < 10, 1).when(F.col("j") > 10, 2).otherwise(0))


@R.query(f"""WITH {_DENSE} SELECT a.i AS i1, a.j AS j1, a.k AS k1, b.i AS i2, b.j AS j2, b.k AS k2, round({_ACROSS} * 100 * CASE WHEN b.k = a.k THEN 9.75 ELSE 0.25 END / ((1600 + 0.125 * 0.125) / 40), 6) AS tran, 'NestedHybrid' AS type, 'J+' AS direction
FROM dense a JOIN dense b ON a.j = 9 AND b.j = 11 AND b.i = a.i AND b.k IN (a.k, a.k - 1) AND a.actnum = 1 AND b.actnum = 1""", "traces")
def grid_nested_connections(traces):
    """The rows on the two sides of the hole are connected by the place of their faces."""
    own = _nested(traces)
    return cn.table_connections(own, cn.nested_table(own), ("perm", "perm", "perm")).withColumn("tran", rounded("tran"))


@R.query(f"""SELECT a.i AS i1, a.j AS j1, a.k AS k1, b.i AS i2, b.j AS j2, b.k AS k2, round({_ACROSS} * 0.1 * 1600, 6) AS tran, 'NNC' AS type, 'K+' AS direction FROM cells a JOIN cells b ON b.i = a.i AND b.j = a.j AND b.k = a.k + 1
UNION ALL SELECT a.i, a.j, a.k, b.i, b.j, b.k, round({_ACROSS} * 0.5 * 1000 / 40 * 1600 / (1600 + 0.125 * 0.125), 6), 'NNC', 'J-' FROM cells a JOIN cells b ON b.i = a.i AND b.j = a.j - 1 AND b.k = a.k""", "cells")
def grid_table_connections(cells):
    """Every cell's connections down and to the row before, as a table names them; pairs beyond the grid, and unknown directions, go."""
    pair = lambda dj, dk, d: cells.select(*(F.col(x).alias(f"{x}1") for x in "ijk"), F.col("i").alias("i2"), (F.col("j") + dj).alias("j2"), (F.col("k") + dk).alias("k2"), F.lit(d).alias("direction"))
    table = pair(0, 1, "K+").unionByName(pair(-1, 0, " J- ")).unionByName(pair(1, 0, "N"))
    own = boxes(cells).withColumns({"pz": F.col("perm") * 0.1, "half": F.lit(0.5)})
    return cn.table_connections(own, table, ("perm", "perm", "pz"), "half", kind="NNC").withColumn("tran", rounded("tran"))


@R.query(f"WITH {_DENSE} SELECT c.i, c.j, c.k, CASE WHEN c.j = 11 AND c.actnum = 1 AND EXISTS (SELECT 1 FROM dense m WHERE m.actnum = 1 AND m.j = 9 AND m.i = c.i AND m.k IN (c.k, c.k + 1)) THEN 1 ELSE 0 END AS refined_boundary FROM dense c", "traces")
def grid_refined_boundary(traces):
    own = _nested(traces)
    return cn.refined_boundary(own, cn.nested_table(own))


@R.query(f"""WITH {BOX}, {_NODES}, t AS (SELECT zone, i, j, min(k) AS k FROM box WHERE actnum = 1 GROUP BY zone, i, j), o AS (SELECT box.* FROM box JOIN t USING (zone, i, j, k)), bk AS (SELECT i, j, max(k) AS k FROM box WHERE actnum = 1 GROUP BY i, j), ob AS (SELECT box.* FROM box JOIN bk USING (i, j, k))
SELECT zone, ni AS i, nj AS j, round(c0z + 0.5 * (x - c0x) / 100 + 0.25 * (y - c0y) / 80, 6) AS value FROM nd JOIN o ON {_on('o')}
UNION ALL SELECT NULL, ni, nj, round(c4z + 0.5 * (x - c0x) / 100 + 0.25 * (y - c0y) / 80, 6) FROM nd JOIN ob ON {_on('ob')}""", "cells")
def grid_zone_maps(cells):
    return c.zone_maps(boxes(cells), FINE).withColumn("value", rounded("value"))
