"""Queries over maps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terraspan.functions.geometry import MapHeader, rounded
from terraspan.operators import surfaces as s
from terraspan.plans.registry import Registry
from terraspan.plans.views import MAP

R = Registry()
C, S = MAP.cos, MAP.sin
#: Another map, over part of the first and beyond it.
OTHER = MapHeader(30, 25, 1200.0, 2300.0, 40.0, 30.0, 10.0, 1)
XY = f"{MAP.xori!r} + (i - 1) * {MAP.xinc * C!r} - (j - 1) * {MAP.yinc * S!r}", f"{MAP.yori!r} + (i - 1) * {MAP.xinc * S!r} + (j - 1) * {MAP.yinc * C!r}"


def bilinear_sql(places: str, keep: str, out: str) -> str:
    """SQL that samples `depths` at the rows of a query with x and y."""
    fi = f"(((x - {MAP.xori!r}) * {C!r} + (y - {MAP.yori!r}) * {S!r}) / {MAP.xinc!r})"
    fj = f"(((y - {MAP.yori!r}) * {C!r} - (x - {MAP.xori!r}) * {S!r}) / {MAP.yinc!r})"
    return f"""p0 AS ({places}), p1 AS (SELECT *, {fi} AS fi0, {fj} AS fj0 FROM p0),
p2 AS (SELECT *, CASE WHEN ok THEN greatest(0, least({MAP.ncol - 1}, fi0)) END AS fi, CASE WHEN ok THEN greatest(0, least({MAP.nrow - 1}, fj0)) END AS fj FROM (SELECT *, fi0 BETWEEN -1e-6 AND {MAP.ncol - 1} + 1e-6 AND fj0 BETWEEN -1e-6 AND {MAP.nrow - 1} + 1e-6 AS ok FROM p1)),
p3 AS (SELECT *, least(cast(floor(fi) AS int), {MAP.ncol - 2}) AS ci, least(cast(floor(fj) AS int), {MAP.nrow - 2}) AS cj FROM p2),
p4 AS (SELECT p3.*, fi - ci AS a, fj - cj AS b, q1.value AS z1, q2.value AS z2, q3.value AS z3, q4.value AS z4 FROM p3 LEFT JOIN depths q1 ON q1.i = ci + 1 AND q1.j = cj + 1
 LEFT JOIN depths q2 ON q2.i = ci + 2 AND q2.j = cj + 1 LEFT JOIN depths q3 ON q3.i = ci + 1 AND q3.j = cj + 2 LEFT JOIN depths q4 ON q4.i = ci + 2 AND q4.j = cj + 2),
{out} AS (SELECT {keep}, z1 + a * (z2 - z1) + b * (z3 - z1) + a * b * (z4 + z1 - z3 - z2) AS sampled FROM p4)"""


@R.query("SELECT i, j, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM nodes GROUP BY i, j", "nodes")
def surface_statistics(nodes):
    return s.statistics(nodes).select("i", "j", *(rounded(c).alias(c) for c in ("mean", "std", "p10", "p50", "p90")))


@R.query("SELECT i, j, round(max(value) - min(value), 6) AS value FROM nodes GROUP BY i, j", "nodes")
def surface_apply(nodes):
    return s.reduce_stack(nodes, F.max("value") - F.min("value")).withColumn("value", rounded("value"))


@R.query("SELECT coalesce(bool_and(value >= p), true) AS consistent FROM (SELECT value, lag(value) OVER (PARTITION BY i, j ORDER BY realisation) AS p FROM nodes) WHERE p IS NOT NULL", "nodes")
def surface_is_depth_consistent(nodes):
    return s.is_depth_consistent(nodes, "realisation")


@R.query("SELECT realisation, i, j, round(max(value) OVER (PARTITION BY i, j ORDER BY realisation ROWS UNBOUNDED PRECEDING), 6) AS value FROM nodes", "nodes")
def surface_make_depth_consistent(nodes):
    return s.make_depth_consistent(nodes, "realisation").select("realisation", "i", "j", rounded("value").alias("value"))


def _two(nodes):
    return (nodes.where(F.col("realisation") == k).drop("realisation") for k in (1, 2))


def _algebra(name: str, op: str, sql: str, round_: bool = True):
    value = f"round({sql}, 6)" if round_ else sql
    text = f"SELECT a.i, a.j, {value} AS value FROM (SELECT * FROM nodes WHERE realisation = 1) a JOIN (SELECT * FROM nodes WHERE realisation = 2) b ON a.i = b.i AND a.j = b.j"

    def run(nodes):
        out = s.combine(*_two(nodes), op)
        return out.withColumn("value", rounded("value")) if round_ else out

    run.__name__ = f"surface_{name}"
    R.query(text, "nodes")(run)


for _name, _op, _sql in (("add", "add", "a.value + b.value"), ("subtract", "sub", "a.value - b.value"), ("multiply", "mul", "a.value * b.value"), ("divide", "div", "a.value / nullif(b.value, 0)")):
    _algebra(_name, _op, _sql)
for _name, _sql in (("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">="), ("eq", "="), ("ne", "<>")):
    _algebra(f"compare_{_name}", _name, f"a.value {_sql} b.value", False)


@R.query("SELECT i, j, round(value / 4 * 3 - 1, 6) AS value FROM nodes WHERE realisation = 1", "nodes")
def surface_scalar_algebra(nodes):
    own = next(_two(nodes))
    return s.scalar(s.scalar(s.scalar(own, "div", 4), "mul", 3), "sub", 1).withColumn("value", rounded("value")).select("i", "j", "value")


@R.query("SELECT round(abs(a.m - b.m) / a.m, 6) AS similarity FROM (SELECT avg(value) AS m FROM nodes WHERE realisation = 1) a, (SELECT avg(value) AS m FROM nodes WHERE realisation = 2) b", "nodes")
def surface_similarity(nodes):
    return s.similarity(*_two(nodes)).withColumn("similarity", rounded("similarity"))


@R.query("SELECT count(*) = 0 AS same FROM (SELECT i, j FROM nodes WHERE realisation = 1) a FULL JOIN (SELECT i, j FROM nodes WHERE realisation = 2) b ON a.i = b.i AND a.j = b.j WHERE a.i IS NULL OR b.i IS NULL", "nodes")
def surface_compare_topology(nodes):
    return s.same_mask(*_two(nodes))


@R.query(f"SELECT i AS IX, j AS JY, round({XY[0]}, 6) AS X_UTME, round({XY[1]}, 6) AS Y_UTMN, value AS VALUES FROM depths", "depths")
def surface_table(nodes):
    return s.table(nodes, MAP).select("IX", "JY", rounded("X_UTME").alias("X_UTME"), rounded("Y_UTMN").alias("Y_UTMN"), "VALUES")


@R.query(f"SELECT cast(a.i AS int) AS IX, cast(b.j AS int) AS JY, coalesce(value, -999.0) AS VALUES FROM range(1, {MAP.ncol + 1}) a(i), range(1, {MAP.nrow + 1}) b(j) LEFT JOIN depths d ON d.i = a.i AND d.j = b.j", "depths")
def surface_table_all(nodes):
    return s.table(nodes, MAP, False, -999.0).select("IX", "JY", "VALUES")


@R.query("SELECT count(value) AS nactive, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM depths", "depths")
def surface_describe(nodes):
    return s.describe(nodes).withColumns({"mean": rounded("mean"), "std": rounded("std")})


_OTHER_XY = f"{OTHER.xori!r} + (i - 1) * {OTHER.xinc * OTHER.cos!r} - (j - 1) * {OTHER.yinc * OTHER.sin!r} AS x, {OTHER.yori!r} + (i - 1) * {OTHER.xinc * OTHER.sin!r} + (j - 1) * {OTHER.yinc * OTHER.cos!r} AS y"
_LATTICE = f"SELECT i, j, {_OTHER_XY} FROM (SELECT cast(a.i AS int) AS i, cast(b.j AS int) AS j FROM range(1, {OTHER.ncol + 1}) a(i), range(1, {OTHER.nrow + 1}) b(j)) l"


@R.query(f"WITH {bilinear_sql(_LATTICE, 'i, j', 'r')} SELECT i, j, round(sampled, 6) AS value FROM r WHERE sampled IS NOT NULL", "depths")
def surface_resample(nodes):
    return s.resample(nodes, MAP, OTHER).withColumn("value", rounded("value"))


_NEAR = f"""WITH p AS ({_LATTICE}), f AS (SELECT i, j, ((x - {MAP.xori!r}) * {C!r} + (y - {MAP.yori!r}) * {S!r}) / {MAP.xinc!r} AS fi, ((y - {MAP.yori!r}) * {C!r} - (x - {MAP.xori!r}) * {S!r}) / {MAP.yinc!r} AS fj FROM p)
SELECT f.i, f.j, d.value FROM f JOIN depths d ON d.i = floor(fi + 0.5) + 1 AND d.j = floor(fj + 0.5) + 1 WHERE fi BETWEEN 0 AND {MAP.ncol - 1} AND fj BETWEEN 0 AND {MAP.nrow - 1}"""


@R.query(_NEAR, "depths")
def surface_resample_nearest(nodes):
    return s.resample(nodes, MAP, OTHER, "nearest")


@R.query(f"WITH {bilinear_sql('SELECT pid, x + 1000 AS x, y + 2000 AS y, z FROM points', 'pid, x, y', 'r')} SELECT pid, x, y, round(sampled, 6) AS z FROM r WHERE sampled IS NOT NULL", "points", "depths")
def surface_snap_points(points, nodes):
    moved = points.withColumns({"x": F.col("x") + 1000, "y": F.col("y") + 2000})
    return s.snap(moved, nodes, MAP).select("pid", "x", "y", rounded("z").alias("z"))


@R.query(f"WITH {bilinear_sql('SELECT well, seq, x, y, z FROM wells', 'well, seq, z', 'r')} SELECT well, seq, round(sampled - z, 6) AS dist_surf FROM r", "wells", "depths")
def well_surface_distance(samples, nodes):
    return s.distance_log(samples, nodes, MAP).select("well", "seq", rounded("DIST_SURF").alias("dist_surf"))


@R.query(f"""WITH {bilinear_sql('SELECT well, seq, x, y, z, md FROM wells', 'well, seq, x, y, z, md', 'r')}, d AS (SELECT *, z - sampled AS d FROM r), l AS (SELECT *, lag(d) OVER o AS d0, lag(x) OVER o AS x0, lag(y) OVER o AS y0, lag(z) OVER o AS z0, lag(md) OVER o AS m0 FROM d WINDOW o AS (PARTITION BY well ORDER BY seq))
SELECT well, seq, round(x0 - d0 / (d - d0) * (x - x0), 6) AS x, round(y0 - d0 / (d - d0) * (y - y0), 6) AS y, round(z0 - d0 / (d - d0) * (z - z0), 6) AS z, round(m0 - d0 / (d - d0) * (md - m0), 6) AS md, CASE WHEN d > 0 THEN 1 ELSE -1 END AS direction FROM l WHERE (d0 <= 0 AND d > 0) OR (d0 >= 0 AND d < 0)""", "wells", "depths")
def well_surface_picks(samples, nodes):
    from terraspan.operators.wells import surface_picks

    out = surface_picks(s.sample(samples, nodes, MAP, name="surface_z"))
    return out.select("well", "seq", *(rounded(c).alias(c) for c in ("x", "y", "z", "md")), "direction")


@R.query("SELECT i - (SELECT min(i) FROM depths) + 1 AS i, j - (SELECT min(j) FROM depths) + 1 AS j, value FROM depths", "depths")
def surface_autocrop(nodes):
    return s.autocrop(nodes)


@R.query(f"SELECT i, j, round((({XY[0]}) - 1500) * {math.cos(math.radians(30))!r} - (({XY[1]}) - 2300) * {math.sin(math.radians(30))!r}, 6) + 0.0 AS value FROM depths", "depths")
def surface_distance_from_point(nodes):
    return s.distance_from_point(nodes, MAP, 1500.0, 2300.0, 30.0).withColumn("value", rounded("value"))


_SWAPPED = MapHeader(MAP.nrow, MAP.ncol, MAP.xori, MAP.yori, MAP.yinc, MAP.xinc, MAP.rotation + 90, -1)


@R.query(f"SELECT j AS i, i AS j, round({XY[0]}, 6) AS x, round({XY[1]}, 6) AS y, value FROM depths", "depths")
def surface_swap_axes(nodes):
    return s.with_xy(*s.swap_axes(nodes, MAP)).select("i", "j", rounded("x").alias("x"), rounded("y").alias("y"), "value")


@R.query(f"SELECT i, {MAP.nrow + 1} - j AS j, round({XY[0]}, 6) AS x, round({XY[1]}, 6) AS y, value FROM depths", "depths")
def surface_make_lefthanded(nodes):
    return s.with_xy(*s.flip_rows(nodes, MAP)).select("i", "j", rounded("x").alias("x"), rounded("y").alias("y"), "value")


@R.query(f"SELECT i, j, round({XY[0]} + 5, 6) AS x, round({XY[1]} - 7, 6) AS y, value + 11 AS value FROM depths", "depths")
def surface_translate(nodes):
    return s.with_xy(*s.translate(nodes, MAP, 5.0, -7.0, 11.0)).select("i", "j", rounded("x").alias("x"), rounded("y").alias("y"), "value")


def _resampled_sql(h: MapHeader) -> str:
    xy = f"{h.xori!r} + (i - 1) * {h.xinc * h.cos!r} - (j - 1) * {h.yflip * h.yinc * h.sin!r} AS x, {h.yori!r} + (i - 1) * {h.xinc * h.sin!r} + (j - 1) * {h.yflip * h.yinc * h.cos!r} AS y"
    lattice = f"SELECT i, j, {xy} FROM (SELECT cast(a.i AS int) AS i, cast(b.j AS int) AS j FROM range(1, {h.ncol + 1}) a(i), range(1, {h.nrow + 1}) b(j)) l"
    return f"WITH {bilinear_sql(lattice, 'i, j', 'r')} SELECT i, j, round(sampled, 6) AS value FROM r WHERE sampled IS NOT NULL"


@R.query(_resampled_sql(s.refined(MAP, 2)), "depths")
def surface_refine(nodes):
    return s.resample(nodes, MAP, s.refined(MAP, 2)).withColumn("value", rounded("value"))


@R.query(_resampled_sql(s.coarsened(MAP, 3)), "depths")
def surface_coarsen(nodes):
    return s.resample(nodes, MAP, s.coarsened(MAP, 3)).withColumn("value", rounded("value"))


@R.query(_resampled_sql(s.unrotated(MAP, 2)), "depths")
def surface_unrotate(nodes):
    return s.resample(nodes, MAP, s.unrotated(MAP, 2)).withColumn("value", rounded("value"))


_ALL = f"(SELECT cast(a.i AS int) AS i, cast(b.j AS int) AS j FROM range(1, {MAP.ncol + 1}) a(i), range(1, {MAP.nrow + 1}) b(j))"
_ONE = "(SELECT i, j, value FROM nodes WHERE realisation = 1)"
_FILLED = f"""SELECT l.i, l.j, arg_min(n.value, ((n.i - l.i) * {MAP.xinc!r})**2 * 1e6 + ((n.j - l.j) * {MAP.yinc!r})**2 * 1e6 + n.i + n.j / 1000) AS value FROM {_ALL} l, {_ONE} n GROUP BY l.i, l.j"""


@R.query(f"SELECT i, j, coalesce(value, 99.5) AS value FROM {_ALL} l LEFT JOIN depths USING (i, j)", "depths")
def surface_fill_constant(nodes):
    return s.fill(nodes, MAP, 99.5)


@R.query(f"SELECT i, j, round(value, 6) AS value FROM ({_FILLED})", "nodes")
def surface_fill_nearest(nodes):
    return s.fill(next(_two(nodes)), MAP, reach=4).withColumn("value", rounded("value"))


@R.query(f"""WITH f AS MATERIALIZED ({_FILLED}), o AS (SELECT a.d AS di, b.d AS dj FROM range(-1, 2) a(d), range(-1, 2) b(d)),
m AS (SELECT t.i, t.j, quantile_cont(f.value, 0.5) AS value FROM {_ONE} t, o JOIN f ON f.i = greatest(1, least({MAP.ncol}, t.i + di)) AND f.j = greatest(1, least({MAP.nrow}, t.j + dj)) GROUP BY t.i, t.j) SELECT i, j, round(value, 6) AS value FROM m""", "nodes")
def surface_smooth_median(nodes):
    return s.smooth(next(_two(nodes)).select("i", "j", "value"), MAP, "median", 3).withColumn("value", rounded("value"))


_G = [math.exp(-0.5 * k * k) for k in range(-4, 5)]


@R.query(f"""WITH f AS MATERIALIZED ({_FILLED}), k AS (SELECT * FROM (VALUES {", ".join(f"({k - 4}, {x / sum(_G)!r}::DOUBLE)" for k, x in enumerate(_G))}) v(d, w)), o AS (SELECT a.d AS di, b.d AS dj, a.w * b.w AS w FROM k a, k b),
m AS (SELECT t.i, t.j, sum(f.value * w) AS value FROM {_ONE} t, o JOIN f ON f.i = greatest(1, least({MAP.ncol}, t.i + di)) AND f.j = greatest(1, least({MAP.nrow}, t.j + dj)) GROUP BY t.i, t.j) SELECT i, j, round(value, 6) AS value FROM m""", "nodes")
def surface_smooth_gaussian(nodes):
    return s.smooth(next(_two(nodes)).select("i", "j", "value"), MAP, "gaussian", sigma=1.0).withColumn("value", rounded("value"))
