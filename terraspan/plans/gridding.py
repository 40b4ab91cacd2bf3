"""Queries that make maps and outlines from points."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraspan.functions.geometry import MapHeader, rounded
from terraspan.operators import gridding as gr
from terraspan.operators.surfaces import lattice, with_xy
from terraspan.plans.registry import Registry

R = Registry()
GRID = MapHeader(21, 17, 0.0, 0.0, 50.0, 60.0)
_LAT = "lat AS (SELECT cast(a.i AS int) AS i, cast(b.j AS int) AS j, 50.0 * (a.i - 1) AS x, 60.0 * (b.j - 1) AS y FROM range(1, 22) a(i), range(1, 18) b(j)), pin AS (SELECT * FROM points WHERE x BETWEEN 0 AND 1000 AND y BETWEEN 0 AND 960)"


@R.query(f"""WITH {_LAT}, d AS (SELECT i, j, z, sqrt((lat.x - pin.x)**2 + (lat.y - pin.y)**2) AS d FROM lat, pin)
SELECT i, j, round(sum(z / d**2) / sum(1 / d**2), 6) AS value FROM d WHERE d <= 110 GROUP BY i, j HAVING count(*) >= 2""", "points")
def gridding_idw(points):
    return gr.idw(points, GRID, 2.0, 110.0, 2).withColumn("value", rounded("value"))


@R.query(f"""WITH {_LAT}, d AS (SELECT i, j, z, pin.x AS px, pin.y AS py, sqrt((lat.x - pin.x)**2 + (lat.y - pin.y)**2) AS d FROM lat, pin) SELECT i, j, arg_min(z, (d, px, py, z)) AS value FROM d GROUP BY i, j""", "points")
def gridding_nearest(points):
    return gr.nearest(points, GRID)


@R.query(f"""WITH {_LAT}, n AS (SELECT i, j, arg_min(z, (d, px, py, z)) AS v FROM (SELECT i, j, z, pin.x AS px, pin.y AS py, sqrt((lat.x - pin.x)**2 + (lat.y - pin.y)**2) AS d FROM lat, pin) GROUP BY i, j),
k AS (SELECT count(*) AS k FROM range(-2, 3) a(a), range(-2, 3) b(b) WHERE (a * 50.0)**2 + (b * 60.0)**2 <= 14400)
SELECT l.i, l.j, round(sum(n.v) / any_value(k), 6) AS value FROM lat l, n, k WHERE ((l.i - n.i) * 50.0)**2 + ((l.j - n.j) * 60.0)**2 <= 14400 GROUP BY l.i, l.j""", "points")
def gridding_moving_average(points):
    return gr.moving_average(points, GRID, 120.0).withColumn("value", rounded("value"))


@R.query(None, "points")
def gridding_linear(points):
    return gr.linear(points, GRID, "attr").withColumn("value", rounded("value"))


@R.query(f"""WITH {_LAT}, p AS (SELECT DISTINCT attr, x, y FROM pin), e AS (SELECT a.attr, a.x, a.y, b.x - a.x AS ex, b.y - a.y AS ey FROM p a JOIN p b ON a.attr = b.attr AND (a.x <> b.x OR a.y <> b.y) JOIN p c ON c.attr = a.attr GROUP BY a.attr, a.x, a.y, b.x, b.y HAVING min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) >= 0)
SELECT g.attr, l.i, l.j, round(10 + 0.25 * l.x - 0.125 * l.y + 0.001 * l.x * l.x - 0.0005 * l.x * l.y + 0.00075 * l.y * l.y, 4) AS value FROM lat l, (SELECT DISTINCT attr FROM p) g WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.attr = g.attr AND e.ex * (l.y - e.y) - e.ey * (l.x - e.x) < -0.000001)""", "points")
def gridding_cubic(points):
    """Smooth triangles over the points' own places; a parabola as their depth, which they meet exactly."""
    x, y = F.col("x"), F.col("y")
    own = points.withColumn("z", 10 + 0.25 * x - 0.125 * y + 0.001 * x * x - 0.0005 * x * y + 0.00075 * y * y)
    return gr.cubic(own, GRID, "attr").withColumn("value", rounded("value", 4))


@R.query("""WITH p AS (SELECT x, y, avg(z) AS z FROM points WHERE x BETWEEN 0 AND 1000 AND y BETWEEN 0 AND 960 GROUP BY x, y), d AS (SELECT sqrt((a.x - b.x)**2 + (a.y - b.y)**2) AS d, (a.z - b.z)**2 / 2 AS g FROM p a JOIN p b ON a.x < b.x OR (a.x = b.x AND a.y < b.y))
SELECT cast(least(floor(d / 64 * 8), 7) AS int) AS lag, count(*) AS n, round(avg(d), 6) AS distance, round(avg(g), 3) AS gamma FROM d WHERE d <= 64 GROUP BY 1""", "points")
def gridding_variogram(points):
    return gr.variogram(points, GRID, 8, 64.0, 1 << 40).withColumns({"distance": rounded("distance"), "gamma": rounded("gamma", 3)})


@R.query(f"""WITH {_LAT}, u AS (SELECT x, y, avg(z) AS z FROM pin GROUP BY x, y), d AS (SELECT i, j, u.x, u.y, sqrt((lat.x - u.x)**2 + (lat.y - u.y)**2) AS d FROM lat, u)
SELECT i, j, cast(row_number() OVER (PARTITION BY i, j ORDER BY d, x, y) AS int) AS rank, round(d, 6) AS d, x, y FROM d QUALIFY rank <= 5""", "points")
def points_nearest(points):
    """The five nearest points of each node."""
    own = gr.inside_map(points, GRID).groupBy("x", "y").agg(F.avg("z").alias("z"))
    near = gr.nearest_points(with_xy(lattice(points.sparkSession, GRID), GRID), own, 5)
    return near.select("i", "j", F.posexplode("near").alias("rank", "q")).select("i", "j", (F.col("rank") + 1).alias("rank"), rounded(F.col("q.d")).alias("d"), "q.x", "q.y")


@R.query(None, "points")
def gridding_kriging_neighbours(points):
    """Each node by its 16 nearest points, with the model that fits all pairs within 100 best."""
    model = gr.fitted(points, GRID, "exponential", 10, 100.0)
    return gr.kriging_by_neighbours(points, GRID, 16, "exponential", **model).withColumn("value", rounded("value", 4))


@R.query(None, "points")
def gridding_rbf(points):
    return gr.rbf(points, GRID).withColumn("value", rounded("value", 4))


@R.query(None, "points")
def gridding_kriging(points):
    return gr.kriging(points, GRID, "exponential", 300.0).withColumn("value", rounded("value", 4))


@R.query("""WITH p AS (SELECT DISTINCT attr, x, y FROM points), e AS (SELECT a.attr, a.x, a.y, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.attr = b.attr AND (a.x <> b.x OR a.y <> b.y)),
h AS (SELECT e.attr, e.x, e.y FROM e JOIN p c ON c.attr = e.attr GROUP BY e.attr, e.x, e.y, bx, by_ HAVING bool_and((bx - e.x) * (c.y - e.y) - (by_ - e.y) * (c.x - e.x) > 0 OR ((bx - e.x) * (c.y - e.y) - (by_ - e.y) * (c.x - e.x) = 0 AND (bx - e.x) * (c.x - e.x) + (by_ - e.y) * (c.y - e.y) BETWEEN 0 AND (bx - e.x)**2 + (by_ - e.y)**2))) SELECT DISTINCT attr, x, y FROM h""", "points")
def points_convex_hull(points):
    return gr.hull(points, "attr").select("attr", "x", "y").distinct()


@R.query(None, "points")
def points_alpha_shape(points):
    return gr.alpha_shape(points, "attr", 300.0)


@R.query(None, "fence")
def polygons_simplify(polygons):
    from terraspan.operators.polygons import rescale

    return gr.simplify(rescale(polygons, 10.0), 0.5).select("poly_id", "seq", rounded("x").alias("x"), rounded("y").alias("y"), F.col("z"))
