"""Queries over points and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraspan.functions.geometry import rounded
from terraspan.operators import polygons as p
from terraspan.operators import surfaces as s
from terraspan.plans.registry import Registry
from terraspan.plans.surfaces import XY, bilinear_sql
from terraspan.plans.views import MAP

R = Registry()
EDGES = """e AS (SELECT poly_id, x AS x1, y AS y1, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM polygons WINDOW o AS (PARTITION BY poly_id ORDER BY seq)),
h AS (SELECT pid, poly_id, count(*) % 2 AS odd FROM points, e WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY pid, poly_id),
c AS (SELECT pid, count(*) AS n, bool_or(poly_id = 0) AS in0, bool_or(poly_id = 1) AS in1 FROM h WHERE odd = 1 GROUP BY pid),
m AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(in0, false) AS in0, coalesce(in1, false) AS in1 FROM points p LEFT JOIN c USING (pid))"""


@R.query(f"WITH {EDGES} SELECT pid, cast(CASE WHEN n > 0 THEN 1 ELSE 0 END AS int) AS pstatus FROM m", "points", "polygons")
def points_in_polygons(points, polygons):
    return p.mark(points, polygons).select("pid", "pstatus")


SQL_OP = {"add": "z + 100.0", "sub": "z - 100.0", "mul": "z * 2.0", "div": "z / 4.0", "set": "-1.0"}
VALUE = {"add": 100.0, "sub": 100.0, "mul": 2.0, "div": 4.0, "set": -1.0}


def _operation(op: str, inside: bool, version: int):
    side = "inside" if inside else "outside"
    name = f"points_{op}_{side}" + ("_v1" if version == 1 else "")
    if version == 2:
        hit = "n > 0" if inside else "n = 0"
        sql = f"SELECT pid, z FROM m WHERE NOT ({hit})" if op == "eli" else f"SELECT pid, round(CASE WHEN {hit} THEN {SQL_OP[op]} ELSE z END, 6) AS z FROM m"
    else:
        hits = [("" if inside else "NOT ") + c for c in ("in0", "in1")]
        if op == "eli":
            sql = f"SELECT pid, z FROM m WHERE NOT ({hits[0]} OR {hits[1]})"
        else:
            one = f"(SELECT *, CASE WHEN {hits[0]} THEN {SQL_OP[op]} ELSE z END AS z1 FROM m)"
            sql = f"SELECT pid, round(CASE WHEN {hits[1]} THEN {SQL_OP[op].replace('z', 'z1')} ELSE z1 END, 6) AS z FROM {one}"

    def run(points, polygons):
        out = p.operate(points, polygons, op, VALUE.get(op, 0.0), inside, version)
        return out.select("pid", rounded("z").alias("z") if op != "eli" else F.col("z"))

    run.__name__ = name
    R.query(f"WITH {EDGES} {sql}", "points", "polygons")(run)


for _version in (2, 1):
    for _op in ("add", "sub", "mul", "div", "set", "eli"):
        for _inside in (True, False):
            _operation(_op, _inside, _version)


@R.query(f"WITH {EDGES} SELECT pid, z + CASE WHEN in0 THEN 12.4 ELSE 0 END + CASE WHEN in1 THEN 22.4 ELSE 0 END AS z FROM (SELECT pid, in0, in1, z FROM m) r", "points", "polygons")
def points_add_polygon_mean(points, polygons):
    return p.operate(points, polygons, "add", "poly", True, 1).select("pid", rounded("z").alias("z"))


R.sql["points_add_polygon_mean"] = R.sql["points_add_polygon_mean"].replace("SELECT pid, z + CASE WHEN in0 THEN 12.4 ELSE 0 END + CASE WHEN in1 THEN 22.4 ELSE 0 END AS z", "SELECT pid, round(z + CASE WHEN in0 THEN 12.4 ELSE 0 END + CASE WHEN in1 THEN 22.4 ELSE 0 END, 6) AS z")

_MAP_EDGES = f"""t AS (SELECT poly_id, seq, x + 1000 AS x, y + 2000 AS y FROM polygons), e AS (SELECT poly_id, x AS x1, y AS y1, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM t WINDOW o AS (PARTITION BY poly_id ORDER BY seq)),
d AS (SELECT i, j, value, {XY[0]} AS x, {XY[1]} AS y FROM depths), h AS (SELECT i, j, poly_id FROM d, e WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY i, j, poly_id HAVING count(*) % 2 = 1),
k AS (SELECT DISTINCT i, j, true AS hit FROM h)"""


@R.query(f"WITH {_MAP_EDGES} SELECT i, j, CASE WHEN hit THEN value + 50 ELSE value END AS value FROM depths LEFT JOIN k USING (i, j)", "depths", "polygons")
def surface_add_inside(nodes, polygons):
    moved = polygons.withColumns({"x": F.col("x") + 1000, "y": F.col("y") + 2000})
    return p.operate(s.with_xy(nodes, MAP), moved, "add", 50.0, True, 2, "value").select("i", "j", "value")


@R.query(f"WITH {_MAP_EDGES} SELECT i, j, value FROM depths LEFT JOIN k USING (i, j) WHERE hit", "depths", "polygons")
def surface_eli_outside(nodes, polygons):
    moved = polygons.withColumns({"x": F.col("x") + 1000, "y": F.col("y") + 2000})
    return p.operate(s.with_xy(nodes, MAP), moved, "eli", 0.0, False, 2, "value").select("i", "j", "value")


for _op, _sql in (("add", "value + 50.0"), ("sub", "value - 50.0"), ("mul", "value * 50.0"), ("div", "value / 50.0"), ("set", "50.0")):
    for _inside in (True, False):
        if (_op, _inside) == ("add", True):
            continue

        def _on_map(nodes, polygons, op=_op, inside=_inside):
            moved = polygons.withColumns({"x": F.col("x") + 1000, "y": F.col("y") + 2000})
            return p.operate(s.with_xy(nodes, MAP), moved, op, 50.0, inside, 2, "value").select("i", "j", rounded("value").alias("value"))

        _on_map.__name__ = f"surface_{_op}_{'inside' if _inside else 'outside'}"
        R.query(f"WITH {_MAP_EDGES} SELECT i, j, round(CASE WHEN {'' if _inside else 'NOT '}coalesce(hit, false) THEN {_sql} ELSE value END, 6) AS value FROM depths LEFT JOIN k USING (i, j)", "depths", "polygons")(_on_map)


@R.query(f"WITH {_MAP_EDGES} SELECT i, j, value FROM depths LEFT JOIN k USING (i, j) WHERE hit IS NULL", "depths", "polygons")
def surface_eli_inside(nodes, polygons):
    moved = polygons.withColumns({"x": F.col("x") + 1000, "y": F.col("y") + 2000})
    return p.operate(s.with_xy(nodes, MAP), moved, "eli", 0.0, True, 2, "value").select("i", "j", "value")


@R.query("SELECT poly_id, seq, x, y, z FROM polygons WHERE poly_id = 1", "polygons")
def polygons_filter_ids(polygons):
    return p.filter_ids(polygons, [1]).drop("order")


def _length_sql(dims: str) -> str:
    d = " + ".join(f"({c} - lag({c}) OVER o)**2" for c in dims)
    return f"""WITH d AS (SELECT *, sqrt({d}) AS d FROM polygons WINDOW o AS (PARTITION BY poly_id ORDER BY seq)), s AS (SELECT *, sum(coalesce(d, 0)) OVER (PARTITION BY poly_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s, coalesce(d, lead(d) OVER (PARTITION BY poly_id ORDER BY seq)) AS dd FROM d)
SELECT poly_id, seq, round(s - max(CASE WHEN seq = 1 THEN s END) OVER (PARTITION BY poly_id), 6) + 0.0 AS cumlen, round(dd, 6) AS deltalen FROM s"""


@R.query(_length_sql("xy"), "polygons")
def polygons_hlen(polygons):
    return p.lengths(polygons, True, "c", "d", 1).select("poly_id", "seq", rounded("c").alias("cumlen"), rounded("d").alias("deltalen"))


@R.query(_length_sql("xyz"), "polygons")
def polygons_tlen(polygons):
    return p.lengths(polygons, False, "c", "d", 1).select("poly_id", "seq", rounded("c").alias("cumlen"), rounded("d").alias("deltalen"))


def rescale_sql(table: str, n: str, places: str = "places") -> str:
    return f"""d_{places} AS (SELECT *, coalesce(sqrt((x - lag(x) OVER o)**2 + (y - lag(y) OVER o)**2), 0) AS d FROM {table} WINDOW o AS (PARTITION BY poly_id ORDER BY seq)), s_{places} AS (SELECT *, sum(d) OVER (PARTITION BY poly_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM d_{places}),
g_{places} AS (SELECT *, lead(s) OVER o AS s2, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(z) OVER o AS z2 FROM s_{places} WINDOW o AS (PARTITION BY poly_id ORDER BY seq)),
t_{places} AS (SELECT poly_id, max(s) AS l, cast({n} AS int) AS n FROM (SELECT poly_id, s, max(s) OVER (PARTITION BY poly_id) AS l FROM s_{places}) GROUP BY poly_id, l), k_{places} AS (SELECT *, unnest(range(n + 1)) AS k FROM t_{places}),
{places} AS (SELECT k.poly_id, cast(k AS int) AS seq, arg_max(g.x + CASE WHEN s2 > s THEN (l * k / n - s) / (s2 - s) * (x2 - x) ELSE 0 END, s) AS x, arg_max(g.y + CASE WHEN s2 > s THEN (l * k / n - s) / (s2 - s) * (y2 - y) ELSE 0 END, s) AS y, arg_max(g.z + CASE WHEN s2 > s THEN (l * k / n - s) / (s2 - s) * (z2 - z) ELSE 0 END, s) AS z
 FROM k_{places} k JOIN g_{places} g ON g.poly_id = k.poly_id AND g.s <= l * k / n GROUP BY k.poly_id, k)"""


@R.query(f"WITH {rescale_sql('fence', 'greatest(1, round_even(l / 70, 0))')} SELECT poly_id, seq, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM places", "fence")
def polygons_rescale_simple(polygons):
    return p.rescale(polygons, 70.0).select("poly_id", "seq", *(rounded(c).alias(c) for c in "xyz"))


@R.query(f"WITH {rescale_sql('fence', 'greatest(2, floor(0.999 * l / 70)) - 1')} SELECT poly_id, seq, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM places", "fence")
def polygons_rescale_slinear(polygons):
    return p.rescale(polygons, 70.0, "slinear").select("poly_id", "seq", *(rounded(c).alias(c) for c in "xyz"))


_EXTEND = """b AS (SELECT *, row_number() OVER o AS a, row_number() OVER (PARTITION BY poly_id ORDER BY seq DESC) AS b, lead(x) OVER o AS nx, lead(y) OVER o AS ny, lag(x) OVER o AS px, lag(y) OVER o AS py FROM {table} WINDOW o AS (PARTITION BY poly_id ORDER BY seq)),
ext AS (SELECT poly_id, seq, x, y, z FROM b UNION ALL SELECT poly_id, seq - k, x + (x - nx) / sqrt((x - nx)**2 + (y - ny)**2) * k * {d}, y + (y - ny) / sqrt((x - nx)**2 + (y - ny)**2) * k * {d}, z FROM b, range(1, {n} + 1) r(k) WHERE a = 1
 UNION ALL SELECT poly_id, seq + k, x + (x - px) / sqrt((x - px)**2 + (y - py)**2) * k * {d}, y + (y - py) / sqrt((x - px)**2 + (y - py)**2) * k * {d}, z FROM b, range(1, {n} + 1) r(k) WHERE b.b = 1)"""


@R.query(f"WITH {_EXTEND.format(table='fence', d='25.0', n=2)} SELECT poly_id, cast(seq AS int) AS seq, round(x, 6) AS x, round(y, 6) AS y, z FROM ext", "fence")
def polygons_extend(polygons):
    return p.extend(polygons, 25.0, 2).select("poly_id", "seq", rounded("x").alias("x"), rounded("y").alias("y"), "z")


_FENCE = f"""tot AS (SELECT poly_id, least(60.0, sum(d) / 6) AS step FROM (SELECT poly_id, sqrt((x - lag(x) OVER o)**2 + (y - lag(y) OVER o)**2) AS d FROM fence WINDOW o AS (PARTITION BY poly_id ORDER BY seq)) GROUP BY poly_id),
un AS (SELECT poly_id, seq, x / step AS x, y / step AS y, z FROM fence JOIN tot USING (poly_id)), {rescale_sql('un', 'greatest(2, floor(0.999 * l)) - 1')}, {_EXTEND.format(table='places', d='1.0', n=2)},
bk AS (SELECT poly_id, cast(seq AS int) AS seq, x * step AS x, y * step AS y, z, step FROM ext JOIN tot USING (poly_id)), dd AS (SELECT *, sqrt((x - lag(x) OVER o)**2 + (y - lag(y) OVER o)**2) AS d FROM bk WINDOW o AS (PARTITION BY poly_id ORDER BY seq)),
ss AS (SELECT *, sum(coalesce(d, 0)) OVER (PARTITION BY poly_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s, coalesce(d, lead(d) OVER (PARTITION BY poly_id ORDER BY seq)) AS dh FROM dd),
fn AS (SELECT poly_id, seq, x, y, z, s - max(CASE WHEN seq = 0 THEN s END) OVER (PARTITION BY poly_id) AS h, dh FROM ss)"""


@R.query(f"WITH {_FENCE} SELECT poly_id, seq, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(h, 6) + 0.0 AS h, round(dh, 6) AS dh FROM fn", "fence")
def polygons_fence(polygons):
    return p.fence(polygons, 60.0).select("poly_id", "seq", *(rounded(c).alias(c) for c in ("x", "y", "z", "h", "dh")))


@R.query(f"WITH {_FENCE}, {bilinear_sql('SELECT * FROM fn', 'poly_id, seq, h', 'r')} SELECT poly_id, seq, round(h, 6) + 0.0 AS h, round(sampled, 6) AS value FROM r", "fence", "depths")
def surface_randomline(polygons, nodes):
    return s.sample(p.fence(polygons, 60.0), nodes, MAP, name="value").select("poly_id", "seq", rounded("h").alias("h"), rounded("value").alias("value"))


@R.query("SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax FROM points", "points")
def points_boundary(points):
    return p.boundary(points)


@R.query("SELECT pid, z >= 5000 AS hit FROM points", "points")
def points_compare(points):
    return p.compare_z(points, "ge", 5000.0).select("pid", "hit")


@R.query(f"SELECT i, j, round({XY[0]}, 6) AS x, round({XY[1]}, 6) AS y, value AS z FROM depths", "depths")
def points_from_surface(nodes):
    own = s.with_xy(nodes, MAP).where(F.col("value").isNotNull())
    return own.select("i", "j", rounded("x").alias("x"), rounded("y").alias("y"), F.col("value").alias("z"))


_CLUSTERS = """WITH RECURSIVE pr AS (SELECT a.pid AS a, b.pid AS b FROM points a JOIN points b ON a.pid <> b.pid AND (a.x - b.x)**2 + (a.y - b.y)**2 <= 144),
rc AS (SELECT pid, pid AS root FROM points UNION SELECT pr.b, rc.root FROM rc JOIN pr ON pr.a = rc.pid AND rc.root <= pr.b), cl AS (SELECT pid, min(root) AS cluster FROM rc GROUP BY pid)"""


@R.query(None, "points")
def points_merge_close(points):
    out = p.merge_close(points, 12.0)
    return out.select("cluster", *(rounded(c).alias(c) for c in "xyz"), "n")


@R.query(None, "points")
def points_merge_close_min_z(points):
    return p.merge_close(points, 12.0, "min_z")


def _recursive(sql: str) -> str:
    from terraspan.plans.views import VIEWS

    text = VIEWS["points"].replace("{", "").replace("}", "")
    return sql.replace("WITH RECURSIVE ", f"WITH RECURSIVE points AS MATERIALIZED ({text}), ", 1)


R.sql["points_merge_close"] = _recursive(f"{_CLUSTERS} SELECT cluster, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM points JOIN cl USING (pid) GROUP BY cluster")
R.sql["points_merge_close_min_z"] = _recursive(f"{_CLUSTERS} SELECT cluster, arg_min(x, (z, pid)) AS x, arg_min(y, (z, pid)) AS y, arg_min(z, (z, pid)) AS z, count(*) AS n FROM points JOIN cl USING (pid) GROUP BY cluster")
