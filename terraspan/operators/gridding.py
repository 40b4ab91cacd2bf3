"""From points to maps: interpolation on a map's nodes.

Search methods join nodes and points in tiles as wide as the search radius. Methods that solve a system or triangulate do
so tile by tile in grouped pandas functions, each with the points in reach of its tile; numpy alone is used. A method's
rule is the same for any number of points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.functions.geometry import MapHeader
from terraspan.operators.rounds import cut
from terraspan.operators.surfaces import lattice, with_xy

#: Points that a node is compared with in one row, where a method uses all points.
CHUNK = 1000
#: Points that a dense system is solved for, at most.
DENSE = 5000
#: Points of a square in which nearest ones are sought first, at most.
CROWD = 64
#: Points that a patch of radial functions has, at most; and at least, before it takes means of points around it.
PATCH, FEW = 1000, 30
#: Neighbours that tell a point's gradient.
GRADIENT = 12
#: Points of a tile that is triangulated by one task, about, before those around it.
TILE = 500


def inside_map(points: DataFrame, header: MapHeader) -> DataFrame:
    """Points within the map's outline that have a value."""
    fi, fj = header.fi(F.col("x"), F.col("y")), header.fj(F.col("x"), F.col("y"))
    return points.where(fi.between(-1e-9, header.ncol - 1 + 1e-9) & fj.between(-1e-9, header.nrow - 1 + 1e-9) & F.col("z").isNotNull())


def coarsen(points: DataFrame, every: int, order: str = "pid") -> DataFrame:
    """About every n-th point, by a hash of its id, so that no order of all points is needed."""
    return points if every <= 1 else points.where(F.pmod(F.xxhash64(order), F.lit(every)) == 0)


def auto_radius(points: DataFrame, header: MapHeader) -> float:
    """Twice the larger increment, or 1.5 times the mean spacing of points if that is more."""
    row = points.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{m}{c}") for c in "xy" for m, f in (("lo", F.min), ("hi", F.max)))).first()
    area = max(1e-12, (row.hix - row.lox) * (row.hiy - row.loy)) if row.n else 1.0
    return max(2 * max(header.xinc, header.yinc), 1.5 * math.sqrt(area / max(row.n, 1)))


def pairs(points: DataFrame, header: MapHeader, radius: float) -> DataFrame:
    """(i, j, x, y, px, py, pz, d): nodes with each point within the radius, by an equi-join on tiles."""
    tile = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = lambda c: F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col(c) / radius).cast("long") + k))
    nodes = with_xy(lattice(points.sparkSession, header), header).withColumns({"tx": tile("x"), "ty": tile("y")})
    near = points.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz")).withColumn("tx", around("px")).withColumn("ty", around("py"))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    return nodes.join(near, ["tx", "ty"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= radius).drop("tx", "ty")


def idw(points: DataFrame, header: MapHeader, power: float = 2.0, radius: float | None = None, min_points: int = 1) -> DataFrame:
    """(i, j, value): means weighted by distance ** -power of points within the radius; a point at a node gives its value.

    Without a radius all points count for every node: each node then meets the points in chunks of about CHUNK, and the
    chunks' sums are added. Nodes with fewer than min_points points are left out.
    """
    own = inside_map(points, header).select("x", "y", "z")
    if radius is not None:
        near = pairs(own, header, radius)
        w = F.pow(F.greatest(F.col("d"), F.lit(1e-10)), F.lit(-power))
        at = F.min(F.when(F.col("d") < 1e-10, F.col("pz")))
        out = near.groupBy("i", "j").agg(F.coalesce(at, F.sum(w * F.col("pz")) / F.sum(w)).alias("value"), F.count(F.lit(1)).alias("n"))
        return out.where(F.col("n") >= min_points).select("i", "j", "value")
    count = own.count()
    chunks = max(1, -(-count // CHUNK))
    dealt = own.groupBy(F.pmod(F.xxhash64("x", "y", "z"), F.lit(chunks)).cast("int").alias("__c")).agg(F.array_sort(F.collect_list(F.struct("x", "y", "z"))).alias("__p"))
    nodes = with_xy(lattice(points.sparkSession, header), header).withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    d = lambda p: F.sqrt((F.col("x") - p["x"]) * (F.col("x") - p["x"]) + (F.col("y") - p["y"]) * (F.col("y") - p["y"]))
    at = F.array_min(F.transform(F.filter("__p", lambda p: d(p) < 1e-10), lambda p: p["z"]))
    w = lambda p: F.pow(F.greatest(d(p), F.lit(1e-10)), F.lit(-power))
    sums = F.aggregate("__p", F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, p: F.struct((s["a"] + w(p) * p["z"]).alias("a"), (s["b"] + w(p)).alias("b")))
    parts = nodes.join(dealt, "__c").select("i", "j", at.alias("at"), sums.alias("s"))
    out = parts.groupBy("i", "j").agg(F.coalesce(F.min("at"), F.sum("s.a") / F.sum("s.b")).alias("value"))
    return out if count >= min_points else out.where("false")


def nearest(points: DataFrame, header: MapHeader) -> DataFrame:
    """(i, j, value): the nearest point's z (of equally near ones the least x, y, z). The radius grows until every node has one."""
    own = inside_map(points, header)
    radius = auto_radius(own, header)
    size = header.ncol * header.xinc + header.nrow * header.yinc
    nodes, done = lattice(points.sparkSession, header), None
    if not own.limit(1).count():
        return nodes.select("i", "j", F.lit(None).cast("double").alias("value")).where("false")
    while True:
        found = cut(pairs(own, header, radius).join(nodes, ["i", "j"], "left_semi").groupBy("i", "j").agg(F.min_by("pz", F.struct("d", "px", "py", "pz")).alias("value")))
        done = found if done is None else done.unionByName(found)
        if radius > size:
            return done
        nodes = cut(nodes.join(found.select("i", "j"), ["i", "j"], "left_anti"))
        if not nodes.limit(1).count():
            return done
        radius *= 4


def moving_average(points: DataFrame, header: MapHeader, radius: float, min_points: int = 3) -> DataFrame:
    """(i, j, value): the nearest-gridded map averaged over a disk; places off the map count as zero. Nodes with fewer than min_points nodes in the disk are left out."""
    near = nearest(points, header)
    ri, rj = int(radius / header.xinc), int(radius / header.yinc)
    disk = [(a, b) for a in range(-ri, ri + 1) for b in range(-rj, rj + 1) if (a * header.xinc) ** 2 + (b * header.yinc) ** 2 <= radius**2]
    if len(disk) < min_points:
        return near.where("false")
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in disk)))
    spread = near.select("value", "i", "j", steps.alias("s")).select((F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"), "value")
    out = spread.where(F.col("i").between(1, header.ncol) & F.col("j").between(1, header.nrow)).groupBy("i", "j").agg((F.sum("value") / len(disk)).alias("value"))
    return out


# --- neighbours -----------------------------------------------------------------------------------------------------


def nearest_points(targets: DataFrame, points: DataFrame, k: int, apart: bool = False) -> DataFrame:
    """targets(x, y, ...) with `near`: the k nearest of points(x, y, z), as (d, x, y, z) by distance, then place; all, if there are fewer. apart: not those at the target's own place.

    Targets and points meet in squares and the eight around them. The first squares are so small that none has over CROWD
    points; what is not sure to have found its k there goes on with squares of twice the side, so targets among many points
    meet few of them. Targets are told apart by all their columns.
    """
    names = targets.columns
    own = points.select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("z").alias("__z"))
    row = own.agg(F.count(F.lit(1)).alias("n"), *(f(f"__{c}").alias(f"{m}{c}") for c in "xy" for m, f in (("lo", F.min), ("hi", F.max)))).first()
    if not row.n:
        return targets.withColumn("near", F.array().cast("array<struct<d:double,x:double,y:double,z:double>>"))
    span = max(row.hix - row.lox, row.hiy - row.loy, 1e-9)
    at = lambda c, side: F.floor(F.col(c) / side).cast("long")
    side = span / max(1.0, math.sqrt(row.n / (k + 1)))
    while side > span * 1e-6 and own.groupBy(at("__x", side), at("__y", side)).count().agg(F.max("count")).first()[0] > CROWD:
        side /= 4
    open_, done = targets.distinct(), None
    while True:
        around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
        laid = own.withColumn("__s", around).withColumns({"__tx": at("__x", side) + F.col("__s.a"), "__ty": at("__y", side) + F.col("__s.b")}).drop("__s")
        met = open_.withColumns({"__tx": at("x", side), "__ty": at("y", side)}).join(laid, ["__tx", "__ty"], "left").drop("__tx", "__ty")
        met = met.withColumn("__d", F.hypot(F.col("x") - F.col("__x"), F.col("y") - F.col("__y")))
        wanted = F.col("__d").isNotNull() & (F.col("__d") > 0) if apart else F.col("__d").isNotNull()
        near = F.slice(F.array_sort(F.collect_list(F.when(wanted, F.struct(F.col("__d").alias("d"), F.col("__x").alias("x"), F.col("__y").alias("y"), F.col("__z").alias("z"))))), 1, k)
        found = cut(met.groupBy(*names).agg(near.alias("near")))
        # all points within a side are seen; beyond the last round's side there are none left
        last = side > 2 * span and side > 2 * _farthest(open_, row)
        sure = F.lit(last) | ((F.size("near") == k) & (F.element_at(F.col("near"), -1)["d"] <= side))
        some = found.where(F.coalesce(sure, F.lit(False)))
        done = some if done is None else done.unionByName(some)
        if last:
            return done
        open_ = cut(found.where(~F.coalesce(sure, F.lit(False))).drop("near"))
        if not open_.limit(1).count():
            return done
        side *= 2


def _farthest(targets: DataFrame, row) -> float:
    """The largest coordinate difference between targets and the points' bounds."""
    own = targets.agg(*(f(c).alias(f"{m}{c}") for c in "xy" for m, f in (("lo", F.min), ("hi", F.max)))).first()
    if own.lox is None:
        return 0.0
    return max(row.hix - own.lox, own.hix - row.lox, row.hiy - own.loy, own.hiy - row.loy)


# --- triangulation --------------------------------------------------------------------------------------------------


def delaunay(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Triangles (n, 3) of distinct points, by adding one point after the other; each test is over all triangles at once."""
    n = len(x)
    if n < 3:
        return np.zeros((0, 3), int)
    cx, cy, r = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2, max(np.ptp(x), np.ptp(y), 1e-9) * 1e3
    px, py = np.append(x, [cx - r, cx + r, cx]), np.append(y, [cy - r, cy - r, cy + r])

    def circles(t: np.ndarray) -> np.ndarray:
        ax, ay, bx, by, dx, dy = (v[t[:, k]] for k in range(3) for v in (px, py))
        # relative to the first corner, so that little is lost to cancellation
        ux, uy, vx, vy = bx - ax, by - ay, dx - ax, dy - ay
        e = 2 * (ux * vy - uy * vx)
        e = np.where(e == 0, 1e-300, e)
        ox, oy = (vy * (ux**2 + uy**2) - uy * (vx**2 + vy**2)) / e, (ux * (vx**2 + vy**2) - vx * (ux**2 + uy**2)) / e
        return np.column_stack([ax + ox, ay + oy, ox**2 + oy**2])

    tri = np.array([[n, n + 1, n + 2]])
    circle = circles(tri)
    for k in np.random.default_rng(0).permutation(n):
        bad = (circle[:, 0] - px[k]) ** 2 + (circle[:, 1] - py[k]) ** 2 < circle[:, 2] * (1 + 1e-12)
        edges = np.sort(tri[bad][:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2), axis=1)
        unique, counts = np.unique(edges, axis=0, return_counts=True)
        rim = unique[counts == 1]
        new = np.column_stack([rim, np.full(len(rim), k)])
        tri = np.concatenate([tri[~bad], new])
        circle = np.concatenate([circle[~bad], circles(new)])
    return tri[(tri < n).all(axis=1)]


def shaken(x: np.ndarray, y: np.ndarray, by: float) -> np.ndarray:
    """(n, 2): points moved by a little that only their own place tells, so that points on one circle have one triangulation, in every tile."""
    noise = [np.modf(np.sin(x * a + y * b) * 43758.5453)[0] for a, b in ((12.9898, 78.233), (39.3461, 11.135))]
    return np.column_stack([x, y]) + by * np.column_stack(noise)


def in_hull(places: DataFrame, hulls: DataFrame, slack: float) -> DataFrame:
    """Places (__g, x, y) inside of or on their group's convex ring hulls(__g, seq, x, y), or out of it by the slack at most."""
    ring = hulls.groupBy("__g").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("__r"))

    def left_of(p: Column, n: Column) -> Column:
        q = F.get("__r", n + 1)
        ex, ey = q["x"] - p["x"], q["y"] - p["y"]
        return q.isNull() | (ex * (F.col("y") - p["y"]) - ey * (F.col("x") - p["x"]) >= -slack * F.sqrt(ex * ex + ey * ey))

    return places.join(ring, "__g").where(F.forall(F.transform("__r", left_of), lambda ok: ok)).drop("__r")


def with_gradients(points: DataFrame, k: int = GRADIENT) -> DataFrame:
    """Points (__g, x, y, z) with gx and gy: the gradient there of the parabola through the point that fits its k nearest neighbours best, near ones most."""
    parts = []
    for r in points.select("__g").distinct().collect():  # a row a group
        own = points.where(F.col("__g").eqNullSafe(F.lit(r["__g"])))
        parts.append(nearest_points(own.select("__g", "x", "y", "z"), own, k, apart=True))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros((len(b), 2))
            for n, (x, y, z, near) in enumerate(zip(b["x"], b["y"], b["z"], b["near"], strict=True)):
                if not len(near):
                    continue
                d = np.array([(q["x"] - x, q["y"] - y, q["z"] - z) for q in near])
                size = np.hypot(d[:, 0], d[:, 1]).max()
                u, v = d[:, 0] / size, d[:, 1] / size
                terms = np.column_stack([u, v, u * u, u * v, v * v])[:, : 5 if len(d) >= 5 else 2]
                weight = 1 / np.hypot(u, v)
                out[n] = np.linalg.lstsq(terms * weight[:, None], d[:, 2] * weight, rcond=1e-9)[0][:2] / size
            yield b[["__g", "x", "y", "z"]].assign(gx=out[:, 0], gy=out[:, 1])

    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    schema = points.select("__g", "x", "y", "z").schema.add("gx", "double").add("gy", "double")
    return every.select("__g", "x", "y", "z", "near").mapInPandas(fit, schema)


def clough_tocher(p: np.ndarray, z: np.ndarray, g: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Values in a triangle of corners p (3, 2), values z and gradients g, at the places p0 + s (p1 - p0) + t (p2 - p0).

    A cubic on each third of the triangle (Clough and Tocher, 1965); slopes across an edge are linear along it, so that
    neighbouring triangles join smoothly, and parabolas are met exactly. By control values: at corners, at thirds of the
    edges, towards the middle m, one inside each third, and around m.
    """
    m = p.mean(axis=0)
    edge = {(a, b): z[a] + g[a] @ (p[b] - p[a]) / 3 for a in range(3) for b in range(3) if a != b}
    spoke = [z[a] + g[a] @ (m - p[a]) / 3 for a in range(3)]
    inside = {}
    for a, b in ((0, 1), (1, 2), (2, 0)):
        w = (m - p[a]) @ (p[b] - p[a]) / ((p[b] - p[a]) @ (p[b] - p[a]))  # where m falls on the edge
        first = spoke[a] - (1 - w) * z[a] - w * edge[a, b]
        last = spoke[b] - (1 - w) * edge[b, a] - w * z[b]
        inside[a, b] = inside[b, a] = (1 - w) * edge[a, b] + w * edge[b, a] + (first + last) / 2
    ring = [(spoke[a] + inside[a, (a + 1) % 3] + inside[a, (a + 2) % 3]) / 3 for a in range(3)]
    top = sum(ring) / 3
    share = np.stack([1 - s - t, s, t])
    out, low = np.empty(len(s)), share.argmin(axis=0)
    for c in range(3):
        at = low == c
        a, b = (c + 1) % 3, (c + 2) % 3
        u, v, w = share[a, at] - share[c, at], share[b, at] - share[c, at], 3 * share[c, at]
        out[at] = (
            z[a] * u**3 + 3 * edge[a, b] * u * u * v + 3 * edge[b, a] * u * v * v + z[b] * v**3
            + 3 * spoke[a] * u * u * w + 6 * inside[a, b] * u * v * w + 3 * spoke[b] * v * v * w + 3 * ring[a] * u * w * w + 3 * ring[b] * v * w * w + top * w**3
        )
    return out


def cubic(points: DataFrame, header: MapHeader, group: str | None = None, tile: int | None = None, beyond: bool = False) -> DataFrame:
    """([group,] i, j, value): smooth (one derivative) and cubic in the Delaunay triangles of the points, on linear()'s nodes and by its tiles.

    Gradients come from each point's GRADIENT nearest neighbours; planes and parabolas are met exactly.
    """
    return linear(points, header, group, tile, beyond, smooth=True)


def linear(points: DataFrame, header: MapHeader, group: str | None = None, tile: int | None = None, beyond: bool = False, smooth: bool = False) -> DataFrame:
    """([group,] i, j, value): linear in the Delaunay triangles of the points; nodes outside their hull are left out.

    Points at one place are averaged first. Tiles of nodes are triangulated with the points around them. A triangle is
    one of the whole set's if its circle, as far as the points' bounds reach, lies within the part that the tile knows;
    nodes without such a triangle are tried again with twice the points around, so any number of points will do. tile:
    columns and rows of nodes in a tile; from the number of points where it is not given. beyond: take points out of the
    map, too. smooth: see cubic().
    """
    h = header
    own = (points.where(F.col("z").isNotNull()) if beyond else inside_map(points, h)).withColumn("__g", F.col(group) if group else F.lit(0)).groupBy("__g", "x", "y").agg(F.avg("z").alias("z"))
    if smooth:
        own = cut(own)
        own = with_gradients(own) if own.limit(1).count() else own.withColumns({"gx": F.lit(0.0), "gy": F.lit(0.0)})
    own = cut(own.withColumns({"fi": h.fi(F.col("x"), F.col("y")), "fj": h.fj(F.col("x"), F.col("y"))}))
    bounds = own.groupBy("__g").agg(*(f(c).alias(f"{n}{c}") for c in ("fi", "fj") for n, f in (("lo", F.min), ("hi", F.max))), F.count(F.lit(1)).alias("n")).where("n > 2")
    most = bounds.agg(F.max(F.col("n") / (F.greatest(F.col("hifi") - F.col("lofi"), F.lit(1.0)) * F.greatest(F.col("hifj") - F.col("lofj"), F.lit(1.0))))).first()[0]
    tile = tile or max(1, int(math.sqrt(TILE / most))) if most else tile or 1
    nodes = with_xy(lattice(points.sparkSession, h), h).join(F.broadcast(bounds.select("__g")))  # a row a group
    open_ = cut(in_hull(nodes, hull(own, "__g"), 1e-9 * max(h.xinc, h.yinc)).select("__g", "i", "j", F.floor((F.col("i") - 1) / tile).cast("int").alias("ti"), F.floor((F.col("j") - 1) / tile).cast("int").alias("tj")))
    around, done = tile, None
    key = ["__g", "ti", "tj"]

    def grid(k: tuple, wanted: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"__g": [], "i": [], "j": [], "value": []})
        if len(pdf) < 3 or not len(wanted):
            return empty
        # the part that is known: the tile and so many nodes around it, as far as the points go
        lo = pdf[["lofi", "lofj"]].to_numpy()[0], np.array(k[1:]) * tile - reach
        hi = pdf[["hifi", "hifj"]].to_numpy()[0], (np.array(k[1:]) + 1) * tile + reach
        pdf = pdf.sort_values(["x", "y"])
        x, y, z, fi, fj = (pdf[c].to_numpy() for c in ("x", "y", "z", "fi", "fj"))
        slopes = pdf[["gx", "gy"]].to_numpy() if smooth else None
        triangles = delaunay(*shaken(x, y, 1e-6 * min(h.xinc, h.yinc)).T)
        if not len(triangles):
            return empty
        a, b, c = (np.column_stack([x, y])[triangles[:, n]] for n in range(3))
        u, v = b - a, c - a
        e = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
        with np.errstate(divide="ignore", invalid="ignore"):
            o = np.column_stack([v[:, 1] * (u**2).sum(1) - u[:, 1] * (v**2).sum(1), u[:, 0] * (v**2).sum(1) - v[:, 0] * (u**2).sum(1)]) / e[:, None]
        radius = np.hypot(*o.T)
        middle = a + o - [h.xori, h.yori]
        ci, cj = (middle @ [h.cos, h.sin]) / h.xinc, (middle @ [-h.sin, h.cos]) * h.yflip / h.yinc
        sure = np.isfinite(radius)
        for n, (at, r) in enumerate(((ci, radius / h.xinc), (cj, radius / h.yinc))):
            sure &= (np.maximum(at - r, lo[0][n]) >= lo[1][n]) & (np.minimum(at + r, hi[0][n]) <= hi[1][n])
        i0, j0 = (int(wanted[n].min()) - 1 for n in "ij")
        values = np.full((int(wanted["i"].max()) - i0, int(wanted["j"].max()) - j0), np.nan)
        for a, b, c in triangles[sure]:
            corner = [a, b, c]
            p0, p1 = max(i0, math.ceil(min(fi[corner]) - 1e-9)), min(i0 + values.shape[0] - 1, math.floor(max(fi[corner]) + 1e-9))
            q0, q1 = max(j0, math.ceil(min(fj[corner]) - 1e-9)), min(j0 + values.shape[1] - 1, math.floor(max(fj[corner]) + 1e-9))
            det = (fi[b] - fi[a]) * (fj[c] - fj[a]) - (fi[c] - fi[a]) * (fj[b] - fj[a])
            if p0 > p1 or q0 > q1 or abs(det) < 1e-12:
                continue
            gi, gj = np.meshgrid(np.arange(p0, p1 + 1), np.arange(q0, q1 + 1), indexing="ij")
            s = ((gi - fi[a]) * (fj[c] - fj[a]) - (gj - fj[a]) * (fi[c] - fi[a])) / det
            t = ((fi[b] - fi[a]) * (gj - fj[a]) - (fj[b] - fj[a]) * (gi - fi[a])) / det
            ok = (s >= -1e-9) & (t >= -1e-9) & (s + t <= 1 + 1e-9)
            if smooth:
                values[gi[ok] - i0, gj[ok] - j0] = clough_tocher(np.column_stack([x, y])[corner], z[corner], slopes[corner], s[ok], t[ok])
            else:
                values[gi[ok] - i0, gj[ok] - j0] = (z[a] + s * (z[b] - z[a]) + t * (z[c] - z[a]))[ok]
        out = wanted[["__g", "i", "j"]].assign(value=values[wanted["i"] - 1 - i0, wanted["j"] - 1 - j0])
        return out[np.isfinite(out["value"])]

    span = math.hypot(h.ncol, h.nrow)
    while True:
        reach = around
        first = lambda c: F.floor((F.col(c) - reach) / tile).cast("int")  # noqa: E731, B023
        last = lambda c: F.floor((F.col(c) + reach) / tile).cast("int")  # noqa: E731, B023
        tiles = open_.select(*key).distinct()
        near = own.withColumn("ti", F.explode(F.sequence(first("fi"), last("fi")))).withColumn("tj", F.explode(F.sequence(first("fj"), last("fj")))).join(tiles, key, "left_semi").join(bounds.drop("n"), "__g")
        near = near.select(*(F.col(c).alias(c) for c in near.columns))  # columns of its own, as both sides come from the points
        found = cut(open_.groupBy(*key).cogroup(near.groupBy(*key)).applyInPandas(grid, own.select("__g").schema.add("i", "integer").add("j", "integer").add("value", "double")))
        done = found if done is None else done.unionByName(found)
        open_ = cut(open_.join(found.select("__g", "i", "j"), ["__g", "i", "j"], "left_anti"))
        if around > span or not open_.limit(1).count():
            break
        around *= 2
    return done.withColumnRenamed("__g", group) if group else done.drop("__g")


def from_cells(cells: DataFrame, header: MapHeader, prop: str, zones: tuple[int, int] | None = None, zone: str = "zone", coarsen: int = 1, by_zone: bool = False, summing: bool = False, truncate_le: float | None = None) -> DataFrame:
    """(i, j, value): a property's mean over depth, weighted by thickness, on the nodes of a map; or (summing) its sum, for a property that is a thickness.

    Each layer (by_zone: each zone, averaged or summed in each column first) is gridded by linear(), from the centres of
    every coarsen-th column and row; inactive cells have no thickness. Layers count as zero beyond their hull. Means under
    truncate_le are left out, and so are nodes without thickness.
    """
    from terraspan.operators import cells as c

    own = c.with_centre(cells).withColumn("__dz", F.when(F.col("actnum") == 1, c.dz()).otherwise(0.0))
    if zones:
        own = own.where(F.col(zone).between(*zones))
    own = own.where(((F.col("i") - 1) % coarsen == 0) & ((F.col("j") - 1) % coarsen == 0))
    own = own.withColumn("__m", F.coalesce(F.col(prop) if summing else F.col(prop) * F.col("__dz"), F.lit(0.0)))
    layer = F.col(zone if by_zone else "k").alias("__layer")
    flat = own.groupBy(layer, "i", "j").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.sum(F.when(F.col("actnum") == 1, F.col("__m")).otherwise(0.0)).alias("__m"), F.sum("__dz").alias("__dz"))
    gridded = lambda v: linear(flat.select("__layer", "x", "y", F.col(v).alias("z")), header, "__layer", beyond=True).groupBy("i", "j").agg(F.sum("value").alias(v))
    if summing:
        return gridded("__m").withColumnRenamed("__m", "value")
    out = gridded("__m").join(gridded("__dz"), ["i", "j"]).where(F.col("__dz") > 1e-20).select("i", "j", (F.col("__m") / F.col("__dz")).alias("value"))
    return out if truncate_le is None else out.where(F.col("value") >= truncate_le)


# --- systems --------------------------------------------------------------------------------------------------------

#: Radial functions by their usual names; r is the distance times epsilon.
KERNELS = {
    "linear": lambda r: -r, "thin_plate_spline": lambda r: np.where(r > 0, r**2 * np.log(np.where(r > 0, r, 1)), 0.0), "cubic": lambda r: r**3, "quintic": lambda r: -(r**5),
    "multiquadric": lambda r: -np.sqrt(1 + r**2), "inverse_multiquadric": lambda r: 1 / np.sqrt(1 + r**2), "inverse_quadratic": lambda r: 1 / (1 + r**2), "gaussian": lambda r: np.exp(-(r**2)),
}
SCALED = ("multiquadric", "inverse_multiquadric", "inverse_quadratic", "gaussian")


class RadialFunctions:
    """The functions of one set of points, with a plane; it is exact at the points without smoothing."""

    def __init__(self, xy: np.ndarray, z: np.ndarray, function: str, smoothing: float, epsilon: float | None):
        self.middle, self.width = xy.mean(axis=0), max(np.ptp(xy, axis=0).max(), 1e-12)
        self.points, self.kernel, n = (xy - self.middle) / self.width, KERNELS[function], len(z)
        d = self._distances(self.points)
        if epsilon is None:
            self.epsilon = 1 / max(1e-12, np.sort(d, axis=1)[:, 1 : min(6, n)].mean()) if function in SCALED and n > 1 else 1.0
        else:
            self.epsilon = epsilon * self.width
        system = np.zeros((n + 3, n + 3))
        system[:n, :n] = self.kernel(d * self.epsilon) + smoothing * np.eye(n)
        system[:n, n:] = np.column_stack([np.ones(n), self.points])
        system[n:, :n] = system[:n, n:].T
        right = np.append(z, np.zeros(3))
        try:
            self.weights = np.linalg.solve(system, right)
            ok = np.abs(system @ self.weights - right).max() <= 1e-6 * max(1.0, np.abs(right).max())
        except np.linalg.LinAlgError:
            ok = False
        if not ok:  # points on a line, or nearly one system twice
            self.weights = np.linalg.lstsq(system, right, rcond=None)[0]

    def _distances(self, q: np.ndarray) -> np.ndarray:
        return np.hypot(q[:, None, 0] - self.points[None, :, 0], q[:, None, 1] - self.points[None, :, 1])

    def at(self, xy: np.ndarray) -> np.ndarray:
        q, n = (xy - self.middle) / self.width, len(self.points)
        value = self.weights[n] + q @ self.weights[n + 1 :]
        for k in range(0, len(q), 1000):
            value[k : k + 1000] += self.kernel(self._distances(q[k : k + 1000]) * self.epsilon) @ self.weights[:n]
        return value


#: How far a patch reaches over the edge of its square, as a part of the side; nodes that are evaluated in one task.
OVER, NODES = 0.25, 1 << 16


def _squares(x: str, y: str, level: Column | int, side: float) -> Column:
    """The squares (a, b) of a level whose patches hold a place: one to four."""
    width = F.lit(float(side)) / F.pow(F.lit(2.0), level)
    first, last = (lambda c: F.floor(F.col(c) / width - OVER).cast("int")), (lambda c: F.floor(F.col(c) / width + OVER).cast("int"))
    along = lambda c: F.array_distinct(F.array(first(c), last(c)))
    return F.flatten(F.transform(along(x), lambda a: F.transform(along(y), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def patches(own: DataFrame, side: float) -> tuple[DataFrame, DataFrame]:
    """(leaves (level, a, b), their points (level, a, b, u, v, z)) of points (u, v, z): squares, halved while their patch has over PATCH points.

    A patch of fewer than FEW points also gets means of the points in its parent's patch, one for each of 32 by 32 cells.
    """
    key = ["level", "a", "b"]
    open_ = own.sparkSession.createDataFrame([(0, 0, 0)], "level int, a int, b int")
    leaves, held, level, before = None, None, 0, None
    while True:
        laid = own.withColumn("__s", F.explode(_squares("u", "v", level, side))).select(F.lit(level).alias("level"), "__s.a", "__s.b", "u", "v", "z")
        laid = cut(laid.join(open_, key, "left_semi"))
        counts = cut(open_.join(laid.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key, "left").fillna(0, ["n"]))
        small = counts.where(F.col("n") <= PATCH)
        mine = laid.join(small.select(*key), key, "left_semi")
        if before is not None:
            few = small.where(F.col("n") < FEW).select(*key, F.lit(level - 1).alias("p"), F.shiftright("a", 1).alias("pa"), F.shiftright("b", 1).alias("pb"))
            fine = F.lit(float(side)) / F.pow(F.lit(2.0), F.lit(level + 4))  # a 32nd of the parent's side
            width = F.lit(float(side)) / F.pow(F.lit(2.0), F.lit(level))
            means = before.groupBy("level", "a", "b", F.floor(F.col("u") / fine), F.floor(F.col("v") / fine)).agg(*(F.avg(c).alias(c) for c in "uvz")).select(F.col("level").alias("p"), F.col("a").alias("pa"), F.col("b").alias("pb"), "u", "v", "z")
            apart = lambda c, k: F.abs(F.col(c) / width - (F.col(k) + 0.5)) > 0.5 + OVER  # noqa: E731, B023
            mine = mine.unionByName(few.join(means, ["p", "pa", "pb"]).where(apart("u", "a") | apart("v", "b")).select(*key, "u", "v", "z"))
        small, mine = cut(small.select(*key)), cut(mine)
        leaves, held = (small, mine) if leaves is None else (leaves.unionByName(small), held.unionByName(mine))
        halved = F.explode(F.array(*(F.struct((F.col("a") * 2 + x).alias("a"), (F.col("b") * 2 + y).alias("b")) for x in (0, 1) for y in (0, 1))))
        large = counts.where(F.col("n") > PATCH).select(*key)
        if not large.limit(1).count():
            return leaves, held
        if level >= 30:
            raise ValueError("points lie too close together to be told apart")
        before = laid.join(large, key, "left_semi")
        open_ = cut(large.withColumn("__c", halved).select(F.lit(level + 1).alias("level"), "__c.a", "__c.b"))
        level += 1


def rbf(points: DataFrame, header: MapHeader, function: str = "thin_plate_spline", smoothing: float = 0.0, epsilon: float | None = None) -> DataFrame:
    """(i, j, value): radial functions with a plane through the points.

    The map is halved into squares until each has PATCH points at most, with a margin that it shares with its neighbours.
    Each patch has functions of its own, and where patches overlap they are blended by weights that fall to zero at a
    patch's rim (a partition of unity), so the result is smooth, and exact at points. Up to PATCH points are one patch,
    which is the system of all points. Points at one place are averaged.
    """
    h = header
    own = inside_map(points, h).groupBy("x", "y").agg(F.avg("z").alias("z"))
    side = max((h.ncol - 1) * h.xinc, (h.nrow - 1) * h.yinc, 1e-9) * (1 + 1e-6)
    place = {"u": h.fi(F.col("x"), F.col("y")) * h.xinc, "v": h.fj(F.col("x"), F.col("y")) * h.yinc}
    own = cut(own.select(*(F.greatest(F.lit(0.0), F.least(c, F.lit(side * (1 - 1e-9)))).alias(k) for k, c in place.items()), "z"))
    if own.limit(3).count() < 3:
        raise ValueError("three points or more are asked for")
    leaves, held = patches(own, side)
    levels = [r[0] for r in leaves.select("level").distinct().collect()]  # 31 at most
    nodes = lattice(points.sparkSession, h).withColumns({"u": (F.col("i") - 1) * float(h.xinc), "v": (F.col("j") - 1) * float(h.yinc)})
    at = F.explode(F.flatten(F.array(*(_named(_squares("u", "v", n, side), n) for n in levels))))
    tile = int(math.sqrt(NODES))
    asked = nodes.withColumn("__s", at).select("__s.level", "__s.a", "__s.b", F.floor((F.col("i") - 1) / tile).cast("int").alias("ti"), F.floor((F.col("j") - 1) / tile).cast("int").alias("tj"), "i", "j", "u", "v").join(leaves, ["level", "a", "b"], "left_semi")
    asked = cut(asked)
    key = ["level", "a", "b", "ti", "tj"]
    dealt = held.join(asked.select(*key).distinct(), ["level", "a", "b"])
    dealt = dealt.select(*(F.col(c).alias(c) for c in dealt.columns))  # columns of its own, as both sides come from the nodes

    def evaluate(k: tuple, wanted: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(wanted):
            return pd.DataFrame({"i": [], "j": [], "w": [], "wz": []})
        pdf = pdf.sort_values(["u", "v"])
        made = RadialFunctions(pdf[["u", "v"]].to_numpy(), pdf["z"].to_numpy(), function, smoothing, epsilon)
        q = wanted[["u", "v"]].to_numpy()
        width = side / 2 ** k[0]
        off = np.abs(q / width - (np.array(k[1:3]) + 0.5)) / (0.5 + OVER)
        weight = np.prod(np.maximum(1 - off**2, 1e-12) ** 2, axis=1)
        return pd.DataFrame({"i": wanted["i"], "j": wanted["j"], "w": weight, "wz": weight * made.at(q)})

    out = asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(evaluate, "i int, j int, w double, wz double")
    return out.groupBy("i", "j").agg((F.sum("wz") / F.sum("w")).alias("value"))


def _named(squares: Column, level: int) -> Column:
    return F.transform(squares, lambda s: F.struct(F.lit(level).alias("level"), s["a"].alias("a"), s["b"].alias("b")))


#: Correlation at a distance in ranges; at one range about 5 % is left, for the spherical model nothing.
VARIOGRAMS = {
    "exponential": lambda h: np.exp(-3 * h), "gaussian": lambda h: np.exp(-3 * h**2), "spherical": lambda h: np.where(h < 1, 1 - 1.5 * h + 0.5 * h**3, 0.0), "cubic": lambda h: np.where(h < 1, 1 - 7 * h**2 + 8.75 * h**3 - 3.5 * h**5 + 0.75 * h**7, 0.0),
    "stable": lambda h: np.exp(-3 * h**1.5), "linear": lambda h: np.maximum(0.0, 1 - h),
    "matern": lambda h: (1 + 4.7439 * h) * np.exp(-4.7439 * h), "matern52": lambda h: (1 + 5.9186 * h + (5.9186 * h) ** 2 / 3) * np.exp(-5.9186 * h),
}


def variogram(points: DataFrame, header: MapHeader, lags: int = 20, longest: float | None = None, most: int = 20_000) -> DataFrame:
    """(lag, n, distance, gamma): half the mean squared difference of pairs of points, by their distance, in `lags` steps up to `longest` (a third of the map's diagonal).

    Pairs meet in squares as wide as the longest distance, and are counted once, by bins. Of more than `most` points a
    share of about so many, by a hash of their places, is used: the documented sample of this estimate.
    """
    h = header
    own = inside_map(points, h).groupBy("x", "y").agg(F.avg("z").alias("z"))
    every = -(-own.count() // most)
    own = own.where(F.pmod(F.xxhash64("x", "y"), F.lit(max(1, every))) == 0)
    longest = longest or math.hypot((h.ncol - 1) * h.xinc, (h.nrow - 1) * h.yinc) / 3
    at = lambda c: F.floor(F.col(c) / longest).cast("long")
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    other = own.select(F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz")).withColumn("s", around).withColumns({"tx": at("ox") + F.col("s.a"), "ty": at("oy") + F.col("s.b")})
    met = own.withColumns({"tx": at("x"), "ty": at("y")}).join(other, ["tx", "ty"]).where("x < ox or (x = ox and y < oy)")
    met = met.select(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")).alias("d"), F.pow(F.col("z") - F.col("oz"), 2).alias("q")).where(F.col("d") <= longest)
    lag = F.least(F.floor(F.col("d") / longest * lags), F.lit(lags - 1)).cast("int").alias("lag")
    return met.groupBy(lag).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("distance"), (F.avg("q") / 2).alias("gamma"))


def fitted(points: DataFrame, header: MapHeader, model: str = "gaussian", lags: int = 20, longest: float | None = None) -> dict[str, float]:
    """range_, variance and nugget of a model that fit variogram() best, bins by their number of pairs. For kriging(**fitted(...))."""
    rows = sorted(variogram(points, header, lags, longest).collect())  # a row a lag
    if not rows:
        raise ValueError("no pairs of points")
    n, d, gamma = (np.array([float(r[k]) for r in rows]) for k in ("n", "distance", "gamma"))
    best = None
    for range_ in d.max() * np.geomspace(0.05, 3, 120):
        rise = 1 - VARIOGRAMS[model](d / range_)
        for terms in (np.column_stack([rise, np.ones(len(d))]), rise[:, None]):
            got = np.linalg.lstsq(terms * np.sqrt(n)[:, None], gamma * np.sqrt(n), rcond=None)[0]
            sill, nugget = got[0], got[1] if len(got) > 1 else 0.0
            if sill > 0 and nugget >= 0:
                off = float((n * (terms @ got - gamma) ** 2).sum())
                if best is None or off < best[0] * (1 - 1e-9):
                    best = off, range_, sill, nugget
    if best is None:
        return {"range_": float(d.max()), "variance": max(float((n * gamma).sum() / n.sum()), 1e-12), "nugget": 0.0}
    return {"range_": float(best[1]), "variance": float(best[2]), "nugget": float(best[3])}


def kriging_by_neighbours(points: DataFrame, header: MapHeader, neighbours: int = 24, model: str = "gaussian", range_: float = 1000.0, nugget: float = 0.0, variance: float = 1.0, angle: float = 0.0, ratio: float = 1.0, mean: float | None = None) -> DataFrame:
    """(i, j, value): kriging() with each node's own system, of its nearest points alone, at any distance. angle and ratio as there; nearest is by plain distance."""
    own = cut(inside_map(points, header).groupBy("x", "y").agg(F.avg("z").alias("z")))
    near = nearest_points(with_xy(lattice(points.sparkSession, header), header), own, neighbours)
    c, s, rho, free = math.cos(math.radians(angle)), math.sin(math.radians(angle)), VARIOGRAMS[model], mean is None

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def cov(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
            return variance * rho(np.hypot(dx * c + dy * s, (dy * c - dx * s) / ratio) / range_)

        for b in batches:
            out, sizes = np.full(len(b), np.nan), b["near"].map(len).to_numpy()
            for k in set(sizes.tolist()) - {0}:  # one size but at the rim
                for at in np.array_split(np.flatnonzero(sizes == k), -(-(sizes == k).sum() // 500)):
                    p = np.array([[(q["x"], q["y"], q["z"]) for q in b["near"].iloc[n]] for n in at])
                    left, right = np.zeros((len(at), k + free, k + free)), np.ones((len(at), k + free))
                    left[:, :k, :k] = cov(p[:, :, None, 0] - p[:, None, :, 0], p[:, :, None, 1] - p[:, None, :, 1]) + (nugget + 1e-10 * variance) * np.eye(k)
                    right[:, :k] = cov(p[:, :, 0] - b["x"].to_numpy()[at, None], p[:, :, 1] - b["y"].to_numpy()[at, None])
                    if free:
                        left[:, k, :k] = left[:, :k, k] = 1
                    w = np.linalg.solve(left, right[..., None])[:, :k, 0]
                    out[at] = (w * p[..., 2]).sum(1) if free else mean + (w * (p[..., 2] - mean)).sum(1)
            yield pd.DataFrame({"i": b["i"], "j": b["j"], "value": out})

    return near.select("i", "j", "x", "y", "near").mapInPandas(solve, "i int, j int, value double").where("value is not null and not isnan(value)")


def kriging(points: DataFrame, header: MapHeader, model: str = "gaussian", range_: float = 1000.0, nugget: float = 0.0, variance: float = 1.0, angle: float = 0.0, ratio: float = 1.0, mean: float | None = None, max_points: int | None = None, block: int = 25) -> DataFrame:
    """(i, j, value): ordinary kriging, or simple kriging about a known mean.

    angle and ratio: the direction of the long range (degrees from east) and the short range as a share of it. Nodes are
    taken in blocks of block by block; a block uses all points within two ranges of it. Of more than DENSE points (or
    max_points) the block is halved, and each half uses those within two ranges of it; too many for one node are an
    error. Nodes of which no point is in reach get the mean: the known one, or that of all points.
    """
    own = inside_map(points, header).groupBy("x", "y").agg(F.avg("z").alias("z"))
    reach, h = 2 * range_, header
    bi, bj = math.ceil(h.ncol / block), math.ceil(h.nrow / block)
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    # blocks are few and known; each point goes to the blocks it is in reach of, by arithmetic on its place in the map
    fi, fj = h.fi(F.col("x"), F.col("y")) * h.xinc, h.fj(F.col("x"), F.col("y")) * h.yinc
    first = lambda f, inc: F.greatest(F.lit(0), F.floor((f - reach) / (block * inc))).cast("int")
    last = lambda f, inc, n: F.least(F.lit(n - 1), F.floor((f + reach) / (block * inc))).cast("int")
    dealt = own.withColumn("bi", F.explode(F.sequence(first(fi, h.xinc), last(fi, h.xinc, bi)))).withColumn("bj", F.explode(F.sequence(first(fj, h.yinc), last(fj, h.yinc, bj))))
    rho = VARIOGRAMS[model]

    most = max_points or DENSE

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = (v.ravel() for v in np.meshgrid(np.arange(key[0] * block, min(h.ncol, (key[0] + 1) * block)), np.arange(key[1] * block, min(h.nrow, (key[1] + 1) * block)), indexing="ij"))
        return nodes(i, j, *(pdf[k].to_numpy() for k in "xyz"))

    def nodes(i: np.ndarray, j: np.ndarray, px: np.ndarray, py: np.ndarray, z: np.ndarray) -> pd.DataFrame:
        if len(px) > most:
            if len(i) == 1:
                raise ValueError(f"{len(px)} points within two ranges of a node; coarsen to {most}")
            longer = i if np.ptp(i) >= np.ptp(j) else j
            low = longer <= (longer.min() + longer.max()) // 2
            fi, fj = ((px - h.xori) * h.cos + (py - h.yori) * h.sin) / h.xinc, ((py - h.yori) * h.cos - (px - h.xori) * h.sin) * h.yflip / h.yinc
            out = []
            for own in (low, ~low):
                u, v = i[own], j[own]
                near = (fi >= u.min() - reach / h.xinc) & (fi <= u.max() + reach / h.xinc) & (fj >= v.min() - reach / h.yinc) & (fj <= v.max() + reach / h.yinc)
                out += [nodes(u, v, px[near], py[near], z[near])] if near.any() else []
            return pd.concat(out) if out else pd.DataFrame({"i": np.zeros(0, np.int32), "j": np.zeros(0, np.int32), "value": np.zeros(0)})
        x = h.xori + i * h.xinc * h.cos - j * h.yflip * h.yinc * h.sin
        y = h.yori + i * h.xinc * h.sin + j * h.yflip * h.yinc * h.cos

        def cov(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
            dx, dy = ax[:, None] - bx[None, :], ay[:, None] - by[None, :]
            return variance * rho(np.hypot(dx * c + dy * s, (dy * c - dx * s) / ratio) / range_)

        n, free = len(px), mean is None
        a = np.zeros((n + free, n + free))
        a[:n, :n] = cov(px, py, px, py) + (nugget + 1e-10 * variance) * np.eye(n)
        b = np.ones((n + free, len(x)))
        b[:n] = cov(px, py, x, y)
        if free:
            a[n, :n] = a[:n, n] = 1
        w = np.linalg.lstsq(a, b, rcond=None)[0][:n]
        value = z @ w if free else mean + (z - mean) @ w
        return pd.DataFrame({"i": (i + 1).astype(np.int32), "j": (j + 1).astype(np.int32), "value": value})

    solved = dealt.groupBy("bi", "bj").applyInPandas(solve, "i int, j int, value double")
    average = own.agg(F.avg("z").alias("__mean")) if mean is None else points.sparkSession.range(1).select(F.lit(float(mean)).alias("__mean"))  # one row
    every = lattice(points.sparkSession, header).join(F.broadcast(average)).join(solved, ["i", "j"], "left")
    return every.select("i", "j", F.coalesce("value", "__mean").alias("value")).where("value is not null")


# --- outlines -------------------------------------------------------------------------------------------------------


def hull(points: DataFrame, group: str) -> DataFrame:
    """(group, seq, x, y): the closed convex hull of each group's points, counter-clockwise.

    Groups may be large: points are first reduced to the hulls of their batches, so one task sees only hull points.
    """

    def ring(p: np.ndarray) -> np.ndarray:
        p = np.unique(p, axis=0)  # by x, then y
        if len(p) < 3:
            return p
        half = []
        for own in (p, p[::-1]):
            out: list[np.ndarray] = []
            for q in own:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(q)
            half.append(out[:-1])
        return np.array(half[0] + half[1])

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, pdf in b.groupby(group):
                r = ring(pdf[["x", "y"]].to_numpy())
                yield pd.DataFrame({group: g, "x": r[:, 0], "y": r[:, 1]})

    def final(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = ring(pdf[["x", "y"]].to_numpy())
        r = np.concatenate([r, r[:1]])
        return pd.DataFrame({group: key[0], "seq": np.arange(len(r), dtype=np.int32), "x": r[:, 0], "y": r[:, 1]})

    slim = points.select(group, "x", "y")
    schema = slim.select(group).schema.add("seq", "integer").add("x", "double").add("y", "double")
    return slim.mapInPandas(some, slim.schema).groupBy(group).applyInPandas(final, schema)


def alpha_shape(points: DataFrame, group: str, alpha: float) -> DataFrame:
    """(group, poly_id, seq, x, y): closed rings around the Delaunay triangles whose circumradius is under alpha.

    A triangle's points lie within two radii of each other, so tiles with the points up to two alphas around them hold all
    triangles of their own points. What one task sees of a group in the end is its outline.
    """
    size = 4 * alpha
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 2 * alpha) / size).cast("long"), F.floor((F.col(c) + 2 * alpha) / size).cast("long")))
    slim = points.select(F.col(group).alias("__g"), "x", "y").distinct()
    dealt = slim.withColumn("tx", tiles("x")).withColumn("ty", tiles("y"))

    def edges(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.unique(pdf[["x", "y"]].to_numpy(), axis=0)
        t = delaunay(*shaken(p[:, 0], p[:, 1], 1e-6 * alpha).T)
        a, b, c = (p[t[:, k]] for k in range(3))
        la, lb, lc = (np.hypot(*(u - v).T) for u, v in ((b, c), (a, c), (a, b)))
        area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / 2
        # a triangle belongs to the tile of its least point
        least = p[t.min(axis=1)] if len(t) else p[:0]
        mine = (np.floor(least[:, 0] / size) == key[1]) & (np.floor(least[:, 1] / size) == key[2])
        t = t[mine & (area > 0) & (la * lb * lc / np.maximum(4 * area, 1e-300) < alpha)]
        e = np.sort(t[:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2), axis=1)
        u, v = p[e[:, 0]], p[e[:, 1]]
        return pd.DataFrame({"__g": key[0], "ax": u[:, 0], "ay": u[:, 1], "bx": v[:, 0], "by": v[:, 1]})

    of = slim.select("__g").schema
    found = dealt.groupBy("__g", "tx", "ty").applyInPandas(edges, of.add("ax", "double").add("ay", "double").add("bx", "double").add("by", "double"))
    rim = found.groupBy("__g", "ax", "ay", "bx", "by").count().where("count = 1")

    def rings(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left: dict[tuple, list[tuple]] = {}
        for ax, ay, bx, by in sorted(zip(pdf["ax"], pdf["ay"], pdf["bx"], pdf["by"], strict=True)):
            left.setdefault((ax, ay), []).append((bx, by))
            left.setdefault((bx, by), []).append((ax, ay))
        rows, n = [], 0
        for start in sorted(left):
            while left[start]:
                ring, at = [start], start
                while left[at]:
                    nxt = left[at].pop()
                    left[nxt].remove(at)
                    ring.append(nxt)
                    at = nxt
                    if at == start:
                        break
                rows += [(key[0], n, k, *v) for k, v in enumerate(ring)]
                n += 1
        return pd.DataFrame(rows, columns=["__g", "poly_id", "seq", "x", "y"])

    out = slim.select("__g").schema.add("poly_id", "integer").add("seq", "integer").add("x", "double").add("y", "double")
    return rim.groupBy("__g").applyInPandas(rings, out).withColumnRenamed("__g", group)


def outline(cells: DataFrame, alpha_factor: float = 1.0, convex: bool = False, tolerance: float = 0.0) -> DataFrame:
    """(poly_id, seq, x, y): rings around the columns that have active cells, through the columns' centres.

    The rings are the alpha shape of the centres, its radius alpha_factor times a mean column's diagonal, or their convex
    hull; with a tolerance, simplified.
    """
    from terraspan.operators import cells as c

    own = c.with_centre(cells.where("actnum = 1")).withColumns({"__dx": c.dx(), "__dy": c.dy()}).groupBy("i", "j").agg(*(F.avg(a).alias(a) for a in ("x", "y", "__dx", "__dy")))
    places = own.select(F.lit(0).alias("poly_id"), "x", "y")
    if convex:
        rings = hull(places, "poly_id")
    else:
        size = own.agg(F.avg("__dx"), F.avg("__dy")).first()
        alpha = alpha_factor * math.hypot(size[0] or 1.0, size[1] or 1.0)
        rings = alpha_shape(places.withColumnRenamed("poly_id", "__all"), "__all", alpha).drop("__all")
    return simplify(rings, tolerance) if tolerance else rings


def simplify(polygons: DataFrame, tolerance: float) -> DataFrame:
    """Polylines with only the vertices that Douglas and Peucker's method keeps; ends of open lines and the start of rings stay."""

    def keep(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ignore_index=True)
        p = pdf[["x", "y"]].to_numpy()
        kept = np.zeros(len(p), bool)
        kept[[0, -1]] = True
        stack = [(0, len(p) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            d = p[b] - p[a]
            q = p[a + 1 : b] - p[a]
            n = d @ d
            t = np.clip(q @ d / n, 0, 1) if n else np.zeros(len(q))
            far = np.hypot(*(q - t[:, None] * d).T)
            k = int(far.argmax())
            if far[k] > tolerance:
                kept[a + 1 + k] = True
                stack += [(a, a + 1 + k), (a + 1 + k, b)]
        return pdf[kept]

    return polygons.groupBy("poly_id").applyInPandas(keep, polygons.schema)

