"""Maps: nodes(i, j, value) under a MapHeader; a stack of maps has a further column. A masked node is null or absent.

Maps are joined on (i, j), and sampled by an equi-join on the node below a place, so any number of places and nodes works.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraspan.functions import geometry as g
from terraspan.functions.geometry import MapHeader
from terraspan.operators.rounds import cut

OPERATIONS = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: F.try_divide(a, b),
    "lt": lambda a, b: a < b, "gt": lambda a, b: a > b, "le": lambda a, b: a <= b, "ge": lambda a, b: a >= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b,
}


# --- sources --------------------------------------------------------------------------------------------------------


def lattice(spark: SparkSession, header: MapHeader) -> DataFrame:
    """All (i, j) of a map."""
    n = F.col("id")
    return spark.range(header.ncol * header.nrow).select((F.floor(n / header.nrow) + 1).cast("int").alias("i"), (n % header.nrow + 1).cast("int").alias("j"))


def constant(spark: SparkSession, header: MapHeader, value: float) -> DataFrame:
    return lattice(spark, header).withColumn("value", F.lit(float(value)))


def synthetic(spark: SparkSession, header: MapHeader, rx: float = 0.0, ry: float = 0.0, rz: float = 0.0, top: float = 0.0, dip: float = 0.0, azimuth: float = 0.0, centroid: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """A plane that dips `dip` degrees towards an azimuth, with an ellipsoidal dome of half axes rx, ry, rz around the centroid; its least value is `top`."""
    lat = lattice(spark, header)
    i, j = F.col("i"), F.col("j")
    u, v = (i - 1) * header.xinc - centroid[0] * (header.ncol - 1) * header.xinc, (j - 1) * header.yinc - centroid[1] * (header.nrow - 1) * header.yinc
    x, y = header.x(i, j) - header.xori, header.y(i, j) - header.yori
    a = math.radians(azimuth)
    z = (x * math.sin(a) + y * math.cos(a)) * math.tan(math.radians(dip))
    if rx > 0 and ry > 0 and rz:
        z = z - rz * F.sqrt(F.greatest(F.lit(0.0), 1 - (u / rx) * (u / rx) - (v / ry) * (v / ry)))
    raw = lat.withColumn("__z", z)
    least = raw.agg(F.min("__z").alias("__least"))  # one row
    return raw.join(F.broadcast(least)).select("i", "j", (F.col("__z") - F.col("__least") + top).alias("value"))


# --- views ----------------------------------------------------------------------------------------------------------


def with_xy(nodes: DataFrame, header: MapHeader) -> DataFrame:
    return nodes.withColumns({"x": header.x(F.col("i"), F.col("j")), "y": header.y(F.col("i"), F.col("j"))})


def table(nodes: DataFrame, header: MapHeader, active_only: bool = True, fill: float | None = None) -> DataFrame:
    """IX, JY, X_UTME, Y_UTMN, VALUES of the nodes; of masked nodes too if not active_only, with `fill` as value."""
    own = nodes
    if not active_only:
        own = lattice(nodes.sparkSession, header).join(nodes.select("i", "j", "value"), ["i", "j"], "left")
        own = own.withColumn("value", F.coalesce("value", F.lit(fill).cast("double")))
    else:
        own = own.where(F.col("value").isNotNull())
    return with_xy(own, header).select(F.col("i").alias("IX"), F.col("j").alias("JY"), F.col("x").alias("X_UTME"), F.col("y").alias("Y_UTMN"), F.col("value").alias("VALUES"))


def describe(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("value").alias("nactive"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def content_hash(nodes: DataFrame) -> DataFrame:
    """One row: the nodes' number, and a hash of their content, the same on any engine and in any order of rows.

    It is the sum, as a text, of the first 60 bits of the MD5 of each node's "i|j|value", the value in millionths, rounded.
    """
    value = F.coalesce(F.floor(F.col("value") * 1000000.0 + 0.5).cast("long").cast("string"), F.lit("null"))
    digest = F.md5(F.concat_ws("|", F.col("i").cast("string"), F.col("j").cast("string"), value))
    return nodes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias("hash"))


# --- stacks ---------------------------------------------------------------------------------------------------------


def statistics(nodes: DataFrame, percentiles: Sequence[float] = (10, 50, 90)) -> DataFrame:
    """Per node over all maps of a stack: mean, std (n - 1), and percentiles by linear interpolation. Masked values are skipped."""
    p = F.percentile("value", F.array(*(F.lit(q / 100.0) for q in percentiles)))
    out = nodes.groupBy("i", "j").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), p.alias("__p"))
    return out.select("i", "j", "mean", "std", *(F.get("__p", F.lit(k)).alias(f"p{q:g}") for k, q in enumerate(percentiles)))


def reduce_stack(nodes: DataFrame, how: Column) -> DataFrame:
    """Any aggregate of `value` over the stack, a pandas UDF of one series among them."""
    return nodes.groupBy("i", "j").agg(how.alias("value"))


def is_depth_consistent(nodes: DataFrame, order: str) -> DataFrame:
    """One row, consistent: no map lies above the one before it at any node."""
    w = Window.partitionBy("i", "j").orderBy(order)
    bad = F.col("value") < F.lag("value").over(w)
    return nodes.select(F.coalesce(bad, F.lit(False)).alias("bad")).agg((~F.coalesce(F.max("bad"), F.lit(False))).alias("consistent"))


def make_depth_consistent(nodes: DataFrame, order: str) -> DataFrame:
    """Each map pushed down to the deepest one before it; masked nodes stay masked."""
    w = Window.partitionBy("i", "j").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("value", F.when(F.col("value").isNotNull(), F.max("value").over(w)))


# --- map algebra ----------------------------------------------------------------------------------------------------


def scalar(nodes: DataFrame, operation: str, value: float) -> DataFrame:
    """value op number; division by zero masks."""
    return nodes.withColumn("value", OPERATIONS[operation](F.col("value"), F.lit(float(value))))


def combine(a: DataFrame, b: DataFrame, operation: str, header_a: MapHeader | None = None, header_b: MapHeader | None = None) -> DataFrame:
    """Node by node, comparisons give booleans; a map of another geometry is resampled first. A node masked in one is masked."""
    if header_a and header_b and header_a != header_b:
        b = resample(b, header_b, header_a)
    other = b.where(F.col("value").isNotNull()).select("i", "j", F.col("value").alias("__other"))
    return a.where(F.col("value").isNotNull()).select("i", "j", "value").join(other, ["i", "j"]).select("i", "j", OPERATIONS[operation](F.col("value"), F.col("__other")).alias("value"))


def same_topology(a: MapHeader, b: MapHeader, tolerance: float = 1e-6) -> bool:
    return all(abs(float(x) - float(y)) <= tolerance for x, y in zip(vars(a).values(), vars(b).values(), strict=True))


def same_mask(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, same: are the same nodes defined?"""
    active = lambda n, k: n.where(F.col("value").isNotNull()).select("i", "j", F.lit(k).alias("__k"))
    odd = active(a, 1).unionByName(active(b, 2)).groupBy("i", "j").agg(F.sum("__k").alias("__k")).where("__k <> 3")
    return odd.agg((F.count(F.lit(1)) == 0).alias("same"))


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """|mean(a) - mean(b)| / mean(a)."""
    both = a.select(F.col("value").alias("a"), F.lit(None).cast("double").alias("b")).unionByName(b.select(F.lit(None).cast("double").alias("a"), F.col("value").alias("b")))
    return both.agg(F.try_divide(F.abs(F.avg("a") - F.avg("b")), F.avg("a")).alias("similarity"))


# --- sampling -------------------------------------------------------------------------------------------------------


def node_quads(nodes: DataFrame) -> DataFrame:
    """(__i, __j, __z0 .. __z3, __n): the four nodes of each square of a map that has all of them, from (__i, __j) on, counted from 0."""
    known = nodes.where(F.col("value").isNotNull())
    corner = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(di).alias("di"), F.lit(dj).alias("dj")) for k, (di, dj) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))))))
    spread = known.select("i", "j", "value", corner.alias("c")).select((F.col("i") - 1 - F.col("c.di")).alias("__i"), (F.col("j") - 1 - F.col("c.dj")).alias("__j"), "c.k", "value")
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"__z{k}")
    return spread.groupBy("__i", "__j").agg(*(pick(k) for k in range(4)), F.count(F.lit(1)).alias("__n")).where("__n = 4")


def sample(places: DataFrame, nodes: DataFrame, header: MapHeader, x: str = "x", y: str = "y", name: str = "sampled", method: str = "bilinear", tolerance: float = 1e-6) -> DataFrame:
    """Adds the map's value at each place (x, y): bilinear in the four nodes around it, or the nearest node's.

    Null off the map and where one of the four is masked. A place on the last row or column takes the nodes before it.
    Each place goes to the node below it by one equi-join: beforehand every node gets the values of its three
    neighbours, by a shuffle of the map alone.
    """
    fi, fj = header.fi(F.col(x), F.col(y)), header.fj(F.col(x), F.col(y))
    own = places.withColumns({"__fi": fi, "__fj": fj})
    inside = F.col("__fi").between(-tolerance, header.ncol - 1 + tolerance) & F.col("__fj").between(-tolerance, header.nrow - 1 + tolerance)
    clamp = lambda c, n: F.greatest(F.lit(0.0), F.least(F.col(c), F.lit(float(n - 1))))
    own = own.withColumns({"__fi": F.when(inside, clamp("__fi", header.ncol)), "__fj": F.when(inside, clamp("__fj", header.nrow))})
    if method == "nearest":
        near = nodes.select((F.col("i") - 1).alias("__i"), (F.col("j") - 1).alias("__j"), F.col("value").alias(name))
        own = own.withColumns({"__i": F.floor(F.col("__fi") + 0.5).cast("int"), "__j": F.floor(F.col("__fj") + 0.5).cast("int")})
        return own.join(near, ["__i", "__j"], "left").drop("__i", "__j", "__fi", "__fj")
    quads = node_quads(nodes)
    last = lambda c, n: F.least(F.floor(F.col(c)).cast("int"), F.lit(max(0, n - 2)))
    own = own.withColumns({"__i": last("__fi", header.ncol), "__j": last("__fj", header.nrow)})
    z = [F.col(f"__z{k}") for k in range(4)]
    found = own.join(quads, ["__i", "__j"], "left")
    return found.withColumn(name, g.bilinear(*z, F.col("__fi") - F.col("__i"), F.col("__fj") - F.col("__j"))).drop("__i", "__j", "__fi", "__fj", "__n", *(f"__z{k}" for k in range(4)))


def _where(start: Column, step: Column):
    return lambda k: (k - start) / step


def pierced(lines: DataFrame, nodes: DataFrame, header: MapHeader, keys: Sequence[str], name: str = "depth", beyond: float = 0.5, tolerance: float = 1e-6) -> DataFrame:
    """(keys, name): the depth at which each line (keys, x0, y0, z0, x1, y1, z1) meets the map; lines that don't are left out.

    Of several places the one nearest to the line's first end; the line goes on for `beyond` of its length at either end,
    and a vertical one without limit. Level lines meet nothing. The map is bilinear in each square of four nodes, so a
    line's depth less the map's is a parabola there: lines are cut at the rows and columns of the map, each piece joins
    its square, and the parabola's root is exact.
    """
    x, y, z = ((F.col(f"{a}0"), F.col(f"{a}1") - F.col(f"{a}0")) for a in "xyz")
    fi, fj = header.fi(x[0], y[0]), header.fj(x[0], y[0])
    own = lines.withColumns({"__u": fi, "__v": fj, "__du": header.fi(F.col("x1"), F.col("y1")) - fi, "__dv": header.fj(F.col("x1"), F.col("y1")) - fj})
    upright = (F.abs(x[1]) < 1e-10) & (F.abs(y[1]) < 1e-10)
    own = own.where(F.abs(z[1]) >= 1e-10).withColumn("__upright", upright)
    cuts = [F.array(F.lit(-beyond), F.lit(1 + beyond))]
    for a, n in (("u", header.ncol), ("v", header.nrow)):
        start, step = F.col(f"__{a}"), F.col(f"__d{a}")
        ends = start - beyond * step, start + (1 + beyond) * step
        first, last = F.greatest(F.lit(0), F.ceil(F.least(*ends))).cast("int"), F.least(F.lit(n - 1), F.floor(F.greatest(*ends))).cast("int")
        planes = F.when((step != 0) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        cuts.append(F.transform(planes, _where(start, step)))
    ts = F.when(F.col("__upright"), cuts[0]).otherwise(F.array_sort(F.array_distinct(F.concat(*cuts))))
    pieces = F.transform(F.slice("__t", F.lit(1), F.size("__t") - 1), lambda t, n: F.struct(t.alias("a"), F.get("__t", n + 1).alias("b")))
    own = own.withColumn("__t", ts).withColumn("__s", F.explode(pieces)).drop("__t")
    middle = F.when(F.col("__upright"), 0.0).otherwise((F.col("__s.a") + F.col("__s.b")) / 2)
    for a, n, to in (("u", header.ncol, "__i"), ("v", header.nrow, "__j")):
        at = F.col(f"__{a}") + middle * F.col(f"__d{a}")
        own = own.withColumn(to, F.when(at.between(-tolerance, n - 1 + tolerance), F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(max(0, n - 2))).cast("int")))
    met = own.join(node_quads(nodes), ["__i", "__j"])
    z1, z2, z3, z4 = (F.col(f"__z{k}") for k in range(4))
    b, c, d = z2 - z1, z3 - z1, z4 + z1 - z2 - z3
    p, q, du, dv = F.col("__u") - F.col("__i"), F.col("__v") - F.col("__j"), F.col("__du"), F.col("__dv")
    met = met.withColumns({"__a2": -d * du * dv, "__a1": z[1] - (b * du + c * dv + d * (p * dv + q * du)), "__a0": z[0] - (z1 + b * p + c * q + d * p * q)})
    a2, a1, a0 = (F.when(F.col("__upright"), straight).otherwise(F.col(f"__a{k}")) for k, straight in ((2, F.lit(0.0)), (1, z[1]), (0, F.col("__a0"))))
    root = -(a1 + F.when(a1 < 0, -1.0).otherwise(1.0) * F.sqrt(F.when(a1 * a1 - 4 * a2 * a0 >= 0, a1 * a1 - 4 * a2 * a0))) / 2
    within = lambda t: F.when(F.col("__upright") | t.between(F.col("__s.a") - 1e-9, F.col("__s.b") + 1e-9), t)
    t = F.least(within(F.try_divide(root, a2)), within(F.try_divide(a0, root)))
    found = met.withColumn("__root", t).where(F.col("__root").isNotNull())
    return found.groupBy(*keys).agg(F.min(F.struct(F.col("__root"), (z[0] + F.col("__root") * z[1]).alias("z"))).alias("__m")).select(*keys, F.col("__m.z").alias(name))


def resample(nodes: DataFrame, header: MapHeader, target: MapHeader, method: str = "bilinear") -> DataFrame:
    """The map on another map's nodes; nodes without a value are left out."""
    if same_topology(header, target):
        return nodes
    places = with_xy(lattice(nodes.sparkSession, target), target)
    return sample(places, nodes, header, name="value", method=method).where(F.col("value").isNotNull()).select("i", "j", "value")


def snap(points: DataFrame, nodes: DataFrame, header: MapHeader, active_only: bool = True) -> DataFrame:
    """Points moved to the map in z; those off it are dropped, or stay where they are."""
    found = sample(points, nodes, header, name="__z")
    if active_only:
        return found.where(F.col("__z").isNotNull()).withColumn("z", F.col("__z")).drop("__z")
    return found.withColumn("z", F.coalesce("__z", "z")).drop("__z")


def distance_log(samples: DataFrame, nodes: DataFrame, header: MapHeader, name: str = "DIST_SURF") -> DataFrame:
    """Adds to well samples the map's z less their own; null off the map."""
    return sample(samples, nodes, header, name="__z").withColumn(name, F.col("__z") - F.col("z")).drop("__z")


# --- geometry -------------------------------------------------------------------------------------------------------


def swap_axes(nodes: DataFrame, header: MapHeader) -> tuple[DataFrame, MapHeader]:
    new = MapHeader(header.nrow, header.ncol, header.xori, header.yori, header.yinc, header.xinc, (header.rotation + header.yflip * 90) % 360, -header.yflip)
    return nodes.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"), new


def flip_rows(nodes: DataFrame, header: MapHeader) -> tuple[DataFrame, MapHeader]:
    """The other handedness: rows counted from the far side."""
    x, y = header.at(1, header.nrow)
    return nodes.withColumn("j", F.lit(header.nrow + 1) - F.col("j")), replace(header, xori=x, yori=y, yflip=-header.yflip)


def translate(nodes: DataFrame, header: MapHeader, dx: float = 0.0, dy: float = 0.0, dz: float = 0.0) -> tuple[DataFrame, MapHeader]:
    return nodes.withColumn("value", F.col("value") + float(dz)), header.moved(dx, dy)


def autocrop(nodes: DataFrame) -> DataFrame:
    """Only the box of indices that holds defined nodes, counted from 1 in it."""
    box = nodes.where(F.col("value").isNotNull()).agg(*(f(c).alias(f"__{n}{c}") for c in "ij" for n, f in (("min", F.min), ("max", F.max))))  # one row
    own = nodes.join(F.broadcast(box)).where(F.col("i").between(F.col("__mini"), F.col("__maxi")) & F.col("j").between(F.col("__minj"), F.col("__maxj")))
    return own.select((F.col("i") - F.col("__mini") + 1).alias("i"), (F.col("j") - F.col("__minj") + 1).alias("j"), "value")


def refined(header: MapHeader, factor: int) -> MapHeader:
    """The header with factor times the nodes over the same area."""
    n, m = header.ncol * factor, header.nrow * factor
    return replace(header, ncol=n, nrow=m, xinc=header.xinc * (header.ncol - 1) / (n - 1), yinc=header.yinc * (header.nrow - 1) / (m - 1))


def coarsened(header: MapHeader, factor: int) -> MapHeader:
    n, m = round(header.ncol / factor), round(header.nrow / factor)
    if n < 4 or m < 4:
        raise ValueError("too coarse")
    return replace(header, ncol=n, nrow=m, xinc=header.xinc * (header.ncol - 1) / (n - 1), yinc=header.yinc * (header.nrow - 1) / (m - 1))


def unrotated(header: MapHeader, factor: int = 2) -> MapHeader:
    """A header without rotation that covers the map, with factor times as many nodes in each direction."""
    xs, ys = zip(*header.corners(), strict=True)
    n, m = header.ncol * factor, header.nrow * factor
    return MapHeader(n, m, min(xs), min(ys), (max(xs) - min(xs)) / (n - 1), (max(ys) - min(ys)) / (m - 1), 0.0, 1)


def distance_from_point(nodes: DataFrame, header: MapHeader, x: float, y: float, azimuth: float) -> DataFrame:
    """Each defined node's signed distance, square to the line through a point along an azimuth; positive to the right."""
    a = math.radians(azimuth)
    own = with_xy(nodes, header)
    d = (F.col("x") - x) * math.cos(a) - (F.col("y") - y) * math.sin(a)
    return own.select("i", "j", F.when(F.col("value").isNotNull(), d).alias("value"))


# --- filling and smoothing ------------------------------------------------------------------------------------------


def fill(nodes: DataFrame, header: MapHeader, value: float | None = None, reach: int = 8, method: str = "nearest") -> DataFrame:
    """All nodes of the lattice: masked ones get a constant, or the value of the nearest defined node (by place; of equally near ones the least i, then j).

    Nearest nodes are sought in rings of growing reach, each an equi-join on tiles, so the work stays local; each round
    takes only what the one before left open. method "linear" or "cubic": masked nodes within the hull of the defined ones
    get the value of the Delaunay triangle they are in first, flat or smooth. "radial": all masked nodes get the value of
    thin-plate splines through the defined ones.
    """
    if method == "radial" and value is None:
        from terraspan.operators import gridding

        known = with_xy(nodes.where(F.col("value").isNotNull()).select("i", "j", "value"), header)
        made = gridding.rbf(known.withColumnRenamed("value", "z"), header)
        return made.withColumnRenamed("value", "__made").join(known.select("i", "j", "value"), ["i", "j"], "left").select("i", "j", F.coalesce("value", "__made").alias("value"))
    if method in ("linear", "cubic") and value is None:
        from terraspan.operators import gridding

        known = with_xy(nodes.where(F.col("value").isNotNull()).select("i", "j", "value"), header)
        made = gridding.linear(known.withColumnRenamed("value", "z"), header, beyond=True, smooth=method == "cubic")
        nodes = cut(made.withColumnRenamed("value", "__made").join(known.select("i", "j", "value"), ["i", "j"], "left").select("i", "j", F.coalesce("value", "__made").alias("value")))
    own = lattice(nodes.sparkSession, header).join(nodes.select("i", "j", "value"), ["i", "j"], "left")
    if value is not None:
        return own.withColumn("value", F.coalesce("value", F.lit(float(value))))
    known = nodes.where(F.col("value").isNotNull()).select(F.col("i").alias("ki"), F.col("j").alias("kj"), F.col("value").alias("kv"))
    done, open_ = own.where(F.col("value").isNotNull()), own.where(F.col("value").isNull()).select("i", "j")
    size = max(header.ncol * header.xinc, header.nrow * header.yinc)
    unit = min(header.xinc, header.yinc)
    while True:
        found = cut(nearest_node(open_, known, header, reach))
        done = done.unionByName(found)
        if reach * unit > size:
            return done
        open_ = cut(open_.join(found.select("i", "j"), ["i", "j"], "left_anti"))
        if not open_.limit(1).count():
            return done
        reach *= 4


def nearest_node(places: DataFrame, known: DataFrame, header: MapHeader, reach: int) -> DataFrame:
    """(i, j, value) of places that have a known node within `reach` of the shorter increment, from the nearest one."""
    limit = reach * min(header.xinc, header.yinc)
    ti, tj = max(1, int(limit / header.xinc)), max(1, int(limit / header.yinc))
    tiled = known.withColumns({"ti": F.floor(F.col("ki") / ti), "tj": F.floor(F.col("kj") / tj)})
    around = lambda c, n: F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col(c) / n) + k))
    near = places.withColumn("ti", around("i", ti)).withColumn("tj", around("j", tj))
    di, dj = (F.col("ki") - F.col("i")) * header.xinc, (F.col("kj") - F.col("j")) * header.yinc
    pairs = near.join(tiled, ["ti", "tj"]).withColumn("d", di * di + dj * dj).where(F.col("d") <= limit * limit)
    return pairs.groupBy("i", "j").agg(F.min_by("kv", F.struct("d", "ki", "kj")).alias("value"))


def smooth(nodes: DataFrame, header: MapHeader, method: str = "median", width: int = 3, sigma: float = 1.0) -> DataFrame:
    """A moving median of width by width nodes, or a Gaussian of `sigma` nodes (cut at 4 sigma), over the filled map.

    Beyond the edge the nearest edge node counts. Nodes that were masked stay masked.
    """
    full = fill(nodes, header)
    if method == "median":
        low, high = -(width // 2), width - width // 2 - 1
        weights = None
    else:
        high = int(4 * sigma + 0.5)
        low = -high
        raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(low, high + 1)]
        weights = [w / sum(raw) for w in raw]
    mask = nodes.where(F.col("value").isNotNull()).select("i", "j")
    if weights:  # separable: one direction after the other, each by a window along it
        full = _weighted(full, "i", "j", low, weights, header.ncol)
        full = _weighted(full, "j", "i", low, weights, header.nrow)
        return full.join(mask, ["i", "j"], "left_semi").select("i", "j", "value")
    # a node goes to all places whose window holds it, as often as the edge repeats it
    def targets(c: str, n: int) -> Column:
        t = F.sequence(F.greatest(F.lit(1), F.col(c) - high), F.least(F.lit(n), F.col(c) - low))
        times = lambda p: F.when(F.col(c) == 1, F.greatest(F.lit(1), F.lit(1) - (p + low) + 1)).when(F.col(c) == n, F.greatest(F.lit(1), p + high - n + 1)).otherwise(1)
        return F.explode(F.transform(t, lambda p: F.struct(p.alias("p"), times(p).cast("int").alias("n"))))

    spread = full.withColumn("__a", targets("i", header.ncol)).withColumn("__b", targets("j", header.nrow))
    out = spread.groupBy(F.col("__a.p").alias("i"), F.col("__b.p").alias("j")).agg(F.percentile("value", F.lit(0.5), F.col("__a.n") * F.col("__b.n")).alias("value"))
    return out.join(mask, ["i", "j"], "left_semi").select("i", "j", "value")


def _weighted(nodes: DataFrame, along: str, other: str, low: int, weights: list[float], n: int) -> DataFrame:
    w = Window.partitionBy(other).orderBy(along)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = nodes.withColumns({"__first": F.first("value").over(whole), "__last": F.last("value").over(whole)})
    at = lambda k: F.lag("value", -k).over(w)
    total = sum((F.coalesce(at(low + k), F.col("__first") if low + k < 0 else F.col("__last")) * x for k, x in enumerate(weights)), F.lit(0.0))
    return edge.withColumn("value", total).drop("__first", "__last")
