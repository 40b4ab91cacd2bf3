"""Points, polygons and polylines: points(x, y, z, ...), polygons(poly_id, seq, x, y, z), in the order of seq.

Points meet polygons by one of two joins, by the number of edges, which is counted first: few edges are gathered by
polygon and broadcast, so points aren't moved at all; more edges are joined by bands of y that both touch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraspan.operators.rounds import cut

#: Edges that are broadcast, at most (40 bytes each).
BROADCAST_EDGES = 100_000


def along() -> Window:
    return Window.partitionBy("poly_id").orderBy("seq")


def edges(polygons: DataFrame) -> DataFrame:
    """(poly_id, x1, y1, x2, y2) of closed rings; a ring that is open is closed by one more edge."""
    w = along()
    first = Window.partitionBy("poly_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = polygons.select("poly_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce(F.lead("x").over(w), F.first("x").over(first)).alias("x2"), F.coalesce(F.lead("y").over(w), F.first("y").over(first)).alias("y2"))
    return own.where("x1 <> x2 or y1 <> y2")


def _crosses(x: Column, y: Column, e) -> Column:
    """Does the ray to the right cross the edge? Half open in y, so that a corner counts once."""
    return ((e("y1") > y) != (e("y2") > y)) & (x < (e("x2") - e("x1")) * (y - e("y1")) / (e("y2") - e("y1")) + e("x1"))


def covering(points: DataFrame, polygons: DataFrame, name: str = "n_polygons", with_z: bool = False) -> DataFrame:
    """Adds the number of polygons that a point is in. with_z: also the list <name>_z of their mean z, in order of id."""
    own = edges(polygons)
    zs = polygons.groupBy("poly_id").agg(F.avg("z").alias("pz"))
    if own.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES:
        rings = own.groupBy("poly_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"), *(f(F.col(c)).alias(n) for n, f, c in (("x_lo", F.min, "x1"), ("x_hi", F.max, "x1"), ("y_lo", F.min, "y1"), ("y_hi", F.max, "y1")))).join(zs, "poly_id")
        every = rings.agg(F.array_sort(F.collect_list(F.struct("poly_id", "pz", "x_lo", "x_hi", "y_lo", "y_hi", "edges"))).alias("__rings"))  # one row, bounded by the count above
        x, y = F.col("x"), F.col("y")
        odd = lambda r: F.size(F.filter(r["edges"], lambda e: _crosses(x, y, lambda c: e[c]))) % 2 == 1
        hit = F.filter("__rings", lambda r: x.between(r["x_lo"], r["x_hi"]) & y.between(r["y_lo"], r["y_hi"]) & odd(r))
        found = points.join(F.broadcast(every)).withColumn("__hit", hit)
        found = found.withColumn(name, F.size("__hit"))
        return (found.withColumn(f"{name}_z", F.transform("__hit", lambda r: r["pz"])) if with_z else found).drop("__rings", "__hit")
    # bands as high as the edges are on average, so that an edge is in about two of them
    height = max(float(own.agg(F.avg(F.abs(F.col("y2") - F.col("y1")))).first()[0] or 0), 1e-9)
    band = lambda c: F.floor(c / height).cast("long")
    banded = own.withColumn("__band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    marked = points.withColumns({"__band": band(F.col("y")), "__id": F.xxhash64("x", "y")})
    places = marked.select("__band", "__id", "x", "y").distinct()
    hits = places.join(banded, "__band").where(_crosses(F.col("x"), F.col("y"), F.col)).groupBy("__id", "x", "y", "poly_id").agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1").join(zs, "poly_id")
    listed = hits.groupBy("x", "y").agg(F.count(F.lit(1)).cast("int").alias(name), F.transform(F.array_sort(F.collect_list(F.struct("poly_id", "pz"))), lambda r: r["pz"]).alias(f"{name}_z"))
    out = marked.drop("__band", "__id").join(listed, ["x", "y"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return (out.withColumn(f"{name}_z", F.coalesce(f"{name}_z", F.array().cast("array<double>"))) if with_z else out.drop(f"{name}_z")).select(*points.columns, name, *([f"{name}_z"] if with_z else []))


def mark(points: DataFrame, polygons: DataFrame, name: str = "pstatus", inside: int = 1, outside: int = 0) -> DataFrame:
    """Adds inside where a point is in any of the polygons, else outside."""
    if name in ("x", "y", "z"):
        raise ValueError(f"{name} is protected")
    return covering(points, polygons, "__n").withColumn(name, F.when(F.col("__n") > 0, inside).otherwise(outside)).drop("__n")


def _applied(z: Column, operation: str, value: Column) -> Column:
    if operation == "div":  # by zero gives zero
        return F.coalesce(F.try_divide(z, value), F.lit(0.0))
    return {"set": value, "add": z + value, "sub": z - value, "mul": z * value}[operation]


def operate(points: DataFrame, polygons: DataFrame, operation: str, value: float | str = 0.0, inside: bool = True, version: int = 2, target: str = "z") -> DataFrame:
    """Changes z of the points in (or out of) the polygons: set, add, sub, mul, div, or eli, which drops the points.

    Version 2 applies the operation once, to all that are in any polygon (or in none). Version 1 goes polygon by polygon,
    so that it is applied once for each polygon that a point is in (or isn't in); value "poly" is then the polygon's mean z.
    """
    own = covering(points, polygons, "__n", with_z=version == 1)
    n = F.col("__n")
    if version == 2:
        hit = n > 0 if inside else n == 0
        if operation == "eli":
            return own.where(~hit).drop("__n")
        return own.withColumn(target, F.when(hit, _applied(F.col(target), operation, F.lit(float(value)))).otherwise(F.col(target))).drop("__n")
    zs = polygons.groupBy("poly_id").agg(F.avg("z").alias("z")).agg(F.transform(F.array_sort(F.collect_list(F.struct("poly_id", "z"))), lambda r: r["z"]).alias("__all"))
    own = own.join(F.broadcast(zs))
    # polygons that aren't around a point are those of all that are left when its own are taken out
    acting = F.col("__n_z") if inside else F.filter("__all", lambda a: ~F.array_contains("__n_z", a))
    if operation == "eli":
        return own.where(F.size(acting) == 0).drop("__n", "__n_z", "__all")
    step = lambda z, p: _applied(z, operation, p if value == "poly" else F.lit(float(value)))
    return own.withColumn(target, F.aggregate(acting, F.col(target).cast("double"), step)).drop("__n", "__n_z", "__all")


def filter_ids(polygons: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """Polygons with the ids, in the order of the list (column order); of none given, the first."""
    if ids is None:
        return polygons.join(polygons.agg(F.min("poly_id").alias("__id")).hint("broadcast"), F.col("poly_id") == F.col("__id")).drop("__id").withColumn("order", F.lit(0))
    listed = F.create_map(*(F.lit(x) for k, i in enumerate(ids) for x in (i, k)))
    return polygons.where(F.col("poly_id").isin(list(ids))).withColumn("order", listed[F.col("poly_id")])


def lengths(polygons: DataFrame, flat: bool = True, cumulative: str = "H_CUMLEN", delta: str = "H_DELTALEN", atindex: int = 0) -> DataFrame:
    """Adds the length along each polyline and the length from the vertex before (the first has the second's), in 2D or 3D.

    atindex: the vertex where the length is 0.
    """
    w = along()
    d = [F.col(c) - F.lag(c).over(w) for c in ("x", "y", *(() if flat else ("z",)))]
    own = polygons.withColumn("__d", F.sqrt(sum((x * x for x in d), F.lit(0.0))))
    own = own.withColumns({cumulative: F.sum(F.coalesce("__d", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)), delta: F.coalesce("__d", F.lead("__d").over(w))})
    if atindex:
        own = own.withColumn(cumulative, F.col(cumulative) - F.nth_value(cumulative, atindex + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return own.drop("__d")


def rescale(polygons: DataFrame, distance: float, kind: str = "simple", flat: bool = True) -> DataFrame:
    """Polylines with vertices at equal distances along them.

    simple: n = round(length / distance) steps from the first vertex; slinear: n = int(0.999 length / distance) places
    from the first to the last. Polylines too short for a step keep their ends.
    """
    own = lengths(polygons, flat, "__s", "__d")
    total = own.groupBy("poly_id").agg(F.max("__s").alias("__l"))
    n = F.greatest(F.lit(1), F.rint(F.col("__l") / distance).cast("int")) if kind == "simple" else F.greatest(F.lit(2), (F.col("__l") * 0.999 / distance).cast("int")) - 1
    places = total.withColumn("__n", n).select("poly_id", "__l", "__n", F.explode(F.sequence(F.lit(0), F.col("__n"))).alias("seq")).select("poly_id", "seq", (F.col("__l") * F.col("seq") / F.col("__n")).alias("__s"), F.lit(1).alias("__new"))
    w = Window.partitionBy("poly_id").orderBy("__s", "__new")
    known = own.select("poly_id", F.lit(None).cast("int").alias("seq"), "__s", F.lit(0).alias("__new"), "x", "y", "z")
    both = known.unionByName(places, allowMissingColumns=True)
    here = F.when(F.col("__new") == 0, F.struct("__s", "x", "y", "z"))
    both = both.withColumns({"__p": F.last(here, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__q": F.first(here, True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    t = F.coalesce(F.try_divide(F.col("__s") - F.col("__p.__s"), F.col("__q.__s") - F.col("__p.__s")), F.lit(0.0))
    at = lambda c: (F.col(f"__p.{c}") + t * (F.coalesce(F.col(f"__q.{c}"), F.col(f"__p.{c}")) - F.col(f"__p.{c}"))).alias(c)
    return both.where("__new = 1").select("poly_id", "seq", at("x"), at("y"), at("z"))


def extend(polygons: DataFrame, distance: float, nsamples: int = 1) -> DataFrame:
    """nsamples more vertices at each end, along the end segments in the map; z is that of the end."""
    w, back = along(), Window.partitionBy("poly_id").orderBy(F.desc("seq"))
    own = polygons.select("poly_id", "seq", "x", "y", "z", F.row_number().over(w).alias("__a"), F.row_number().over(back).alias("__b"), F.lead("x").over(w).alias("__nx"), F.lead("y").over(w).alias("__ny"), F.lag("x").over(w).alias("__px"), F.lag("y").over(w).alias("__py"))

    def more(end: DataFrame, ox: str, oy: str, sign: int) -> DataFrame:
        dx, dy = F.col("x") - F.col(ox), F.col("y") - F.col(oy)
        d = F.sqrt(dx * dx + dy * dy)
        k = F.explode(F.sequence(F.lit(1), F.lit(nsamples))).alias("k")
        return end.where(d > 0).select("poly_id", "seq", "x", "y", "z", (dx / d).alias("ux"), (dy / d).alias("uy"), k).select("poly_id", (F.col("seq") + sign * F.col("k")).alias("seq"), (F.col("x") + F.col("ux") * F.col("k") * distance).alias("x"), (F.col("y") + F.col("uy") * F.col("k") * distance).alias("y"), "z")

    base = own.select("poly_id", "seq", "x", "y", "z")
    return base.unionByName(more(own.where("__a = 1"), "__nx", "__ny", -1)).unionByName(more(own.where("__b = 1"), "__px", "__py", 1))


def fence(polygons: DataFrame, distance: float = 20.0, atleast: int = 5, nextend: int = 2) -> DataFrame:
    """(poly_id, seq, x, y, z, h, dh): a polyline at equal steps, extended at both ends, with lengths that are 0 at its own start.

    The step is at most length / (atleast + 1); vertices closer than 1 % of it to the one before are dropped.
    """
    total = lengths(polygons, True, "__s", "__d").groupBy("poly_id").agg(F.max("__s").alias("__l"))
    step = F.least(F.lit(float(distance)), F.col("__l") / (atleast + 1))
    # every polyline has a step of its own: the lines are scaled to steps of one, and back
    scaled = polygons.join(total.select("poly_id", step.alias("__step")), "poly_id")
    unit = scaled.select("poly_id", "seq", (F.col("x") / F.col("__step")).alias("x"), (F.col("y") / F.col("__step")).alias("y"), "z")
    longer = extend(rescale(unit, 1.0, "slinear"), 1.0, nextend)
    back = longer.join(total.select("poly_id", step.alias("__step")), "poly_id").select("poly_id", "seq", (F.col("x") * F.col("__step")).alias("x"), (F.col("y") * F.col("__step")).alias("y"), "z", "__step")
    out = lengths(back, True, "h", "dh", nextend).withColumn("__n", F.row_number().over(along()))
    return out.where((F.col("dh") >= 0.01 * F.col("__step")) | (F.col("__n") == 1)).drop("__step", "__n")


def boundary(points: DataFrame) -> DataFrame:
    """One row: the bounds of x, y, z."""
    return points.agg(*(f(c).alias(f"{c}{n}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))))


def compare_z(points: DataFrame, operation: str, value: float) -> DataFrame:
    from terraspan.operators.surfaces import OPERATIONS

    return points.withColumn("hit", OPERATIONS[operation](F.col("z"), F.lit(float(value))))


def close_cells(places: DataFrame, distance: float, side: float) -> DataFrame:
    """(a, b): squares (struct of cx, cy) that hold places(x, y, cx, cy) within the distance in the map, but aren't the same; each once."""
    reach = int(distance // side) + 1
    after = [(i, j) for i in range(reach + 1) for j in range(-reach, reach + 1) if (i, j) > (0, 0)]
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in after)))
    look = places.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.struct("cx", "cy").alias("a"), step.alias("s"))
    look = look.select("ax", "ay", "a", (F.col("a.cx") + F.col("s.i")).alias("cx"), (F.col("a.cy") + F.col("s.j")).alias("cy"))
    dx, dy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    return places.join(look, ["cx", "cy"]).where(dx * dx + dy * dy <= distance * distance).select("a", F.struct("cx", "cy").alias("b")).distinct()


def with_cluster(points: DataFrame, distance: float, pid: str = "pid") -> DataFrame:
    """Adds cluster: the least id that is reached from a point by steps of at most the distance; points without a place have their own id.

    Squares are so small that their points are close to each other, so a square has one label, and points of one place are
    one place: what is written grows with squares that are close, not with pairs of points. Labels are lowered round by
    round, each written to the checkpoint folder, with a jump to the label's own label, so the rounds grow with the
    logarithm of a chain's length.
    """
    side = distance / 1.5  # the diagonal is 0.94 of the distance, far from rounding
    finite = lambda c: F.col(c) - F.col(c) == 0
    cell = lambda c: F.when(finite("x") & finite("y"), F.floor(F.col(c) / side)).alias(f"c{c}")
    own = points.withColumns({"cx": cell("x"), "cy": cell("y")})
    places = cut(own.where("cx is not null").groupBy("cx", "cy", "x", "y").agg(F.min(pid).alias("l")))
    pairs = close_cells(places, distance, side)
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    # a square's name is its least id, too
    labels = cut(places.groupBy(F.struct("cx", "cy").alias("a")).agg(F.min("l").alias("me")).withColumn("l", F.col("me")))
    while True:
        lower = both.join(labels.select(F.col("a").alias("b"), F.col("l").alias("lb")), "b").groupBy("a").agg(F.min("lb").alias("lb"))
        new = labels.join(lower, "a", "left").select("a", "me", F.least("l", F.coalesce("lb", "l")).alias("l"), F.col("l").alias("old"))
        up = new.select(F.col("me").alias("l"), F.col("l").alias("ll"))
        new = cut(new.join(up, "l").select("a", "me", F.least("l", "ll").alias("l"), "old"))
        if not new.where("l <> old").limit(1).count():
            break
        labels = new.select("a", "me", "l")
    found = new.select("a.cx", "a.cy", F.col("l").alias("__l"))
    return own.join(found, ["cx", "cy"], "left").withColumn("cluster", F.coalesce("__l", pid)).drop("cx", "cy", "__l")


def clusters(points: DataFrame, distance: float, pid: str = "pid") -> DataFrame:
    """(pid, cluster) of with_cluster()."""
    return with_cluster(points, distance, pid).select(pid, "cluster")


def merge_close(points: DataFrame, distance: float, method: str = "average", pid: str = "pid") -> DataFrame:
    """(cluster, x, y, z, n): a point for each cluster of close points.

    average and median of each coordinate; first, min_z and max_z: the point with the least id, least z, largest z.
    """
    own = with_cluster(points.select(pid, "x", "y", "z"), distance, pid)
    whole = F.struct("x", "y", "z")
    how = {
        "average": [F.avg(c).alias(c) for c in "xyz"],
        "median": [F.percentile(c, F.lit(0.5)).alias(c) for c in "xyz"],
        "first": [F.min_by(whole, pid).alias("p")],
        "min_z": [F.min_by(whole, F.struct("z", pid)).alias("p")],
        "max_z": [F.max_by(whole, F.struct(F.col("z"), -F.col(pid))).alias("p")],
    }[method]
    out = own.groupBy("cluster").agg(*how, F.count(F.lit(1)).alias("n"))
    return out if method in ("average", "median") else out.select("cluster", "p.x", "p.y", "p.z", "n")
