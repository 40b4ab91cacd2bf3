"""Connections between cells that are not neighbours by their indices: of a given table, and of a grid nested in a hole of another.

A face is named by the direction it looks in: I-, I+, J-, J+, K- (up) and K+ (down). The area that two faces share is that of
the two quadrilaterals as they fall on the plane midway between their normals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.functions import geometry as g
from terraspan.functions.lambdas import let
from terraspan.operators.cells import DARCY, IJK
from terraspan.operators.rounds import cut

#: Corners of the faces, around; opposite faces go the same way round.
FACES = {"I+": (1, 2, 6, 5), "I-": (0, 3, 7, 4), "J+": (3, 2, 6, 7), "J-": (0, 1, 5, 4), "K+": (4, 5, 6, 7), "K-": (0, 1, 2, 3)}
OPPOSITE = {"I+": "I-", "I-": "I+", "J+": "J-", "J-": "J+", "K+": "K-", "K-": "K+"}
STEPS = {"I+": (1, 0, 0), "I-": (-1, 0, 0), "J+": (0, 1, 0), "J-": (0, -1, 0), "K+": (0, 0, 1), "K-": (0, 0, -1)}


def point(p: Column) -> g.Point:
    return p["x"], p["y"], p["z"]


def vector(p: g.Point) -> Column:
    return F.struct(*(c.alias(a) for a, c in zip("xyz", p, strict=True)))


def of_direction(direction: Column, values: dict[str, Column]) -> Column:
    """The value of the row's direction; null for others."""
    return F.coalesce(*(F.when(direction == d, v) for d, v in values.items()))


def corner_points() -> Column:
    """The cell's eight corners, (x, y, z) each."""
    return F.array(*(F.struct(*(F.col(f"c{n}{a}").alias(a) for a in "xyz")) for n in range(8)))


def face(direction: Column, corners: Column, opposite: bool = False) -> Column:
    """The four corners of a cell's face; of the face that looks the other way, if opposite."""
    around = of_direction(direction, {d: F.array(*(F.lit(n) for n in FACES[OPPOSITE[d] if opposite else d])) for d in FACES})
    return F.transform(around, lambda n: F.get(corners, n))


def middle(points: Column) -> Column:
    """The mean of an array of points."""
    total = lambda a: F.aggregate(F.transform(points, lambda p: p[a]), F.lit(0.0), lambda s, x: s + x)
    return F.struct(*((total(a) / F.size(points)).alias(a) for a in "xyz"))


def diagonal(f: Column, k: int) -> g.Point:
    return g.minus(point(F.get(f, F.lit(k + 2))), point(F.get(f, F.lit(k))))


def overlap(first: Column, second: Column) -> Column:
    """(area, normal) of two faces: what they share, and the unit normal of their plane. Null for faces without an area.

    The area is 0 for faces that lie further apart than the longest of their diagonals.
    """

    def planed(faces: Column) -> Column:
        a, b = faces["a"], faces["b"]
        total = tuple(p + q for p, q in zip(*(g.cross(diagonal(f, 0), diagonal(f, 1)) for f in (a, b)), strict=True))
        return let(vector(total), lambda t: let(g.norm(point(t)), lambda n: F.when(n > 1e-15, let(vector(tuple(c / n for c in point(t))), lambda u: shared(faces, u)))))

    def shared(faces: Column, n: Column) -> Column:
        a, b, normal = faces["a"], faces["b"], point(n)
        apart = F.abs(g.dot(normal, g.minus(point(middle(b)), point(middle(a)))))
        far = apart > F.greatest(*(g.norm(diagonal(f, k)) for f in (a, b) for k in (0, 1)))

        def along(d: Column) -> Column:
            way = g.dot(point(d), normal)
            return vector(tuple(c - way * m for c, m in zip(point(d), normal, strict=True)))

        def area(u: Column) -> Column:
            axis = tuple(c / g.norm(point(u)) for c in point(u))
            flat = lambda f: F.transform(f, lambda p: let(vector(g.minus(point(p), point(F.get(a, F.lit(0))))), lambda w: g.plane_point(g.dot(axis, point(w)), g.dot(g.cross(normal, axis), point(w)))))
            ring = let(flat(b), lambda r: F.when(g.polygon_area(r) < 0, F.reverse(r)).otherwise(r))
            return let(ring, lambda r: let(g.polygon_overlap(flat(a), [F.get(r, F.lit(k)) for k in range(4)]), lambda p: F.abs(g.polygon_area(p))))

        return F.struct(F.when(far, 0.0).otherwise(let(let(vector(diagonal(a, 0)), along), area)).alias("area"), n.alias("normal"))

    return let(F.struct(first.alias("a"), second.alias("b")), planed)


def half_distance(corners: Column, f: Column, normal: Column) -> Column:
    """From a cell's centre to its face, longer where the way there isn't along the faces' normal."""

    def length(way: Column) -> Column:
        along = F.abs(g.dot(point(normal), point(way)))
        return F.when(along > 0, g.dot(point(way), point(way)) / along).otherwise(g.norm(point(way)))

    return let(F.struct(middle(f).alias("f"), middle(corners).alias("c")), lambda m: let(vector(g.minus(point(m["f"]), point(m["c"]))), length))


def table_connections(cells: DataFrame, table: DataFrame, perm: Sequence[str] = ("permx", "permy", "permz"), ntg: str | float = 1.0, units: str = "metric", kind: str = "NestedHybrid") -> DataFrame:
    """(i1, j1, k1, i2, j2, k2, tran, type, direction): two-point flux through the faces of the cell pairs of a table
    (i1, j1, k1, i2, j2, k2, direction). direction is that of the first cell's face; the second cell's looks back at it.

    T = h1 h2 / (h1 + h2), h = k A / d; A is the area that the faces share, k is perm times ntg in I and J, and the third perm
    in K. Pairs with an unknown direction, with a cell that cells doesn't have, or with faces that share no area are left
    out. A pair that the table repeats is repeated. Inactive cells count like others, as the table names them.
    """
    net = F.col(ntg) if isinstance(ntg, str) else F.lit(float(ntg))
    own = cells.select(*IJK, corner_points().alias("corners"), *(F.col(p).alias(f"k{a}") for a, p in zip(IJK, perm, strict=True)), net.alias("net"))
    pairs = table.select(*(F.col(f"{a}{n}").cast("int").alias(f"{a}{n}") for n in "12" for a in IJK), F.trim("direction").alias("direction")).where(F.col("direction").isin(*FACES))
    for n in "12":
        pairs = pairs.join(own.withColumnsRenamed({a: f"{a}{n}" for a in IJK} | {c: f"{c}_{n}" for c in own.columns if c not in IJK}), [f"{a}{n}" for a in IJK])
    faces = pairs.withColumns({"f1": face(F.col("direction"), F.col("corners_1")), "f2": face(F.col("direction"), F.col("corners_2"), opposite=True)})
    # worked out once, in an array that is empty where nothing is shared
    met = faces.withColumn("o", F.explode(F.filter(F.array(overlap(F.col("f1"), F.col("f2"))), lambda o: o["area"] > 0)))
    halves = []
    for n in "12":
        k = of_direction(F.col("direction"), {d: F.col(f"k{d[0].lower()}_{n}") * (F.lit(1.0) if d[0] == "K" else F.col(f"net_{n}")) for d in FACES})
        halves.append(F.try_divide(k * F.col("o.area"), half_distance(F.col(f"corners_{n}"), F.col(f"f{n}"), F.col("o.normal"))))
    met = met.withColumn("h", F.struct(halves[0].alias("a"), halves[1].alias("b")))
    tran = F.coalesce(F.try_divide(F.col("h.a") * F.col("h.b"), F.col("h.a") + F.col("h.b")), F.lit(0.0)) * DARCY[units]
    return met.select(*(f"{a}{n}" for n in "12" for a in IJK), tran.alias("tran"), F.lit(kind).alias("type"), "direction")


def hole_faces(cells: DataFrame, nest: str, region: int) -> DataFrame:
    """(i, j, k, direction, f): faces of a region's active cells whose neighbour is in the hole (0, active or not)."""
    step = F.explode(F.array(*(F.struct(F.lit(d).alias("direction"), *(F.lit(s).alias(a) for a, s in zip(IJK, STEPS[d], strict=True))) for d in STEPS)))
    hole = cells.where(F.col(nest) == 0).select(*IJK, step.alias("s")).select(*((F.col(a) - F.col(f"s.{a}")).alias(a) for a in IJK), "s.direction")
    own = cells.where((F.col(nest) == region) & (F.col("actnum") == 1)).select(*IJK, corner_points().alias("corners"))
    return own.join(hole, IJK).select(*IJK, "direction", face(F.col("direction"), F.col("corners")).alias("f"))


def nested_table(cells: DataFrame, nest: str = "nest_id", mother: int = 1, refined: int = 2, least_area: float = 1e-3) -> DataFrame:
    """(i1, j1, k1, i2, j2, k2, direction): cells of the mother grid and of the refined one that touch across the hole's border.

    Both have faces to the hole (nest 0). Such faces meet by their place, in boxes made wider by their diagonals, tile by
    tile; those of opposite directions that share more than an area are a pair.
    """
    faces = [hole_faces(cells, nest, r) for r in (mother, refined)]
    faces = [cut(f.withColumn("wide", F.greatest(*(g.norm(diagonal(F.col("f"), k)) for k in (0, 1))))) for f in faces]
    boxed = [f.withColumns({f"{m}{a}": least(*(F.get("f", F.lit(k))[a] for k in range(4))) + sign * F.col("wide") for a in "xyz" for m, least, sign in (("lo", F.least, -1), ("hi", F.greatest, 1))}) for f in faces]
    tile = float(boxed[0].agg(F.avg("wide")).first()[0] or 1.0) * 3
    of = lambda c: F.floor(F.col(c) / tile).cast("long")
    for a in "xyz":
        boxed = [b.withColumn(f"t{a}", F.explode(F.sequence(of(f"lo{a}"), of(f"hi{a}")))) for b in boxed]
    back = F.create_map(*(F.lit(x) for pair in OPPOSITE.items() for x in pair))
    names = {c: f"o_{c}" for c in boxed[1].columns if c not in ("tx", "ty", "tz", "direction")}
    other = boxed[1].withColumnsRenamed(names).withColumn("direction", back[F.col("direction")])
    met = boxed[0].join(other, ["tx", "ty", "tz", "direction"])
    for a in "xyz":  # boxes that meet in several tiles count in the first
        met = met.where((F.col(f"lo{a}") <= F.col(f"o_hi{a}")) & (F.col(f"o_lo{a}") <= F.col(f"hi{a}")) & (F.col(f"t{a}") == F.greatest(of(f"lo{a}"), of(f"o_lo{a}"))))
    met = met.where(F.coalesce(overlap(F.col("f"), F.col("o_f"))["area"], F.lit(0.0)) > least_area)
    return met.select(*(F.col(a).alias(f"{a}1") for a in IJK), *(F.col(f"o_{a}").alias(f"{a}2") for a in IJK), "direction")


def refined_boundary(cells: DataFrame, connections: DataFrame) -> DataFrame:
    """(i, j, k, refined_boundary): 1 for the second cells of connections, 0 for the other cells."""
    second = connections.select(*(F.col(f"{a}2").alias(a) for a in IJK)).distinct().withColumn("refined_boundary", F.lit(1))
    return cells.select(*IJK).join(second, IJK, "left").fillna(0, ["refined_boundary"])
