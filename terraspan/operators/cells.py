"""Corner-point cells: cells(i, j, k, actnum, c0x .. c7z, ...properties), one row a cell, indices from 1.

Corners 0 to 3 are the top's, counter-clockwise from the south-west (0 sw, 1 se, 2 ne, 3 nw); 4 to 7 are those below.
A query that needs few corner columns reads only those. Neighbours are found by equi-joins or by windows along an axis.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraspan.functions import geometry as g
from terraspan.functions.lambdas import let
from terraspan.operators.intervals import overlapping
from terraspan.operators.rounds import cut

CORNERS = [f"c{n}{a}" for n in range(8) for a in "xyz"]
IJK = ["i", "j", "k"]
#: Which end of the cell each corner is at, in each direction.
ENDS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
#: Square metres in a millidarcy times what a day and a bar make of it, and the same in field units.
DARCY = {"metric": 8.527e-3, "feet": 1.127e-3}


def corner(n: int) -> g.Point:
    return F.col(f"c{n}x"), F.col(f"c{n}y"), F.col(f"c{n}z")


def corners() -> list[g.Point]:
    return [corner(n) for n in range(8)]


def mean(*columns: Column) -> Column:
    return reduce(lambda a, b: a + b, columns) / len(columns)


# --- sources --------------------------------------------------------------------------------------------------------


def box_grid(spark: SparkSession, dimension: tuple[int, int, int], origin: tuple[float, float, float] = (0, 0, 0), increment: tuple[float, float, float] = (1, 1, 1), rotation: float = 0.0, oricenter: bool = False, flip: int = 1) -> DataFrame:
    """A shoebox of active cells; origin is its first corner, or with oricenter the centre of its first cell."""
    nx, ny, nz = dimension
    n = F.col("id")
    cells = spark.range(nx * ny * nz).select((F.floor(n / (ny * nz)) + 1).cast("int").alias("i"), (F.floor(n / nz) % ny + 1).cast("int").alias("j"), (n % nz + 1).cast("int").alias("k"), F.lit(1).alias("actnum"))
    return with_box_corners(cells, origin, increment, rotation, oricenter, flip)


def with_box_corners(cells: DataFrame, origin: tuple[float, float, float], increment: tuple[float, float, float], rotation: float = 0.0, oricenter: bool = False, flip: int = 1) -> DataFrame:
    """Adds the corners of a shoebox to cells that have only indices."""
    c, s, half = math.cos(math.radians(rotation)), math.sin(math.radians(rotation)), 0.5 if oricenter else 0.0
    new = {}
    for n, (di, dj, dk) in enumerate(ENDS):
        u, v, w = ((F.col(x) - (1 - d + half)) * float(inc) for x, d, inc in zip(IJK, (di, dj, dk), increment, strict=True))
        new |= {f"c{n}x": F.lit(float(origin[0])) + u * c - v * (flip * s), f"c{n}y": F.lit(float(origin[1])) + u * s + v * (flip * c), f"c{n}z": F.lit(float(origin[2])) + w}
    return cells.withColumns(new)


def from_cube(traces: DataFrame, increment: tuple[float, float, float], origin: tuple[float, float, float], name: str = "seismics") -> DataFrame:
    """A box grid whose cells are centred on a cube's samples, with the samples as a property."""
    cells = traces.select("i", "j", F.posexplode("amp").alias("__k", name)).select("i", "j", (F.col("__k") + 1).alias("k"), F.lit(1).alias("actnum"), F.col(name).cast("double").alias(name))
    return with_box_corners(cells, origin, increment, oricenter=True)


def from_pillars(cells: DataFrame, pillars: DataFrame) -> DataFrame:
    """Corners from pillars(i, j, x_top, y_top, z_top, x_bot, y_bot, z_bot) and the cells' corner depths z0 .. z7: places along the straight pillars."""
    out = cells
    for n, (di, dj, _) in enumerate(ENDS[:4]):
        own = pillars.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.struct("x_top", "y_top", "z_top", "x_bot", "y_bot", "z_bot").alias(f"__p{n}"))
        out = out.join(own, ["i", "j"])
    new = {}
    for n in range(8):
        p, z = F.col(f"__p{n % 4}"), F.col(f"z{n}")
        t = F.coalesce(F.try_divide(z - p["z_top"], p["z_bot"] - p["z_top"]), F.lit(0.0))
        new |= {f"c{n}x": p["x_top"] + t * (p["x_bot"] - p["x_top"]), f"c{n}y": p["y_top"] + t * (p["y_bot"] - p["y_top"]), f"c{n}z": z}
    return out.withColumns(new).drop(*(f"__p{n}" for n in range(4)), *(f"z{n}" for n in range(8)))


def from_surfaces(surfaces: Sequence[DataFrame], header: g.MapHeader, dimension: tuple[int, int], origin: tuple[float, float], increment: tuple[float, float], rotation: float = 0.0, miss: float = 1000.0) -> DataFrame:
    """A layer between each two maps of a stack (all with one header), on vertical pillars.

    Where a map has no value at a pillar, its depth there is `miss`, and the columns around the pillar are inactive.
    """
    from terraspan.operators.surfaces import lattice, sample, with_xy

    nx, ny = dimension
    pillars = g.MapHeader(nx + 1, ny + 1, float(origin[0]), float(origin[1]), float(increment[0]), float(increment[1]), rotation)
    own = with_xy(lattice(surfaces[0].sparkSession, pillars), pillars)
    for n, nodes in enumerate(surfaces):
        own = sample(own, nodes, header, name=f"__s{n}")
    zs = F.array(*(F.col(f"__s{n}") for n in range(len(surfaces))))
    own = own.select("i", "j", "x", "y", F.transform(zs, lambda z: F.coalesce(z, F.lit(float(miss)))).alias("z"), F.exists(zs, lambda z: z.isNull()).alias("miss"))
    columns = lattice(surfaces[0].sparkSession, g.MapHeader(nx, ny))
    for n, (di, dj, _) in enumerate(ENDS[:4]):
        columns = columns.join(own.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.struct("x", "y", "z", "miss").alias(f"__p{n}")), ["i", "j"])
    cells = columns.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(len(surfaces) - 1))))
    missed = reduce(lambda a, b: a | b, (F.col(f"__p{n}.miss") for n in range(4)))
    new = {f"c{n}{a}": F.col(f"__p{n % 4}.{a}") for n in range(8) for a in "xy"} | {f"c{n}z": F.get(F.col(f"__p{n % 4}.z"), F.col("k") - (1 if n < 4 else 0)) for n in range(8)}
    return cells.withColumn("actnum", F.when(missed, 0).otherwise(1)).withColumns(new).drop(*(f"__p{n}" for n in range(4)))


# --- geometry -------------------------------------------------------------------------------------------------------


def with_centre(cells: DataFrame, names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Adds the mean of the corners."""
    return cells.withColumns({name: mean(*(F.col(f"c{n}{a}") for n in range(8))) for name, a in zip(names, "xyz", strict=True)})


def table(cells: DataFrame, props: Sequence[str], active_only: bool = True, discrete: Sequence[str] = ()) -> DataFrame:
    """ACTNUM (if not active_only), IX, JY, KZ, X_UTME, Y_UTMN, Z_TVDSS and properties; those of inactive cells are null, 0 if discrete."""
    own = with_centre(cells, ("X_UTME", "Y_UTMN", "Z_TVDSS"))
    index = [F.col(a).alias(b) for a, b in zip(IJK, ("IX", "JY", "KZ"), strict=True)]
    if active_only:
        return own.where("actnum = 1").select(*index, "X_UTME", "Y_UTMN", "Z_TVDSS", *props)
    value = lambda p: F.when(F.col("actnum") == 1, F.col(p)).otherwise(F.lit(0 if p in discrete else None)).alias(p)
    return own.select(F.col("actnum").alias("ACTNUM"), *index, "X_UTME", "Y_UTMN", "Z_TVDSS", *map(value, props))


METRICS = {
    "euclid": lambda a, b: g.norm(g.minus(b, a)),
    "horizontal": lambda a, b: F.sqrt((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2),
    "east west vertical": lambda a, b: F.sqrt((b[0] - a[0]) ** 2 + (b[2] - a[2]) ** 2),
    "north south vertical": lambda a, b: F.sqrt((b[1] - a[1]) ** 2 + (b[2] - a[2]) ** 2),
    "x projection": lambda a, b: b[0] - a[0],
    "y projection": lambda a, b: b[1] - a[1],
    "z projection": lambda a, b: b[2] - a[2],
}


def dx(metric: str = "horizontal") -> Column:
    """A cell's size along i: the mean over its four edges."""
    return mean(*(METRICS[metric](corner(a), corner(b)) for a, b in ((0, 1), (3, 2), (4, 5), (7, 6))))


def dy(metric: str = "horizontal") -> Column:
    return mean(*(METRICS[metric](corner(a), corner(b)) for a, b in ((0, 3), (1, 2), (4, 7), (5, 6))))


def dz(metric: str = "z projection") -> Column:
    return mean(*(METRICS[metric](corner(n), corner(n + 4)) for n in range(4)))


def bulk_volume(precision: int = 2) -> Column:
    """The cell's volume; 0 for cells without thickness."""
    return F.when(dz() < 1e-5, 0.0).otherwise(g.hexahedron(corners(), precision))


def thickness_share(top: Column, base: Column, contact_top: Column, contact_base: Column) -> Column:
    """The share of top to base that lies between two depths."""
    return F.greatest(F.lit(0.0), F.least(base, contact_base) - F.greatest(top, contact_top)) / F.nullif(base - top, F.lit(0.0))


def phase_volumes_in_parts(cells: DataFrame, water_contact: float | str, gas_contact: float | str, boundary: DataFrame | None = None, parts: tuple[int, int, int] = (9, 9, 4)) -> DataFrame:
    """(i, j, k, gas, oil, water) of active cells of any shape, inside of closed polygons if a boundary is given.

    Contacts are depths, or columns of the cells (sampled from a map, say). A cell is cut in so many parts in each direction;
    each part is split at the contacts by its mean top and base, and counts if its centre is inside of the boundary. A
    cell's volume is shared among its parts. Cells that no contact cuts are cut in parts only for the boundary.
    """
    from terraspan.operators.polygons import covering

    water, gas = g.number(water_contact), g.number(gas_contact)
    top, base = F.least(*(F.col(f"c{n}z") for n in range(8))), F.greatest(*(F.col(f"c{n}z") for n in range(8)))
    own = cells.where("actnum = 1").withColumns({"__v": bulk_volume(), "__w": water, "__g": gas, "__cell": F.struct(*IJK)}).select(*IJK, *CORNERS, "__v", "__w", "__g", "__cell")
    cut = F.lit(True) if boundary is not None else ((top < F.col("__w")) & (F.col("__w") < base)) | ((top < F.col("__g")) & (F.col("__g") < base))
    small = refine(own.where(cut), *parts).unionByName(own.where(~cut))
    small = small.withColumns({"__p": bulk_volume(), "__t": mean(*(F.col(f"c{n}z") for n in range(4))), "__b": mean(*(F.col(f"c{n}z") for n in range(4, 8)))})
    inside = F.lit(1.0)
    if boundary is not None:
        small, inside = covering(with_centre(small), boundary, "__n"), F.when(F.col("__n") > 0, 1.0).otherwise(0.0)
    lo, hi = F.lit(-1e30), F.lit(1e30)
    spans = {"gas": (lo, F.col("__g")), "oil": (F.col("__g"), F.col("__w")), "water": (F.greatest("__g", "__w"), hi)}
    level = lambda a, b: F.coalesce(thickness_share(F.col("__t"), F.col("__b"), a, b), F.lit(0.0))
    sums = small.groupBy("__cell").agg(*(F.sum(F.col("__p") * level(*s) * inside).alias(c) for c, s in spans.items()), F.sum("__p").alias("__all"), F.first("__v").alias("__v"))
    return sums.select("__cell.*", *(F.coalesce(F.try_divide(F.col(c) * F.col("__v"), F.col("__all")), F.lit(0.0)).alias(c) for c in spans))


def phase_volumes(cells: DataFrame, water_contact: float, gas_contact: float) -> DataFrame:
    """Adds gas, oil and water volumes of active cells between level contacts, from the mean top and base of a cell (exact for level boxes; phase_volumes_in_parts() takes others)."""
    volume = F.when(F.col("actnum") == 1, bulk_volume()).otherwise(0.0)
    own = cells.withColumns({"__v": volume, "__t": mean(*(F.col(f"c{n}z") for n in range(4))), "__b": mean(*(F.col(f"c{n}z") for n in range(4, 8)))})
    lo, hi = F.lit(-1e30), F.lit(1e30)
    gas, water = F.lit(float(gas_contact)), F.lit(float(water_contact))
    share = lambda a, b: F.coalesce(thickness_share(F.col("__t"), F.col("__b"), a, b), F.lit(0.0)) * F.col("__v")
    return own.withColumns({"gas": share(lo, gas), "oil": share(gas, water), "water": share(F.greatest(gas, water), hi)}).drop("__v", "__t", "__b")


def quality(cells: DataFrame) -> DataFrame:
    """Adds ten marks of a cell's shape: least and largest angles of top and base (in space and in the map) and of the sides; collapsed, negative_thickness, concave_proj, and (with faulted()) faulted."""

    def angles(ring: Sequence[int], flat: bool) -> list[Column]:
        p = [(*corner(n)[:2], F.lit(0.0)) if flat else corner(n) for n in ring]
        return [g.angle_between(g.minus(p[k - 1], p[k]), g.minus(p[(k + 1) % 4], p[k])) for k in range(4)]

    top, base = (0, 1, 2, 3), (4, 5, 6, 7)
    sides = [(0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)]
    flat, space = angles(top, True) + angles(base, True), angles(top, False) + angles(base, False)
    side = [a for s in sides for a in angles(s, False)]
    turn = lambda ring: [F.signum(g.cross((*g.minus(corner(ring[(k + 1) % 4]), corner(ring[k]))[:2], F.lit(0.0)), (*g.minus(corner(ring[(k + 2) % 4]), corner(ring[(k + 1) % 4]))[:2], F.lit(0.0)))[2]) for k in range(4)]
    bent = lambda ring: F.greatest(*turn(ring)) * F.least(*turn(ring)) < 0
    thick = [F.col(f"c{n + 4}z") - F.col(f"c{n}z") for n in range(4)]
    return cells.withColumns({
        "minangle_topbase": F.least(*space), "maxangle_topbase": F.greatest(*space), "minangle_topbase_proj": F.least(*flat), "maxangle_topbase_proj": F.greatest(*flat),
        "minangle_sides": F.least(*side), "maxangle_sides": F.greatest(*side), "collapsed": F.when(F.least(*(F.abs(t) for t in thick)) <= 0.001, 1).otherwise(0),
        "negative_thickness": F.when(F.least(*thick) < 0, 1).otherwise(0), "concave_proj": F.when(bent(top) | bent(base), 1).otherwise(0),
    })


def faulted(cells: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Adds faulted: 1 where a corner at the side to a neighbour in i or j differs in z from the neighbour's."""
    face = {"i": ((1, 0), (2, 3), (5, 4), (6, 7)), "j": ((3, 0), (2, 1), (7, 4), (6, 5))}
    out = cells
    split = F.lit(False)
    for axis, pairs in face.items():
        w = Window.partitionBy(*(c for c in IJK if c != axis)).orderBy(axis)
        for step, ends in ((1, pairs), (-1, tuple((b, a) for a, b in pairs))):
            next_to = F.lead(axis, 1).over(w) == F.col(axis) + 1 if step == 1 else F.lag(axis, 1).over(w) == F.col(axis) - 1
            at = lambda n, s=step, v=w: (F.lead if s == 1 else F.lag)(f"c{n}z").over(v)
            split = split | F.coalesce(next_to & reduce(lambda a, b: a | b, (F.abs(F.col(f"c{a}z") - at(b)) > tolerance for a, b in ends)), F.lit(False))
    return out.withColumn("faulted", split.cast("int"))


def heights_above(cells: DataFrame, level: Column, option: str = "cell_center_above_ffl") -> DataFrame:
    """Adds htop, hbot and hmid above a free fluid level: never below 0; from the mean corners, from the corners that are farthest, or with the cell cut at the level."""
    tops, bases = [F.col(f"c{n}z") for n in range(4)], [F.col(f"c{n}z") for n in range(4, 8)]
    top, base = (F.least(*tops), F.greatest(*bases)) if option == "cell_corners_above_ffl" else (mean(*tops), mean(*bases))
    above = lambda z: F.greatest(level - z, F.lit(0.0))
    own = cells.withColumns({"htop": above(top), "hbot": above(base)})
    mid = (F.col("htop") + F.col("hbot")) / 2
    if option == "cell_center_above_ffl":
        mid = above((top + base) / 2)
    return own.withColumn("hmid", mid)


def layer_outline(cells: DataFrame, layer: int, top: bool = True, active_only: bool = True) -> DataFrame:
    """Closed rings of five vertices around the cells of a layer, at their top or base."""
    ring = [n + (0 if top else 4) for n in (0, 1, 2, 3, 0)]
    own = cells.where(F.col("k") == layer).where("actnum = 1") if active_only else cells.where(F.col("k") == layer)
    vertices = F.array(*(F.struct(F.col(f"c{n}x").alias("x"), F.col(f"c{n}y").alias("y"), F.col(f"c{n}z").alias("z")) for n in ring))
    return own.select(*IJK, F.posexplode(vertices).alias("seq", "v")).select(*IJK, "seq", "v.x", "v.y", "v.z")


def geometrics(cells: DataFrame, active_only: bool = True) -> DataFrame:
    """One row: the first cell's centre, bounds of the centres, mean sizes and rotation, and whether sizes vary by under 1 %."""
    own = with_centre(cells.where("actnum = 1") if active_only else cells).withColumns({"dx": dx(), "dy": dy(), "dz": dz()})
    angle = F.atan2(F.col("c1y") - F.col("c0y"), F.col("c1x") - F.col("c0x"))
    out = own.agg(
        F.min_by("x", F.struct("k", "j", "i")).alias("xori"), F.min_by("y", F.struct("k", "j", "i")).alias("yori"), F.min_by("z", F.struct("k", "j", "i")).alias("zori"),
        *(f(c).alias(f"{c}{n}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))), F.avg("dx").alias("avg_dx"), F.avg("dy").alias("avg_dy"), F.avg("dz").alias("avg_dz"),
        F.degrees(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))).alias("avg_rotation"), (F.max(F.col("dx")) - F.min("dx")).alias("__rx"), (F.max("dy") - F.min("dy")).alias("__ry"),
    )
    return out.withColumn("regular", (F.col("__rx") < 0.01 * F.col("avg_dx")) & (F.col("__ry") < 0.01 * F.col("avg_dy"))).drop("__rx", "__ry")


# --- activity and indices -------------------------------------------------------------------------------------------


def activate_all(cells: DataFrame) -> DataFrame:
    return cells.withColumn("actnum", F.lit(1))


def inactivate_by_dz(cells: DataFrame, threshold: float) -> DataFrame:
    return cells.withColumn("actnum", F.when(dz() < threshold, 0).otherwise(F.col("actnum")))


def inactivate(cells: DataFrame, polygons: DataFrame, layers: tuple[int, int] | None = None, inside: bool = True) -> DataFrame:
    """Cells whose centre is inside (or outside) of polygons become inactive, in a range of layers."""
    from terraspan.operators.polygons import covering

    marked = covering(with_centre(cells), polygons, "__n")
    hit = F.col("__n") > 0 if inside else F.col("__n") == 0
    if layers:
        hit = hit & F.col("k").between(*layers)
    return marked.withColumn("actnum", F.when(hit, 0).otherwise(F.col("actnum"))).drop("__n", "x", "y", "z")


def operate(cells: DataFrame, polygons: DataFrame, prop: str, operation: str, value: float = 0.0, inside: bool = True) -> DataFrame:
    """Changes a property (set, add, sub, mul, div) of the cells whose centre is in any polygon, or in none; its type stays, division by zero gives zero."""
    from terraspan.operators import polygons as p

    kind = cells.schema[prop].dataType
    own = with_centre(cells, ("__x", "__y", "__z")).withColumnsRenamed({c: f"__own_{c}" for c in "xyz" if c in cells.columns}).withColumnsRenamed({f"__{c}": c for c in "xyz"})
    out = p.operate(own, polygons, operation, value, inside, 2, prop).drop("x", "y", "z").withColumnsRenamed({f"__own_{c}": c for c in "xyz"})
    return out.withColumn(prop, F.col(prop).cast(kind)).select(*cells.columns)


def crop(cells: DataFrame, columns: tuple[int, int], rows: tuple[int, int], layers: tuple[int, int]) -> DataFrame:
    """A box of cells, counted anew from 1."""
    own = cells
    for c, (a, b) in zip(IJK, (columns, rows, layers), strict=True):
        own = own.where(F.col(c).between(a, b)).withColumn(c, F.col(c) - (a - 1))
    return own


def reverse(cells: DataFrame, axis: str, n: int) -> DataFrame:
    """Columns (i) or rows (j) counted from the other side; corners keep their names by the new directions."""
    swap = {"i": (1, 0, 3, 2, 5, 4, 7, 6), "j": (3, 2, 1, 0, 7, 6, 5, 4)}[axis]
    return cells.withColumns({axis: F.lit(n + 1) - F.col(axis)} | {f"c{a}{x}": F.col(f"c{b}{x}") for a, b in enumerate(swap) for x in "xyz"})


def scale(cells: DataFrame, factor: float) -> DataFrame:
    """All coordinates in another unit."""
    return cells.withColumns({c: F.col(c) * factor for c in CORNERS})


def translate(cells: DataFrame, shift: tuple[float, float, float] = (0, 0, 0), rotation: float = 0.0, about: tuple[float, float] = (0, 0), flip_z: bool = False) -> DataFrame:
    """All corners turned about a point, then shifted; flip_z mirrors depths first."""
    c, s = math.cos(math.radians(rotation)), math.sin(math.radians(rotation))
    new = {}
    for n in range(8):
        u, v = F.col(f"c{n}x") - about[0], F.col(f"c{n}y") - about[1]
        new |= {f"c{n}x": u * c - v * s + (about[0] + shift[0]), f"c{n}y": u * s + v * c + (about[1] + shift[1]), f"c{n}z": F.col(f"c{n}z") * (-1.0 if flip_z else 1.0) + float(shift[2])}
    return cells.withColumns(new)


def refine(cells: DataFrame, fi: int = 1, fj: int = 1, fk: int = 1) -> DataFrame:
    """Each cell split in equal parts; properties are repeated. Corners are trilinear in the cell's."""
    parts = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in range(fi) for b in range(fj) for c in range(fk))))
    own = cells.withColumn("__p", parts)
    new: dict[str, Column] = {"i": (F.col("i") - 1) * fi + F.col("__p.a") + 1, "j": (F.col("j") - 1) * fj + F.col("__p.b") + 1, "k": (F.col("k") - 1) * fk + F.col("__p.c") + 1}
    for n, (di, dj, dk) in enumerate(ENDS):
        u, v, w = ((F.col(f"__p.{c}") + d) / f for c, d, f in zip("abc", (di, dj, dk), (fi, fj, fk), strict=True))
        for x in "xyz":
            new[f"c{n}{x}"] = reduce(lambda a, b: a + b, (F.col(f"c{m}{x}") * (u if ei else 1 - u) * (v if ej else 1 - v) * (w if ek else 1 - w) for m, (ei, ej, ek) in enumerate(ENDS)))
    return own.withColumns(new).drop("__p")


def refine_vertically(cells: DataFrame, factor: int | dict[int, int], zone: str | None = None) -> DataFrame:
    """Layers split in equal parts; a dict gives the factor for each zone (by layers, which must not mix zones)."""
    if isinstance(factor, int):
        return refine(cells, 1, 1, factor)
    of = F.coalesce(F.create_map(*(F.lit(x) for kv in factor.items() for x in kv))[F.col(zone)], F.lit(1))
    layers = cells.groupBy("k").agg(F.first(of).alias("__f")).withColumn("__before", F.coalesce(F.sum("__f").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))  # a row a layer
    own = cells.join(F.broadcast(layers), "k").withColumn("__c", F.explode(F.sequence(F.lit(0), F.col("__f") - 1)))
    new: dict[str, Column] = {"k": F.col("__before") + F.col("__c") + 1}
    for n in range(8):
        t = (F.col("__c") + (1 if n > 3 else 0)) / F.col("__f")
        new |= {f"c{n}{x}": F.col(f"c{n % 4}{x}") + t * (F.col(f"c{n % 4 + 4}{x}") - F.col(f"c{n % 4}{x}")) for x in "xyz"}
    return own.withColumns(new).drop("__f", "__before", "__c")


def merge(a: DataFrame, b: DataFrame, columns_of_a: int, layers_a: Sequence[int] | None = None, layers_b: Sequence[int] | None = None) -> DataFrame:
    """Two grids side by side, with an empty column between; a property that one lacks is null there.

    layers_a and layers_b: the layer of the merged grid that each of a grid's layers becomes, ascending; without them
    layers stay. Layers of the merged grid that a grid has none for are without cells there, and so is the column between:
    rectangular() adds inactive ones.
    """

    def moved(cells: DataFrame, layers: Sequence[int] | None) -> DataFrame:
        if layers is None:
            return cells
        if any(y <= x for x, y in zip(layers, layers[1:])):
            raise ValueError("layers have to ascend")
        return cells.withColumn("k", F.get(F.array(*map(F.lit, layers)), F.col("k") - 1))

    return moved(a, layers_a).unionByName(moved(b.withColumn("i", F.col("i") + columns_of_a + 1), layers_b), allowMissingColumns=True)


def rectangular(cells: DataFrame, dimension: tuple[int, int, int]) -> DataFrame:
    """A cell for each (i, j, k): those that are missing come as inactive ones, their properties null.

    Their corners lie on the nodes around them. A node's depth between two layers is the mean of its cells' corners there; one
    that no cell has is that above it, or else that below, so missing layers have no height, and close the gap. A node
    without cells takes place and depths of the nearest one that has some (by indices; of equally near ones the least i,
    then j), and stands upright. So a merged grid has its gap filled, and any writer can take it.
    """
    from terraspan.operators.surfaces import fill, lattice

    nx, ny, nz = dimension
    at = F.explode(F.array(*(F.struct((F.col("i") + di).alias("ni"), (F.col("j") + dj).alias("nj"), (F.col("k") - 1 + dk).alias("m"), *(F.col(f"c{n}{a}").alias(a) for a in "xyz")) for n, (di, dj, dk) in enumerate(ENDS))))
    corners_ = cells.select(at.alias("p")).select("p.*")
    means = corners_.groupBy("ni", "nj", "m").agg(*(F.avg(a).alias(a) for a in "xyz"))
    line = lambda e, of: of(F.struct("x", "y", "z"), "z").alias(e)
    nodes = means.groupBy("ni", "nj").agg(F.map_from_entries(F.collect_list(F.struct("m", "z"))).alias("at"), line("t", F.min_by), line("b", F.max_by))  # an entry a layer
    every = F.sequence(F.lit(0), F.lit(nz))
    known = F.transform(every, lambda m: F.try_element_at("at", m))
    above = F.transform(every, lambda m: F.try_element_at(F.filter(F.slice("z", F.lit(1), m + 1), lambda z: z.isNotNull()), F.lit(-1)))
    below = F.try_element_at(F.filter("z", lambda z: z.isNotNull()), F.lit(1))
    nodes = cut(nodes.withColumn("z", known).withColumn("z", F.transform(above, lambda z: F.coalesce(z, below))).select("ni", "nj", "t", "b", "z"))
    # which node each one takes its place from
    own = nodes.select(F.col("ni").alias("i"), F.col("nj").alias("j"), ((F.col("ni") - 1) * (ny + 1) + F.col("nj")).cast("double").alias("value"))
    source = fill(own, g.MapHeader(nx + 1, ny + 1)).select(F.col("i").alias("ni"), F.col("j").alias("nj"), (F.floor((F.col("value") - 1) / (ny + 1)) + 1).cast("int").alias("si"), (F.pmod(F.col("value") - 1, F.lit(ny + 1)) + 1).cast("int").alias("sj"))
    placed = cut(source.join(nodes.withColumnsRenamed({"ni": "si", "nj": "sj"}), ["si", "sj"]).select("ni", "nj", F.struct("t", "b", "z", ((F.col("ni") == F.col("si")) & (F.col("nj") == F.col("sj"))).alias("own")).alias("p")))
    columns = lattice(cells.sparkSession, g.MapHeader(nx, ny))
    missing = columns.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(nz)))).join(cells.select(*IJK), IJK, "left_anti")
    for n, (di, dj, _) in enumerate(ENDS[:4]):
        missing = missing.join(placed.select((F.col("ni") - di).alias("i"), (F.col("nj") - dj).alias("j"), F.col("p").alias(f"__p{n}")), ["i", "j"])
    new = {}
    for n in range(8):
        q = F.col(f"__p{n % 4}")
        z = F.get(q["z"], F.col("k") - (1 if n < 4 else 0))
        share = F.when(q["own"], F.coalesce(F.try_divide(z - q["t"]["z"], q["b"]["z"] - q["t"]["z"]), F.lit(0.0))).otherwise(0.0)
        new |= {f"c{n}{a}": q["t"][a] + share * (q["b"][a] - q["t"][a]) for a in "xy"} | {f"c{n}z": z}
    return cells.unionByName(missing.withColumns({"actnum": F.lit(0), **new}).drop(*(f"__p{n}" for n in range(4))), allowMissingColumns=True)


def reduce_to_one_layer(cells: DataFrame) -> DataFrame:
    """One cell a column: the top of its first layer, the base of its last, active if any was."""
    tops, bases = F.struct(*(f"c{n}{x}" for n in range(4) for x in "xyz")), F.struct(*(f"c{n}{x}" for n in range(4, 8) for x in "xyz"))
    out = cells.groupBy("i", "j").agg(F.lit(1).alias("k"), F.max("actnum").alias("actnum"), F.min_by(tops, "k").alias("t"), F.max_by(bases, "k").alias("b"))
    return out.select("i", "j", "k", "actnum", "t.*", "b.*")


def collapse_inactive(cells: DataFrame) -> DataFrame:
    """Inactive cells get no thickness: their corners go to the base of the active cell above, or else to the top of the one below."""
    above = Window.partitionBy("i", "j").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("i", "j").orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    on = F.col("actnum") == 1
    new = {}
    for n in range(8):
        up, down = F.last(F.when(on, F.col(f"c{n % 4 + 4}z")), True).over(above), F.first(F.when(on, F.col(f"c{n % 4}z")), True).over(below)
        new[f"c{n}z"] = F.when(on, F.col(f"c{n}z")).otherwise(F.coalesce(up, down, F.col(f"c{n}z")))
    return cells.withColumns(new)


def make_z_consistent(cells: DataFrame, separation: float = 1e-5) -> DataFrame:
    """Each corner pushed down so that it lies at least the separation below the one above it in its column.

    The greatest of z - n * separation so far, where n counts corners down the column, plus n * separation.
    """
    w = Window.partitionBy("i", "j").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("i", "j").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("k") * 2.0
    new = {}
    for c in range(4):
        top, base = F.col(f"c{c}z") - (n - 2) * separation, F.col(f"c{c + 4}z") - (n - 1) * separation
        new[f"c{c}z"] = F.greatest(top, F.coalesce(F.max(F.greatest(top, base)).over(before), top)) + (n - 2) * separation
        new[f"c{c + 4}z"] = F.max(F.greatest(top, base)).over(w) + (n - 1) * separation
    return cells.withColumns(new)


def hybrid(cells: DataFrame, nhdiv: int, top: float, bottom: float, layers: int) -> DataFrame:
    """2 * layers + nhdiv layers: above `top` the old ones, cut there; then nhdiv level ones between top and bottom; then the old ones again, cut at `bottom`.

    Above and below, a layer without room is empty. In level ones, properties are null.
    """
    clip = lambda lo, hi: {f"c{n}z": F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col(f"c{n}z"))) for n in range(8)}
    props = [c for c in cells.columns if c not in (*IJK, "actnum", *CORNERS)]
    upper = cells.withColumns(clip(-1e30, top))
    lower = cells.withColumns(clip(bottom, 1e30)).withColumn("k", F.col("k") + layers + nhdiv)
    middle = reduce_to_one_layer(cells).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(nhdiv))))
    step = (bottom - top) / nhdiv
    level = {}
    for n in range(8):
        z = F.lit(float(top)) + step * (F.col("k") - (1 if n < 4 else 0))
        level[f"c{n}z"] = F.greatest(F.col(f"c{n % 4}z"), F.least(F.col(f"c{n % 4 + 4}z"), z))
    middle = middle.withColumns(level).withColumn("k", F.col("k") + layers).withColumns({p: F.lit(None).cast(dict(cells.dtypes)[p]) for p in props})
    out = upper.unionByName(middle).unionByName(lower)
    return out.withColumn("actnum", F.when(dz() > 1e-5, F.col("actnum")).otherwise(0))


# --- zones ----------------------------------------------------------------------------------------------------------


def subgrids(cells: DataFrame, zone: str = "zone") -> DataFrame:
    """(zone, kmin, kmax) of each zone."""
    return cells.groupBy(zone).agg(F.min("k").alias("kmin"), F.max("k").alias("kmax"))


def zones_of(cells: DataFrame, ranges: DataFrame, zone: str = "zone") -> DataFrame:
    """The inverse: adds the zone whose range holds the layer. Ranges are exploded to layers, so the join is on equal k."""
    layers = ranges.select(F.col(zone), F.explode(F.sequence("kmin", "kmax")).alias("k"))
    return cells.join(layers, "k", "left")


def design(cells: DataFrame, zone: str = "zone") -> DataFrame:
    """(zone, design, dzsim): how layers were made, from the column of median thickness in each zone: P proportional, T parallel to the top (the last is thin), B to the base, X for one layer, M mixed."""
    own = cells.withColumn("dz", dz())
    columns = own.groupBy(zone, "i", "j").agg(F.sum("dz").alias("sum"), F.avg("dz").alias("mean"), F.min_by("dz", "k").alias("first"), F.max_by("dz", "k").alias("last"), F.count(F.lit(1)).alias("n"), F.stddev_pop("dz").alias("std"))
    ranked = columns.withColumns({"r": F.row_number().over(Window.partitionBy(zone).orderBy("sum", "i", "j")), "of": F.count(F.lit(1)).over(Window.partitionBy(zone))})
    median = ranked.where("r = cast(floor((of + 1) / 2) as int)")
    eps, m = F.col("mean") * 0.01, F.col("mean")
    kind = F.when(F.col("n") == 1, "X").when(F.col("std") <= eps, "P").when((F.col("last") < m / 2 + eps) & (F.col("first") > m / 2 - eps), "T").when((F.col("first") < m / 2 + eps) & (F.col("last") > m / 2 - eps), "B").otherwise("M")
    return median.select(zone, kind.alias("design"), F.col("mean").alias("dzsim"))


# --- joins ----------------------------------------------------------------------------------------------------------


def lookup(places: DataFrame, cells: DataFrame, props: Sequence[str]) -> DataFrame:
    """Properties by (i, j, k); null out of range, in inactive cells and for null indices."""
    return places.join(cells.where("actnum = 1").select(*IJK, *props), IJK, "left")


def adjacent(cells: DataFrame, prop: str, a: int, b: int) -> DataFrame:
    """(i, j, k, flag): active cells of value a: 0, 1 if a neighbour in i, j or k is active with value b, 2 if one in i or j whose shared corners are split by a fault."""
    own = cells.where("actnum = 1")
    steps = [(1, 0, 0, ((1, 0), (2, 3), (5, 4), (6, 7))), (0, 1, 0, ((3, 0), (2, 1), (7, 4), (6, 5))), (0, 0, 1, ())]
    each = F.array(*(F.struct(*(F.lit(s * d).alias(c) for c, d in zip(("di", "dj", "dk"), st[:3], strict=True)), F.lit(n).alias("n"), F.lit(s).alias("s")) for n, st in enumerate(steps) for s in (1, -1)))
    zs = [f"c{n}z" for n in range(8)]
    # cells of value b go to the places of their six neighbours
    other = own.where(F.col(prop) == b).select(*IJK, *zs, F.explode(each).alias("d")).select(*((F.col(c) + F.col(f"d.d{c}")).alias(c) for c in IJK), "d.n", "d.s", *(F.col(z).alias(f"o_{z}") for z in zs))
    split = F.lit(False)
    for n, st in enumerate(steps[:2]):
        for s in (1, -1):
            pairs = st[3]  # (corner of the lower cell, corner of the upper one); s = 1: the other is the lower
            apart = reduce(lambda x, y: x | y, (F.abs((F.col(f"o_c{p}z") if s == 1 else F.col(f"c{p}z")) - (F.col(f"c{q}z") if s == 1 else F.col(f"o_c{q}z"))) > 1e-6 for p, q in pairs))
            split = split | ((F.col("n") == n) & (F.col("s") == s) & apart)
    hits = own.where(F.col(prop) == a).join(other, IJK).withColumn("flag", F.when(split, 2).otherwise(1)).groupBy(*IJK).agg(F.max("flag").alias("flag"))
    return own.where(F.col(prop) == a).select(*IJK).join(hits, IJK, "left").withColumn("flag", F.coalesce("flag", F.lit(0)))


def between_surfaces(cells: DataFrame, top: DataFrame, base: DataFrame, header: g.MapHeader, value: float = 1.0, name: str = "between_surfaces") -> DataFrame:
    """Adds value where the cell's centre is between two maps, both included, else 0."""
    from terraspan.operators.surfaces import sample

    own = with_centre(cells)
    own = sample(sample(own, top, header, name="__top"), base, header, name="__base")
    return own.withColumn(name, F.when(F.col("z").between(F.col("__top"), F.col("__base")), value).otherwise(0.0)).drop("__top", "__base", "x", "y", "z")


def layer_map(cells: DataFrame, header: g.MapHeader, where: str | int = "top", prop: str = "depth", tile: float | None = None, per: str | None = None) -> DataFrame:
    """(i, j, value): a map of the first layer's top ("top"), the last one's base ("base") or a layer's top, in its active cells: its depth, a property, or the cell's "i" or "j".

    A node takes its value from the cell whose outline it is in (of several the least i, then j); the depth is a plane's
    through the half of the outline that holds the node. Nodes and cells meet in tiles of the map. per: a column by which
    cells have a map each ("zone", say); it comes before i and j.
    """
    from terraspan.operators.surfaces import lattice, with_xy

    on = cells.where("actnum = 1")
    if isinstance(where, int):
        own, low = on.where(F.col("k") == where), 0
    else:
        low = 0 if where == "top" else 4
        whole = F.struct(*CORNERS, *([] if prop in ("depth", "i", "j") else [prop]))
        own = on.groupBy(*([per] if per else []), "i", "j").agg((F.min_by if where == "top" else F.max_by)(whole, "k").alias("__c")).select(*([per] if per else []), "i", "j", "__c.*")
    xs, ys = [F.col(f"c{n + low}x") for n in range(4)], [F.col(f"c{n + low}y") for n in range(4)]
    tile = tile or 4 * max(header.xinc, header.yinc)
    span = lambda c: F.explode(F.sequence(F.floor(F.least(*c) / tile).cast("long"), F.floor(F.greatest(*c) / tile).cast("long")))
    ring = [f"c{n + low}{a}" for n in range(4) for a in "xyz"]
    value = {"depth": F.lit(None).cast("double"), "i": F.col("i").cast("double"), "j": F.col("j").cast("double")}.get(prop)
    quads = own.select(*([F.col(per).alias("__per")] if per else []), F.col("i").alias("__i"), F.col("j").alias("__j"), *ring, (F.col(prop).cast("double") if value is None else value).alias("__v"), span(xs).alias("__tx")).withColumn("__ty", span(ys))
    nodes = with_xy(lattice(cells.sparkSession, header), header).withColumns({"__tx": F.floor(F.col("x") / tile).cast("long"), "__ty": F.floor(F.col("y") / tile).cast("long")})

    def within(a: int, b: int, c: int) -> tuple[Column, Column]:
        """Is the node in this triangle, and the depth of its plane there."""
        ax, ay, az, bx, by, bz, dx, dy, dz_ = (F.col(f"c{n + low}{x}") for n in (a, b, c) for x in "xyz")
        det = (bx - ax) * (dy - ay) - (dx - ax) * (by - ay)
        u = F.try_divide((F.col("x") - ax) * (dy - ay) - (F.col("y") - ay) * (dx - ax), det)
        v = F.try_divide((F.col("y") - ay) * (bx - ax) - (F.col("x") - ax) * (by - ay), det)
        return F.coalesce((u >= 0) & (v >= 0) & (u + v <= 1), F.lit(False)), az + u * (bz - az) + v * (dz_ - az)

    (in1, z1), (in2, z2) = within(0, 1, 2), within(0, 2, 3)
    hits = nodes.join(quads, ["__tx", "__ty"]).withColumns({"__h1": in1, "__h2": in2}).where("__h1 or __h2")
    depth = F.when(F.col("__h1"), z1).otherwise(z2)
    out = hits.groupBy(*(["__per"] if per else []), "i", "j").agg(F.min_by(depth if prop == "depth" else F.col("__v"), F.struct("__i", "__j")).alias("value"))
    return out.withColumnRenamed("__per", per) if per else out


def zone_maps(cells: DataFrame, header: g.MapHeader, zone: str = "zone") -> DataFrame:
    """(zone, i, j, value): the top of each zone as a map, and the base of the grid, whose zone is null."""
    base = layer_map(cells, header, "base").withColumn(zone, F.lit(None).cast(cells.schema[zone].dataType))
    return layer_map(cells, header, "top", per=zone).unionByName(base)


def slice_surface(nodes: DataFrame, header: g.MapHeader, cells: DataFrame, prop: str, tile: float) -> DataFrame:
    """(i, j, value): a property along a map of depths: that of the cell that each node is in; null outside."""
    from terraspan.operators.surfaces import with_xy

    places = with_xy(nodes.where(F.col("value").isNotNull()), header).select(F.struct("i", "j").alias("__n"), "x", "y", F.col("value").alias("z"), F.struct("i", "j").alias("__id"))
    found = lookup(points_in_cells(places, cells, tile, "__id"), cells, [prop])
    return found.select("__n.i", "__n.j", F.col(prop).alias("value"))


def random_line(fence: DataFrame, cells: DataFrame, prop: str, zmin: float, zmax: float, zinc: float, tile: float) -> DataFrame:
    """(poly_id, seq, h, z, value): a vertical section through a property along a fence(poly_id, seq, x, y, h)."""
    n = int(round((zmax - zmin) / zinc))
    places = fence.select("poly_id", "seq", "h", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("__n")).withColumn("z", zmin + F.col("__n") * zinc)
    places = places.withColumn("__id", F.struct("poly_id", "seq", "__n"))
    found = lookup(points_in_cells(places, cells, tile, "__id"), cells, [prop])
    return found.select("poly_id", "seq", "h", "z", F.col(prop).alias("value"))


def zone_ends(cells: DataFrame, layers: Sequence[int]) -> DataFrame:
    """(i, j, n, ni, nj, zone, x0, y0, top, x1, y1, base): of each column, pillar n of its four and zone (from 0): where the zone's first and last layer begin and end on the pillar; (ni, nj) names the node that columns share."""
    ends = [sum(layers[: n + 1]) for n in range(len(layers))]
    zone = reduce(lambda a, b: a + b, (F.when(F.col("k") > e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    four = lambda first: F.array(*(F.struct(*(F.col(f"c{n + first}{a}").alias(a) for a in "xyz")) for n in range(4)))
    own = cells.withColumn("zone", zone).groupBy("i", "j", "zone").agg(F.min_by(four(0), "k").alias("t"), F.max_by(four(4), "k").alias("b"))
    pillar = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(di).alias("di"), F.lit(dj).alias("dj"), F.get("t", F.lit(n)).alias("t"), F.get("b", F.lit(n)).alias("b")) for n, (di, dj, _) in enumerate(ENDS[:4]))))
    own = own.select("i", "j", "zone", pillar.alias("p"))
    return own.select("i", "j", "p.n", (F.col("i") + F.col("p.di")).alias("ni"), (F.col("j") + F.col("p.dj")).alias("nj"), "zone", *(F.col(f"p.t.{a}").alias(x) for a, x in (("x", "x0"), ("y", "y0"), ("z", "top"))), *(F.col(f"p.b.{a}").alias(x) for a, x in (("x", "x1"), ("y", "y1"), ("z", "base"))))


def faulted_nodes(cells: DataFrame, throw: float = 0.01) -> DataFrame:
    """(ni, nj): nodes on which corners of one layer, of two columns, are further apart than the throw."""
    at = F.explode(F.array(*(F.struct((F.col("i") + di).alias("ni"), (F.col("j") + dj).alias("nj"), F.col(f"c{n}z").alias("t"), F.col(f"c{n + 4}z").alias("b")) for n, (di, dj, _) in enumerate(ENDS[:4]))))
    own = cells.select("k", at.alias("p")).groupBy("p.ni", "p.nj", "k")
    spread = lambda z: F.max(f"p.{z}") - F.min(f"p.{z}")
    return own.agg(F.greatest(spread("t"), spread("b")).alias("s")).where(F.col("s") > throw).select("ni", "nj").distinct()


def conform(cells: DataFrame, surfaces: Sequence[DataFrame], header: g.MapHeader, layers: Sequence[int], faults: str = "keep", pillars: DataFrame | None = None) -> DataFrame:
    """Cells whose zone boundaries lie on maps; layers between them keep their shares. layers: how many each zone has, so there is one map more than zones.

    Corners move along their pillars, whatever their slant: pillars(i, j, x_top, y_top, z_top, x_bot, y_bot, z_bot), or else the
    lines from each node's highest corner to its lowest. A pillar meets a map within half its length beyond its ends, at
    the first such place; a lower map never lies above a higher one. Columns that share a pillar keep their throw there:
    on it, the mean of their boundaries lies on the map (faults="keep"). "skip" leaves pillars with a throw of over 0.01
    as they are, "level" brings each column to the map by itself. Zones without height stay so, and corners of a column
    never come to lie above those over them. Pillars that miss a map, and level ones, are left as they are.
    """
    from terraspan.operators.surfaces import pierced

    if len(surfaces) != len(layers) + 1 or min(layers, default=0) < 1:
        raise ValueError("one map more than zones is asked for, and zones of one layer or more")
    if faults not in ("keep", "skip", "level"):
        raise ValueError("faults is keep, skip or level")
    node, zones = ["ni", "nj"], range(len(layers))
    ends = cut(zone_ends(cells, layers))
    if pillars is None:
        line = ends.groupBy(*node).agg(F.min_by(F.struct("x0", "y0", F.col("top").alias("z0")), "top").alias("a"), F.max_by(F.struct("x1", "y1", F.col("base").alias("z1")), "base").alias("b")).select(*node, "a.*", "b.*")
    else:
        line = pillars.select(F.col("i").alias("ni"), F.col("j").alias("nj"), *(F.col(f"{a}_{e}").alias(f"{a}{n}") for n, e in (("0", "top"), ("1", "bot")) for a in "xyz"))
    if faults == "skip":
        line = line.join(faulted_nodes(cells), node, "left_anti")
    line = cut(line)
    for n, nodes in enumerate(surfaces):
        line = line.join(pierced(line.select(*node, *(f"{a}{e}" for e in "01" for a in "xyz")), nodes, header, node, f"__s{n}"), node)
        if n:
            line = line.withColumn(f"__s{n}", F.greatest(f"__s{n}", f"__s{n - 1}"))
    boundaries = F.array(*(F.col(f"__s{n}") for n in range(len(surfaces))))
    line = line.select(*node, *(f"{a}{e}" for e in "01" for a in "xyz"), boundaries.alias("at"))
    means = ends.groupBy(*node, "zone").agg(F.avg("top").alias("mean_top"), F.avg("base").alias("mean_base"))
    own = ends.drop("x0", "y0", "x1", "y1").join(line, node).join(means, [*node, "zone"])
    throw = lambda z: F.lit(0.0) if faults == "level" else F.col(z) - F.col(f"mean_{z}")
    moved = own.select("i", "j", "n", "zone", "top", "base", (F.get("at", F.col("zone")) + throw("top")).alias("to_top"), (F.get("at", F.col("zone") + 1) + throw("base")).alias("to_base"), *(f"{a}{e}" for e in "01" for a in "xyz"))
    pick = lambda n: F.first(F.when(F.col("n") == n, F.struct(*(f"{a}{e}" for e in "01" for a in "xyz"))), True).alias(f"__l{n}")
    zone_of = lambda n: F.array(*(F.max(F.when((F.col("n") == n) & (F.col("zone") == z), F.struct("top", "base", "to_top", "to_base"))) for z in zones)).alias(f"__z{n}")
    columns = moved.groupBy("i", "j").agg(*(pick(n) for n in range(4)), *(zone_of(n) for n in range(4)))
    # boundaries never go up from one to the next
    for n in range(4):
        out, before = [], None
        for z in zones:
            o = F.get(f"__z{n}", F.lit(z))
            top = F.greatest(o["to_top"], before) if z else o["to_top"]
            before = F.greatest(o["to_base"], top)
            out.append(F.struct(o["top"].alias("top"), o["base"].alias("base"), top.alias("to_top"), before.alias("to_base")))
        columns = columns.withColumn(f"__m{n}", F.array(*out))
    own = cells.join(columns.drop(*(f"__z{n}" for n in range(4))), ["i", "j"], "left")
    number = reduce(lambda a, b: a + b, (F.when(F.col("k") > sum(layers[: z + 1]), 1).otherwise(0) for z in list(zones)[:-1]), F.lit(0))
    zs = {}
    for n in range(8):
        o = F.get(f"__m{n % 4}", number)
        thick = o["base"] - o["top"]
        share = F.when(F.abs(thick) < 1e-6, 0.0 if n < 4 else F.when(F.col("k") == F.element_at(F.array(*(F.lit(sum(layers[: z + 1])) for z in zones)), number + 1), 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(f"c{n}z") - o["top"]) / thick)))
        zs[f"__c{n}"] = o["to_top"] + share * (o["to_base"] - o["to_top"])
    own = own.withColumns(zs)
    over = Window.partitionBy("i", "j").orderBy("k")
    new = {}
    for c in range(4):
        until, line_ = F.max(f"__c{c + 4}").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.col(f"__l{c}")
        top = F.greatest(F.col(f"__c{c}"), F.coalesce(until, F.col(f"__c{c}")))
        for n, z in ((c, top), (c + 4, F.greatest(top, F.col(f"__c{c + 4}")))):
            t = (z - line_["z0"]) / (line_["z1"] - line_["z0"])
            new |= {f"c{n}z": F.coalesce(z, F.col(f"c{n}z"))} | {f"c{n}{a}": F.coalesce(line_[f"{a}0"] + t * (line_[f"{a}1"] - line_[f"{a}0"]), F.col(f"c{n}{a}")) for a in "xy"}
    return own.withColumns(new).select(*cells.columns)


def box_index(points: DataFrame, dimension: tuple[int, int, int], origin: tuple[float, float, float], increment: tuple[float, float, float], rotation: float = 0.0) -> DataFrame:
    """Adds (i, j, k) of the box-grid cell that a point is in, null outside: by arithmetic, without a join."""
    c, s = math.cos(math.radians(rotation)), math.sin(math.radians(rotation))
    u, v = F.col("x") - origin[0], F.col("y") - origin[1]
    at = {"i": (u * c + v * s) / increment[0], "j": (v * c - u * s) / increment[1], "k": (F.col("z") - origin[2]) / increment[2]}
    inside = reduce(lambda a, b: a & b, ((x >= 0) & (x <= n) for x, n in zip(at.values(), dimension, strict=True)))
    return points.withColumns({a: F.when(inside, F.least(F.floor(x), F.lit(n - 1)).cast("int") + 1) for (a, x), n in zip(at.items(), dimension, strict=True)})


def points_in_cells(points: DataFrame, cells: DataFrame, tile: float, pid: str = "pid", band: float | None = None) -> DataFrame:
    """Adds (i, j, k) of the active cell of any shape that a point is in (the least of several), null outside.

    Cells and points meet in tiles of the map, and bands of depth, that a cell's box touches, by the cells' boxes alone;
    the corners join where the box holds the point, for the six tetrahedra of the cell. band: the depth of a band; the
    cells' mean height where it is not given.
    """
    on = cells.where("actnum = 1")
    box = on.select(*IJK, *(f(*(F.col(f"c{n}{a}") for n in range(8))).alias(f"__{m}{a}") for a in "xyz" for m, f in (("lo", F.least), ("hi", F.greatest))))
    box = cut(box)  # else the explodes' conditions on the boxes go below the cells' own aggregates
    band = band or max(1e-9, float(box.agg(F.avg(F.col("__hiz") - F.col("__loz"))).first()[0] or 1.0))
    size = {"x": tile, "y": tile, "z": band}
    for a, n in size.items():
        box = box.withColumn(f"__t{a}", F.explode(F.sequence(F.floor(F.col(f"__lo{a}") / n).cast("long"), F.floor(F.col(f"__hi{a}") / n).cast("long"))))
    own = points.select(F.col(pid).alias("__pid"), *(F.col(a).alias(f"__{a}") for a in "xyz"), *(F.floor(F.col(a) / n).cast("long").alias(f"__t{a}") for a, n in size.items()))
    boxed = reduce(lambda p, q: p & q, (F.col(f"__{a}").between(F.col(f"__lo{a}"), F.col(f"__hi{a}")) for a in "xyz"))
    met = own.join(box, [f"__t{a}" for a in "xyz"]).where(boxed).select("__pid", "__x", "__y", "__z", *IJK)
    # the tetrahedra are rows of an array, so that the test is compiled once
    every = F.array(*(F.struct(*(F.struct(*(F.col(f"c{n}{a}").alias(a) for a in "xyz")).alias(v) for n, v in zip(t, "abcd", strict=True))) for t in g.AROUND))
    p = F.col("__x"), F.col("__y"), F.col("__z")
    inside = F.exists(every, lambda t: g.in_tetrahedron(p, *((t[v]["x"], t[v]["y"], t[v]["z"]) for v in "abcd")))
    hits = met.join(on.select(*IJK, *CORNERS), IJK).where(inside).groupBy("__pid").agg(F.min(F.struct(*IJK)).alias("__c"))
    return points.join(hits.select(F.col("__pid").alias(pid), "__c.*"), pid, "left")


def _passed(u: Column, v: Column):
    return lambda k: (k - u) / (v - u)


def trajectory_cells(samples: DataFrame, dimension: tuple[int, int, int], origin: tuple[float, float, float], increment: tuple[float, float, float], md: str = "md") -> DataFrame:
    """Per well and cell of an unrotated box grid that its trajectory passes: entry and exit md, and the length between, in the order of the path.

    Each segment is cut where it crosses the planes between cells; a piece belongs to the cell that its middle is in, and
    neighbouring pieces in one cell make one row.
    """
    from terraspan.operators.wells import segments

    seg = segments(samples, md)
    cuts = [F.array(F.lit(0.0), F.lit(1.0))]
    for a, n, o, d in zip("xyz", dimension, origin, increment, strict=True):
        u, v = (F.col(f"{a}1") - o) / d, (F.col(f"{a}2") - o) / d
        first, last = F.greatest(F.lit(0), F.ceil(F.least(u, v))).cast("int"), F.least(F.lit(n), F.floor(F.greatest(u, v))).cast("int")
        planes = F.when((u != v) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        cuts.append(F.transform(planes, _passed(u, v)))
    t = F.array_sort(F.array_distinct(F.concat(*cuts)))
    pieces = seg.withColumn("__t", t).withColumn("__s", F.explode(F.transform(F.slice("__t", 1, F.size("__t") - 1), lambda a, n: F.struct(a.alias("a"), F.get("__t", n + 1).alias("b")))))
    at = lambda c, s: F.col(f"{c}1") + s * (F.col(f"{c}2") - F.col(f"{c}1"))
    a, b = F.col("__s.a"), F.col("__s.b")
    own = pieces.where(b - a > 1e-12).select("well", "seq", a.alias("__a"), at("md", a).alias("md_in"), at("md", b).alias("md_out"), *(at(c, (a + b) / 2).alias(c) for c in "xyz"))
    own = box_index(own, dimension, origin, increment).where(F.col("i").isNotNull())
    return visits(own)


def visits(pieces: DataFrame) -> DataFrame:
    """(well, visit, i, j, k, md_in, md_out, length_md): pieces of paths (well, seq, __a, i, j, k, md_in, md_out) that follow each other in one cell, as one."""
    own, w = pieces, Window.partitionBy("well").orderBy("seq", "__a")
    same = reduce(lambda p, q: p & q, (F.col(c) == F.lag(c).over(w) for c in IJK)) & (F.abs(F.col("md_in") - F.lag("md_out").over(w)) < 1e-9)
    own = own.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("visit", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return own.groupBy("well", "visit", *IJK).agg(F.min("md_in").alias("md_in"), F.max("md_out").alias("md_out")).withColumn("length_md", F.col("md_out") - F.col("md_in"))


def trajectory_in_cells(samples: DataFrame, cells: DataFrame, tile: float, md: str = "md", band: float | None = None, broadcast: int = 100_000) -> DataFrame:
    """trajectory_cells() for active cells of any shape: per well and cell that its trajectory passes, entry and exit md, and the length between, in the order of the path.

    Segments and cells meet by their boxes, in tiles of the map and bands of depth; each pair once, and only if the segment
    itself passes the cell's box. A segment is then cut to each of the cell's six tetrahedra, by numpy in Arrow batches.
    Up to so many cells, which are counted first, are broadcast, so that segments aren't moved for that.
    """
    from terraspan.operators.wells import segments

    on = cells.where("actnum = 1").select(*IJK, *CORNERS)
    box = cut(on.withColumns({f"__c{m}{a}": f(*(F.col(f"c{n}{a}") for n in range(8))) for a in "xyz" for m, f in (("lo", F.least), ("hi", F.greatest))}))
    known = box.agg(F.count(F.lit(1)), F.avg(F.col("__chiz") - F.col("__cloz"))).first()
    band = band or max(1e-9, float(known[1] or 1.0))
    seg = segments(samples, md)
    ends = seg.withColumns({f"__{m}{a}": f(f"{a}1", f"{a}2") for a in "xyz" for m, f in (("lo", F.least), ("hi", F.greatest))})
    at = lambda c, n: F.floor(F.col(c) / n).cast("long")
    for a, n in (("x", tile), ("y", tile), ("z", band)):
        span = lambda m, a=a, n=n: F.explode(F.sequence(at(f"__{m}lo{a}", n), at(f"__{m}hi{a}", n)))
        box, ends = box.withColumn(f"__t{a}", span("c")), ends.withColumn(f"__t{a}", span(""))
    met = ends.join(F.broadcast(box) if known[0] <= broadcast else box, ["__tx", "__ty", "__tz"])
    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    for a, n in (("x", tile), ("y", tile), ("z", band)):
        met = met.where((F.col(f"__lo{a}") <= F.col(f"__chi{a}")) & (F.col(f"__clo{a}") <= F.col(f"__hi{a}")) & (F.col(f"__t{a}") == F.greatest(at(f"__lo{a}", n), at(f"__clo{a}", n))))
        step = F.nullif(F.col(f"{a}2") - F.col(f"{a}1"), F.lit(0.0))
        one, two = ((F.col(f"__c{m}{a}") - F.col(f"{a}1")) / step for m in ("lo", "hi"))
        enter.append(F.least(one, two))
        leave.append(F.greatest(one, two))
    # nulls, of axes that a segment doesn't move along, are passed over; the rest is for rounding
    met = met.where(F.greatest(*enter) <= F.least(*leave) + 1e-9)
    pairs = met.select("well", "seq", *(f"{a}{e}" for a in ("x", "y", "z", "md") for e in "12"), *IJK, *CORNERS)
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return visits(pairs.mapInArrow(_cut_to_tetrahedra, ", ".join([*(f"{c} {kinds[c]}" for c in ("well", "seq", *IJK)), "__a double, md_in double, md_out double"])))


def _cut_to_tetrahedra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of a segment and a cell, the pieces within its tetrahedra: shares of the corners are linear along it, and inside none is negative."""
    for batch in batches:
        col = lambda c, batch=batch: batch.column(c).to_numpy(zero_copy_only=False)
        p, q = (tuple(col(f"{a}{e}") for a in "xyz") for e in "12")
        md1, md2 = col("md1"), col("md2")
        cell = [tuple(col(f"c{n}{a}") for a in "xyz") for n in range(8)]
        rows, first, last = [], [], []
        with np.errstate(all="ignore"):
            for t in g.AROUND:
                v = [cell[n] for n in t]
                whole = g.tetrahedron(*v)
                share = lambda o, v=v, whole=whole: [g.tetrahedron(*(o if m == n else c for m, c in enumerate(v))) / whole for n in range(4)]
                low, high = np.zeros(len(whole)), np.ones(len(whole))
                for a, b in zip(share(p), share(q), strict=True):
                    low = np.maximum(low, np.where((a == b) & (a < 0), 2.0, np.where(b > a, -a / (b - a), 0.0)))  # 2: along a face, outside of it
                    high = np.minimum(high, np.where(b < a, a / (a - b), 1.0))
                hit = np.flatnonzero((whole != 0) & (high - low > 1e-12))
                rows.append(hit), first.append(low[hit]), last.append(high[hit])
        at, a, b = (np.concatenate(x) for x in (rows, first, last))
        depth = lambda s, at=at, md1=md1, md2=md2: pa.array(md1[at] + s * (md2[at] - md1[at]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in ("well", "seq", *IJK)), pa.array(a), depth(a), depth(b)], ["well", "seq", *IJK, "__a", "md_in", "md_out"])


#: Of a cell and the next one in i or j, the corners on the two pillars between them: the first one's top and base, the next one's top and base.
FACES = {"i": ((1, 2), (5, 6), (0, 3), (4, 7)), "j": ((3, 2), (7, 6), (0, 1), (4, 5))}


def shared_height(*edges: tuple[Column, Column]) -> Column:
    """The mean height that two faces between the same two pillars share, exact for slanted edges: top and base of one, then of the other, each at both pillars.

    Edges are lines between the pillars, so the height is linear between the places where two of them cross.
    """
    ta, ba, tb, bb = edges
    at = lambda line, w: line[0] + w * (line[1] - line[0])
    height = lambda w: F.greatest(F.lit(0.0), F.least(at(ba, w), at(bb, w)) - F.greatest(at(ta, w), at(tb, w)))
    crossing = lambda p, q: F.try_divide(q[0] - p[0], (p[1] - p[0]) - (q[1] - q[0]))
    every = F.array(F.lit(0.0), F.lit(1.0), *(crossing(p, q) for p, q in ((ta, tb), (ba, bb), (ta, bb), (tb, ba), (ta, ba), (tb, bb))))

    def mean_height(cuts: Column) -> Column:
        part = lambda w, n: F.coalesce((F.get(cuts, n + 1) - w) * (height(w) + height(F.get(cuts, n + 1))) / 2, F.lit(0.0))
        return F.aggregate(F.transform(cuts, part), F.lit(0.0), lambda s, x: s + x)

    return let(F.array_sort(F.filter(every, lambda w: (w >= 0) & (w <= 1))), mean_height)


def transmissibilities(cells: DataFrame, perm: Sequence[str] = ("permx", "permy", "permz"), ntg: str | float = 1.0, min_dz: float = 1e-4, units: str = "metric") -> DataFrame:
    """(i, j, k, tranx, trany, tranz) of active cells: two-point flux to the next cell in each direction; 0 to an inactive one.

    T = h1 h2 / (h1 + h2) with h = k A / d, where A is the area that the two faces share and d the way from the centre
    to the face. k is perm times ntg in i and j. Thin cells (under min_dz) are closed in k. Shared areas are those of the
    faces between the two pillars, whatever the slant of their edges and the throw of a fault.
    """
    net = F.col(ntg) if isinstance(ntg, str) else F.lit(float(ntg))
    own = cells.where("actnum = 1").select(*IJK, *(F.col(p).alias(f"__k{a}") for a, p in zip(IJK, perm, strict=True)), net.alias("__ntg"), dx().alias("__di"), dy().alias("__dj"), dz().alias("__dk"), *(F.col(f"c{n}z") for n in range(8)))
    out, factor = own, DARCY[units]
    for axis in IJK:
        w = Window.partitionBy(*(c for c in IJK if c != axis)).orderBy(axis)
        nxt = lambda c, v=w: F.lead(c).over(v)
        next_to = nxt(axis) == F.col(axis) + 1
        if axis == "k":
            area = F.col("__di") * F.col("__dj")
            open_, ka, kb = (F.col("__dk") >= min_dz) & (nxt("__dk") >= min_dz), F.col("__kk"), nxt("__kk")
        else:
            across = "__dj" if axis == "i" else "__di"
            face = [tuple((F.col if n < 2 else nxt)(f"c{k}z") for k in ends) for n, ends in enumerate(FACES[axis])]
            overlap = shared_height(*face)
            area, open_ = (F.col(across) + nxt(across)) / 2 * overlap, F.lit(True)
            ka, kb = F.col(f"__k{axis}") * F.col("__ntg"), nxt(f"__k{axis}") * nxt("__ntg")
        h1, h2 = F.try_divide(ka * area, F.col(f"__d{axis}") / 2), F.try_divide(kb * area, nxt(f"__d{axis}") / 2)
        t = F.coalesce(F.try_divide(h1 * h2, h1 + h2), F.lit(0.0)) * factor
        out = out.withColumn({"i": "tranx", "j": "trany", "k": "tranz"}[axis], F.when(F.coalesce(next_to & open_, F.lit(False)), t).otherwise(0.0))
    return out.select(*IJK, "tranx", "trany", "tranz")


def pinchout_connections(cells: DataFrame, permz: str = "permz", min_dz: float = 1e-4, units: str = "metric") -> DataFrame:
    """(i, j, k1, k2, tran): from an active cell to the next one below it that is open, where closed cells lie between."""
    w = Window.partitionBy("i", "j").orderBy("k")
    open_ = cells.withColumns({"__dz": dz(), "__area": dx() * dy()}).where((F.col("actnum") == 1) & (F.col("__dz") >= min_dz))
    own = open_.withColumns({"k2": F.lead("k").over(w), "__dz2": F.lead("__dz").over(w), "__k2": F.lead(permz).over(w)}).where("k2 > k + 1")
    h1, h2 = F.col(permz) * F.col("__area") / (F.col("__dz") / 2), F.col("__k2") * F.col("__area") / (F.col("__dz2") / 2)
    return own.select("i", "j", F.col("k").alias("k1"), "k2", (F.coalesce(F.try_divide(h1 * h2, h1 + h2), F.lit(0.0)) * DARCY[units]).alias("tran"))


def fault_connections(cells: DataFrame, perm: Sequence[str] = ("permx", "permy"), units: str = "metric") -> DataFrame:
    """(axis, i, j, k1, k2, tran): cells of different layers in neighbouring columns whose faces share an area.

    Faces of neighbouring columns meet where their depths overlap (intervals.overlapping), so the pairs that are looked at
    grow with those that touch, not with the square of the layers.
    """
    own = cells.where("actnum = 1").select(*IJK, *(F.col(p).alias(f"__k{a}") for a, p in zip("ij", perm, strict=True)), dx().alias("__di"), dy().alias("__dj"), *(F.col(f"c{n}z") for n in range(8)))
    outs = []
    for axis, across in (("i", "__dj"), ("j", "__di")):
        faces = [tuple(F.col(f"c{k}z") for k in ends) for ends in FACES[axis]]
        span = lambda top, base: {"lo": F.least(*top), "hi": F.greatest(*base)}
        needed = lambda f: [f"__k{axis}", f"__d{axis}", across, *(f"c{k}z" for ends in f for k in ends)]  # noqa: E731, B023
        first = own.withColumns(span(*faces[:2])).select(*IJK, "lo", "hi", *needed(FACES[axis][:2]))
        second = own.withColumns(span(*faces[2:])).select((F.col("i") - int(axis == "i")).alias("i"), (F.col("j") - int(axis == "j")).alias("j"), F.col("k").alias("ok"), "lo", "hi", *(F.col(c).alias(f"o{c}") for c in needed(FACES[axis][2:])))
        face = [tuple(F.col(f"{'' if n < 2 else 'o'}c{k}z") for k in ends) for n, ends in enumerate(FACES[axis])]
        pairs = overlapping(first, second, ["i", "j"]).where(F.col("k") != F.col("ok")).withColumn("__h", shared_height(*face)).where("__h > 1e-9")
        area = (F.col(across) + F.col(f"o{across}")) / 2 * F.col("__h")
        h1, h2 = F.col(f"__k{axis}") * area / (F.col(f"__d{axis}") / 2), F.col(f"o__k{axis}") * area / (F.col(f"o__d{axis}") / 2)
        outs.append(pairs.select(F.lit(axis).alias("axis"), "i", "j", F.col("k").alias("k1"), F.col("ok").alias("k2"), (F.coalesce(F.try_divide(h1 * h2, h1 + h2), F.lit(0.0)) * DARCY[units]).alias("tran")))
    return outs[0].unionByName(outs[1])


# --- properties -----------------------------------------------------------------------------------------------------


def average_map(cells: DataFrame, prop: str, zones: tuple[int, int] | None = None, zone: str = "zone", truncate_le: float | None = None) -> DataFrame:
    """(i, j, value): the mean of a property over a column's active cells, weighted by thickness; values at or under truncate_le are left out."""
    own = cells.where("actnum = 1").where(F.col(zone).between(*zones)) if zones else cells.where("actnum = 1")
    if truncate_le is not None:
        own = own.where(F.col(prop) > truncate_le)
    return own.withColumn("__dz", dz()).groupBy("i", "j").agg(F.try_divide(F.sum(F.col(prop) * F.col("__dz")), F.sum("__dz")).alias("value"))


def thickness_map(cells: DataFrame, prop: str, zones: tuple[int, int] | None = None, zone: str = "zone") -> DataFrame:
    """(i, j, value): the sum over a column's active cells of a property that is a thickness."""
    own = cells.where("actnum = 1").where(F.col(zone).between(*zones)) if zones else cells.where("actnum = 1")
    return own.groupBy("i", "j").agg(F.sum(prop).alias("value"))


def to_discrete(value: Column) -> Column:
    """Rounded half to even; null for what is undefined or doesn't fit an int."""
    r = F.rint(value.cast("double"))
    return F.when(F.abs(r) < 2147483647, r.cast("int"))


def mask_undefined(value: Column, discrete: bool = False) -> Column:
    return F.when(value > 1999999999, None).otherwise(value) if discrete else F.when((value > 9.9e32) | F.isnan(value), None).otherwise(value)


def describe(cells: DataFrame, prop: str) -> DataFrame:
    return cells.where("actnum = 1").agg(F.count(prop).alias("n"), F.min(prop).alias("min"), F.avg(prop).alias("mean"), F.max(prop).alias("max"), F.stddev_pop(prop).alias("std"))
