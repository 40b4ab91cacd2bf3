"""Column algebra of maps, trajectories and cells. All of it stays inside the JVM's generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraspan.functions.lambdas import let


def number(x: Column | float | str) -> Column:
    """A column as it is; a name as its column; a number as a double."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded, and without negative zero, so that results compare by value."""
    return F.round(number(x), digits) + F.lit(0.0)


@dataclass(frozen=True)
class MapHeader:
    """The geometry of a map: nodes (i, j) from 1; rotation in degrees counter-clockwise from east; yflip is 1 or -1."""

    ncol: int
    nrow: int
    xori: float = 0.0
    yori: float = 0.0
    xinc: float = 1.0
    yinc: float = 1.0
    rotation: float = 0.0
    yflip: int = 1

    @property
    def cos(self) -> float:
        return math.cos(math.radians(self.rotation))

    @property
    def sin(self) -> float:
        return math.sin(math.radians(self.rotation))

    def x(self, i: Column, j: Column) -> Column:
        return F.lit(self.xori) + (i - 1) * (self.xinc * self.cos) - (j - 1) * (self.yflip * self.yinc * self.sin)

    def y(self, i: Column, j: Column) -> Column:
        return F.lit(self.yori) + (i - 1) * (self.xinc * self.sin) + (j - 1) * (self.yflip * self.yinc * self.cos)

    def at(self, i: float, j: float) -> tuple[float, float]:
        """The place of a node, in numbers."""
        return (
            self.xori + (i - 1) * self.xinc * self.cos - (j - 1) * self.yflip * self.yinc * self.sin,
            self.yori + (i - 1) * self.xinc * self.sin + (j - 1) * self.yflip * self.yinc * self.cos,
        )

    def fi(self, x: Column, y: Column) -> Column:
        """The fractional column (from 0) of a place."""
        return ((x - self.xori) * self.cos + (y - self.yori) * self.sin) / self.xinc

    def fj(self, x: Column, y: Column) -> Column:
        return ((y - self.yori) * self.cos - (x - self.xori) * self.sin) * self.yflip / self.yinc

    def corners(self) -> list[tuple[float, float]]:
        """The outer corners: first, end of the first row, end of the first column, last."""
        return [self.at(i, j) for i, j in ((1, 1), (self.ncol, 1), (1, self.nrow), (self.ncol, self.nrow))]

    def moved(self, dx: float, dy: float) -> MapHeader:
        return replace(self, xori=self.xori + dx, yori=self.yori + dy)


def segment_length(*ends: tuple[Column, Column]) -> Column:
    """Of a segment, from its ends in each dimension."""
    return F.sqrt(reduce(lambda a, b: a + b, ((b - a) * (b - a) for a, b in ends)))


def azimuth(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, 0 to 360; 0 for no length."""
    return F.when((dx == 0) & (dy == 0), 0.0).when(F.abs(dx) <= 1e-5, F.when(dy < 0, 180.0).otherwise(0.0)).otherwise(F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0)))


def inclination(dx: Column, dy: Column, dz: Column) -> Column:
    """Degrees from straight down; 90 for level segments."""
    return F.when(F.abs(dz) > 1e-5, F.degrees(F.atan2(F.sqrt(dx * dx + dy * dy), dz))).otherwise(90.0)


def mean_angle(*angles: Column) -> Column:
    """The circular mean in degrees, 0 to 360."""
    n = len(angles)
    s = reduce(lambda a, b: a + b, (F.sin(F.radians(a)) for a in angles)) / n
    c = reduce(lambda a, b: a + b, (F.cos(F.radians(a)) for a in angles)) / n
    return F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0))


def angle_to_azimuth(angle: Column, radians: bool = False) -> Column:
    """School angle to azimuth, and back: it is its own inverse."""
    quarter, full = (math.pi / 2, 2 * math.pi) if radians else (90.0, 360.0)
    return F.pmod(F.lit(quarter) - angle, F.lit(full))


def angle_difference(a: Column, b: Column) -> Column:
    """The smallest signed difference a - b in degrees."""
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def linear_index(i: Column, j: Column, k: Column, nx: int, ny: int, base: int = 0) -> Column:
    """The place of cell (i, j, k), all from 1, where i runs fastest."""
    return ((k - 1) * (nx * ny) + (j - 1) * nx + (i - 1) + base).cast("long")


def cell_index(ib: Column, nx: int, ny: int, base: int = 0) -> tuple[Column, Column, Column]:
    """The inverse of linear_index()."""
    n = ib - base
    k = F.floor(n / (nx * ny))
    rest = n - k * (nx * ny)
    j = F.floor(rest / nx)
    return (rest - j * nx + 1).cast("int"), (j + 1).cast("int"), (k + 1).cast("int")


Point = tuple[Column, Column, Column]


def minus(a: Point, b: Point) -> Point:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def cross(a: Point, b: Point) -> Point:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def tetrahedron(a: Point, b: Point, c: Point, d: Point) -> Column:
    """The signed volume."""
    return dot(minus(a, d), cross(minus(b, d), minus(c, d))) / 6.0


def angle_between(a: Point, b: Point) -> Column:
    """Degrees, 0 to 180."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b))))))


#: A hexahedron's six tetrahedra around one of its diagonals; corners are 0-3 above and 4-7 below, around the cell.
AROUND = ((0, 1, 2, 6), (0, 2, 3, 6), (0, 3, 7, 6), (0, 7, 4, 6), (0, 4, 5, 6), (0, 5, 1, 6))


def hexahedron(corners: Sequence[Point], precision: int = 2) -> Column:
    """The volume of a cell, as the mean over 1, 2 or 4 diagonals. Corners: 4 around the top, then those below them."""
    if precision not in (1, 2, 4):
        raise ValueError("precision is 1, 2 or 4")
    volumes = []
    for turn in ((0,), (0, 1), None, (0, 1, 2, 3))[precision - 1]:
        own = [corners[(n + turn) % 4 + 4 * (n // 4)] for n in range(8)]
        volumes.append(F.abs(reduce(lambda a, b: a + b, (tetrahedron(*(own[k] for k in t)) for t in AROUND))))
    return reduce(lambda a, b: a + b, volumes) / len(volumes)


def in_tetrahedron(p: Point, a: Point, b: Point, c: Point, d: Point) -> Column:
    """Is p inside or on the surface? All four parts then have the sign of the whole."""
    whole = tetrahedron(a, b, c, d)
    parts = [tetrahedron(p, b, c, d), tetrahedron(a, p, c, d), tetrahedron(a, b, p, d), tetrahedron(a, b, c, p)]
    return reduce(lambda x, y: x & y, (v * whole >= 0 for v in parts)) & (whole != 0)


def plane_point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def polygon_area(polygon: Column) -> Column:
    """The signed area of an array of plane_point()s: positive if they go counter-clockwise; 0 for fewer than three."""
    after = lambda n: F.get(polygon, (n + 1) % F.size(polygon))
    return F.aggregate(F.transform(polygon, lambda p, n: (p["x"] * after(n)["y"] - after(n)["x"] * p["y"]) / 2), F.lit(0.0), lambda s, a: s + a)


def _left_of(a: Column, b: Column):
    """Of the points of a polygon, those on the left of the line from a to b, and where its sides cross that line."""
    left = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
    none = F.array().cast("array<struct<x:double,y:double>>")

    def kept(points: Column) -> Column:
        def part(p: Column, n: Column) -> Column:
            """What the side from the point before to this one adds."""
            q = F.get(points, (n + F.size(points) - 1) % F.size(points))
            t = left(q) / (left(q) - left(p))
            edge = plane_point(q["x"] + t * (p["x"] - q["x"]), q["y"] + t * (p["y"] - q["y"]))
            return F.when(left(p) >= 0, F.when(left(q) >= 0, F.array(p)).otherwise(F.array(edge, p))).when(left(q) >= 0, F.array(edge)).otherwise(none)

        return F.flatten(F.transform(points, part))

    return kept


def polygon_overlap(polygon: Column, ring: Sequence[Column]) -> Column:
    """What a convex ring of plane_point()s, counter-clockwise, has of a polygon: the polygon cut at one edge after the other."""
    for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
        polygon = let(polygon, _left_of(a, b))
    return polygon


def bilinear(z1: Column, z2: Column, z3: Column, z4: Column, a: Column, b: Column) -> Column:
    """From the corners (0, 0), (1, 0), (0, 1), (1, 1); null if one of them is."""
    return z1 + a * (z2 - z1) + b * (z3 - z1) + a * b * (z4 + z1 - z3 - z2)


def short_well_name(name: Column) -> Column:
    """'31/2-G-5 AH' is 'G-5AH': what follows the first '-' after '/' or '_', without blanks."""
    own = F.regexp_extract(name, "^[^/_]*[/_][^-]*-(.*)$", 1)
    return F.replace(F.when(own != "", own).otherwise(name), F.lit(" "), F.lit(""))


def safe_well_name(name: Column) -> Column:
    return F.translate(name, "/ ", "__")


def to_date(value: Column) -> Column:
    """A date of YYYYMMDD numbers or texts, and of YYYY-MM-DD texts; null for others."""
    return F.try_to_date(F.replace(value.cast("string"), F.lit("-"), F.lit("")), "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(F.replace(value.cast("string"), F.lit("-"), F.lit("")), "yyyyMMdd")
