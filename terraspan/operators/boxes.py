"""Algebra of bounding boxes: columns of a struct with minx, maxx, miny, maxy, minz, maxz. Bounds belong to the box."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = "xyz"


def box(*bounds: Column) -> Column:
    names = [f"{m}{a}" for a in AXES for m in ("min", "max")]
    return F.struct(*(b.alias(n) for b, n in zip(bounds, names, strict=True)))


def _all(parts) -> Column:
    return reduce(lambda p, q: p & q, parts)


def is_valid(a: Column) -> Column:
    return _all(a[f"min{x}"] <= a[f"max{x}"] for x in AXES)


def contains_point(a: Column, x: Column, y: Column, z: Column) -> Column:
    return _all(v.between(a[f"min{c}"], a[f"max{c}"]) for v, c in zip((x, y, z), AXES, strict=True))


def contains(a: Column, b: Column) -> Column:
    return _all((a[f"min{x}"] <= b[f"min{x}"]) & (b[f"max{x}"] <= a[f"max{x}"]) for x in AXES)


def intersects(a: Column, b: Column) -> Column:
    return _all((a[f"min{x}"] <= b[f"max{x}"]) & (b[f"min{x}"] <= a[f"max{x}"]) for x in AXES)


def intersection(a: Column, b: Column) -> Column:
    """Null if the boxes don't meet."""
    return F.when(intersects(a, b), box(*(f(a[f"{m}{x}"], b[f"{m}{x}"]) for x in AXES for m, f in (("min", F.greatest), ("max", F.least)))))


def union(a: Column, b: Column) -> Column:
    """The least box around both."""
    return box(*(f(a[f"{m}{x}"], b[f"{m}{x}"]) for x in AXES for m, f in (("min", F.least), ("max", F.greatest))))


def volume(a: Column) -> Column:
    return reduce(lambda p, q: p * q, (a[f"max{x}"] - a[f"min{x}"] for x in AXES))
