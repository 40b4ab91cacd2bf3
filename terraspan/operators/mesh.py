"""Triangulated surfaces: vertices(vid, x, y, z) and triangles(tid, v0, v1, v2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.functions import geometry as g


def with_corners(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Adds the places of the three vertices, by three equi-joins."""
    out = triangles
    for n in range(3):
        out = out.join(vertices.select(F.col("vid").alias(f"v{n}"), *(F.col(a).alias(f"{a}{n}") for a in "xyz")), f"v{n}")
    return out


def measures(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(tid, area, nx, ny, nz, cx, cy, cz): area, unit normal (zero for triangles without area) and centroid."""
    own = with_corners(triangles, vertices)
    p = [tuple(F.col(f"{a}{n}") for a in "xyz") for n in range(3)]
    n = g.cross(g.minus(p[1], p[0]), g.minus(p[2], p[0]))
    own = own.withColumns({"__n": F.array(*n), "__l": g.norm(n)})
    unit = [F.when(F.col("__l") > 0, F.get("__n", F.lit(k)) / F.col("__l")).otherwise(0.0).alias(f"n{a}") for k, a in enumerate("xyz")]
    return own.select("tid", (F.col("__l") / 2).alias("area"), *unit, *(((F.col(f"{a}0") + F.col(f"{a}1") + F.col(f"{a}2")) / 3).alias(f"c{a}") for a in "xyz"))


def summary(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: the total area, the mean of the vertices and their bounds."""
    area = measures(triangles, vertices).agg(F.sum("area").alias("area"), F.count(F.lit(1)).alias("n_triangles"))
    rest = vertices.agg(*(F.avg(a).alias(f"c{a}") for a in "xyz"), *(f(a).alias(f"{a}{n}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))), F.count(F.lit(1)).alias("n_vertices"))
    return area.join(F.broadcast(rest))  # a row each


def problems(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(problem, n): triangles with a vertex that isn't there or twice the same one, and vertices with a null or NaN coordinate."""
    corner = triangles.select("tid", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    missing = corner.join(vertices, "vid", "left_anti").select(F.lit("missing vertex").alias("problem"), F.col("tid").alias("__id")).distinct()
    twice = triangles.where("v0 = v1 or v1 = v2 or v0 = v2").select(F.lit("repeated vertex").alias("problem"), F.col("tid").alias("__id"))
    bad = vertices.where(" or ".join(f"{a} is null or isnan({a})" for a in "xyz")).select(F.lit("undefined coordinate").alias("problem"), F.col("vid").alias("__id"))
    return missing.unionByName(twice).unionByName(bad).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
