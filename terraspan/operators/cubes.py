"""Seismic cubes: traces(i, j, traceid, amp), one row a trace, samples in an array from the top.

Only what an operator asks of a trace leaves its array, so a cube is never exploded to rows of samples for an attribute.
traceid 2 marks a dead trace.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.functions.geometry import MapHeader
from terraspan.operators.rounds import cut

DEAD = 2


@dataclass(frozen=True)
class CubeHeader:
    """A map's geometry and nlay samples from zori at steps of zinc."""

    map: MapHeader
    nlay: int
    zori: float = 0.0
    zinc: float = 1.0


def thin(traces: DataFrame, header: CubeHeader, icol: int = 1, jrow: int = 1, klay: int = 1) -> tuple[DataFrame, CubeHeader]:
    """Every icol-th column, jrow-th row and klay-th sample, from the first."""
    m = header.map
    if icol > m.ncol // 2 or jrow > m.nrow // 2 or klay > header.nlay // 2:
        raise ValueError("too few would be left")
    new = replace(header, map=replace(m, ncol=-(-m.ncol // icol), nrow=-(-m.nrow // jrow), xinc=m.xinc * icol, yinc=m.yinc * jrow), nlay=-(-header.nlay // klay), zinc=header.zinc * klay)
    own = traces.where(((F.col("i") - 1) % icol == 0) & ((F.col("j") - 1) % jrow == 0))
    kept = F.filter("amp", lambda _, k: k % klay == 0)
    return own.withColumns({"i": F.floor((F.col("i") - 1) / icol).cast("int") + 1, "j": F.floor((F.col("j") - 1) / jrow).cast("int") + 1, "amp": kept}), new


def crop(traces: DataFrame, header: CubeHeader, icols: tuple[int, int], jrows: tuple[int, int], klays: tuple[int, int]) -> tuple[DataFrame, CubeHeader]:
    """Cut so many columns, rows and samples from each end."""
    m = header.map
    x, y = m.at(1 + icols[0], 1 + jrows[0])
    new = replace(header, map=replace(m, ncol=m.ncol - sum(icols), nrow=m.nrow - sum(jrows), xori=x, yori=y), nlay=header.nlay - sum(klays), zori=header.zori + klays[0] * header.zinc)
    own = traces.where(F.col("i").between(icols[0] + 1, m.ncol - icols[1]) & F.col("j").between(jrows[0] + 1, m.nrow - jrows[1]))
    return own.withColumns({"i": F.col("i") - icols[0], "j": F.col("j") - jrows[0], "amp": F.slice("amp", klays[0] + 1, new.nlay)}), new


def swap_axes(traces: DataFrame, header: CubeHeader) -> tuple[DataFrame, CubeHeader]:
    m = header.map
    new = replace(header, map=MapHeader(m.nrow, m.ncol, m.xori, m.yori, m.yinc, m.xinc, (m.rotation + m.yflip * 90) % 360, -m.yflip))
    return traces.withColumns({"i": F.col("j"), "j": F.col("i")}), new


def fill_dead(traces: DataFrame, value: float) -> DataFrame:
    """Dead traces hold one value."""
    return traces.withColumn("amp", F.when(F.col("traceid") == DEAD, F.transform("amp", lambda _: F.lit(float(value)).cast("float"))).otherwise(F.col("amp")))


def dead_middle(traces: DataFrame) -> DataFrame:
    """One row: halfway between the least and the largest value of dead traces, null without any."""
    return traces.where(F.col("traceid") == DEAD).agg(((F.min(F.array_min("amp")) + F.max(F.array_max("amp"))) / 2).cast("double").alias("middle"))


def describe(traces: DataFrame) -> DataFrame:
    n, s = F.size("amp"), F.aggregate("amp", F.lit(0.0), lambda a, v: a + v)
    return traces.agg(F.count(F.lit(1)).alias("n_traces"), F.min(F.array_min("amp")).cast("double").alias("min"), F.max(F.array_max("amp")).cast("double").alias("max"), (F.sum(s) / F.sum(n)).alias("mean"))


def on_trace(z: Column, header: CubeHeader, method: str = "nearest", amp: str = "amp") -> Column:
    """Whether a trace has the depth's nearest sample, or (linear) one at or above and the next one."""
    k = (z - header.zori) / header.zinc
    return F.rint(k).between(0, F.size(amp) - 1) if method == "nearest" else (k >= 0) & (F.floor(k) < F.size(amp) - 1)


def at_depth(z: Column, header: CubeHeader, method: str = "nearest", amp: str = "amp") -> Column:
    """A trace's value at a depth: the nearest sample's, or linear between two; null off the trace, which ends half a step beyond its outer samples (nearest) or at them."""
    k = (z - header.zori) / header.zinc
    if method == "nearest":
        return F.when(on_trace(z, header, method, amp), F.get(amp, F.rint(k).cast("int")).cast("double"))
    low = F.least(F.floor(k).cast("int"), F.size(amp) - 2)
    a, b = F.get(amp, low).cast("double"), F.get(amp, low + 1).cast("double")
    return F.when(k.between(0, F.size(amp) - 1), a + (k - low) * (b - a))


def slice_surface(traces: DataFrame, header: CubeHeader, nodes: DataFrame, method: str = "nearest", dead: bool = True, outside: bool = True) -> DataFrame:
    """(i, j, value): the amplitude along a map of the cube's geometry; null off the cube and (dead) in dead traces.

    Without outside, nodes off the cube are left out, and so are those that lack one of the two samples around them (linear).
    """
    own = nodes.where(F.col("value").isNotNull()).select("i", "j", F.col("value").alias("__z")).join(traces, ["i", "j"])
    if not outside:
        own = own.where(on_trace(F.col("__z"), header, method))
    value = at_depth(F.col("__z"), header, method)
    if dead:
        value = F.when(F.col("traceid") != DEAD, value)
    return own.select("i", "j", value.alias("value"))


def with_samples(places: DataFrame, traces: DataFrame, header: CubeHeader, method: str = "nearest", name: str = "sampled", outside: float | None = None) -> DataFrame:
    """Adds the cube's value at (x, y, z): the nearest sample's, trilinear, or by Catmull-Rom splines (4 samples each way); `outside` off the cube.

    Places go to the traces around them by an equi-join; of a trace only the value at the place's depth goes on. Equal
    places have equal values, so values come back to them by their fractional indices, however often rows are computed.
    """
    m = header.map
    fi, fj = m.fi(F.col("x"), F.col("y")), m.fj(F.col("x"), F.col("y"))
    edge = 0.5 if method == "nearest" else 1e-9  # so far outside the outer samples
    tops = {"__fi": m.ncol - 1, "__fj": m.nrow - 1, "__fk": header.nlay - 1}
    own = places.withColumns({"__fi": fi, "__fj": fj, "__fk": (F.col("z") - header.zori) / header.zinc})
    own = own.withColumn("__in", reduce(lambda p, q: p & q, (F.col(c).between(-edge, top + edge) for c, top in tops.items())))
    own = own.withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), F.col(c))) for c, top in tops.items()})
    inside = F.col("__in")
    low = {"nearest": 0, "trilinear": 0, "catmull_rom": -1}[method]
    n = {"nearest": 1, "trilinear": 2, "catmull_rom": 4}[method]
    blank = F.lit(outside).cast("double")
    if method == "nearest":
        own = own.withColumns({f"__{c[-1]}": F.rint(c).cast("int") for c in tops})
        near = traces.select((F.col("i") - 1).alias("__i"), (F.col("j") - 1).alias("__j"), "amp")
        found = own.join(near, ["__i", "__j"], "left")
        return found.withColumn(name, F.coalesce(F.when(inside, F.get("amp", "__k").cast("double")), blank)).drop("amp", "__i", "__j", "__k", "__fi", "__fj", "__fk", "__in")
    base = own.withColumns({f"__{c}": F.least(F.floor(F.col(f"__f{c}")), F.lit(top - 2)).cast("int") for c, top in (("i", m.ncol), ("j", m.nrow), ("k", header.nlay))})
    clamp = lambda c, top: F.greatest(F.lit(0), F.least(F.lit(top - 1), c))
    steps = F.explode(F.array(*(F.struct(F.lit(a + low).alias("a"), F.lit(b + low).alias("b")) for a in range(n) for b in range(n))))
    at = ["__fi", "__fj", "__fk"]
    spread = base.where(inside).select("__i", "__j", "__k", *at).distinct().select("*", steps.alias("s"))
    spread = spread.withColumns({"__ti": clamp(F.col("__i") + F.col("s.a"), m.ncol), "__tj": clamp(F.col("__j") + F.col("s.b"), m.nrow)})
    hit = spread.join(traces.select((F.col("i") - 1).alias("__ti"), (F.col("j") - 1).alias("__tj"), "amp"), ["__ti", "__tj"])
    weights = _linear if method == "trilinear" else _catmull_rom
    pick = lambda t, s: F.element_at(F.array(*weights(t)), s - low + 1)
    down = reduce(lambda p, q: p + q, (w * F.get("amp", clamp(F.col("__k") + (low + c), header.nlay)).cast("double") for c, w in enumerate(weights(F.col("__fk") - F.col("__k")))))
    part = hit.select(*at, (pick(F.col("__fi") - F.col("__i"), F.col("s.a")) * pick(F.col("__fj") - F.col("__j"), F.col("s.b")) * down).alias("v"))
    sums = part.groupBy(*at).agg(F.sum("v").alias("__v"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") == n * n)
    return base.join(sums, at, "left").withColumn(name, F.coalesce(F.when(inside, F.col("__v")), blank)).drop("__v", "__n", "__i", "__j", "__k", "__fi", "__fj", "__fk", "__in")


def _linear(t: Column) -> list[Column]:
    return [1 - t, t]


def _catmull_rom(t: Column) -> list[Column]:
    return [(-t + 2 * t * t - t * t * t) / 2, (2 - 5 * t * t + 3 * t * t * t) / 2, (t + 4 * t * t - 3 * t * t * t) / 2, (-t * t + t * t * t) / 2]


def resample(traces: DataFrame, header: CubeHeader, target: CubeHeader, method: str = "nearest", outside: float | None = None) -> DataFrame:
    """(i, j, k, value): the cube on another cube's samples."""
    from terraspan.operators.surfaces import lattice, with_xy

    places = with_xy(lattice(traces.sparkSession, target.map), target.map).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(target.nlay)))).withColumn("z", target.zori + (F.col("k") - 1) * target.zinc)
    return with_samples(places, traces, header, method, "value", outside).select("i", "j", "k", "value")


def random_line(fence: DataFrame, traces: DataFrame, header: CubeHeader, zmin: float, zmax: float, zinc: float, method: str = "nearest") -> DataFrame:
    """(poly_id, seq, h, z, value): a vertical section along a fence(poly_id, seq, x, y, h)."""
    n = int(round((zmax - zmin) / zinc))
    places = fence.select("poly_id", "seq", "h", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("__n")).withColumn("z", zmin + F.col("__n") * zinc)
    return with_samples(places, traces, header, method, "value").select("poly_id", "seq", "h", "z", "value")


ATTRIBUTES = ("min", "max", "mean", "var", "rms", "maxpos", "maxneg", "maxabs", "meanabs", "meanpos", "meanneg", "sumpos", "sumneg", "sumabs")
SUMS = ("sumpos", "sumneg", "sumabs")


def _attributes(values: Column) -> dict[str, Column]:
    """All attributes of an array of doubles, in one pass."""
    zero = F.lit(0.0)
    start = F.struct(F.lit(0).alias("n"), *(zero.alias(c) for c in ("s", "q", "sa", "sp", "sn")), F.lit(0).alias("np"), F.lit(0).alias("nn"))

    def step(a: Column, v: Column) -> Column:
        up = v >= 0
        return F.struct(
            (a["n"] + 1).alias("n"), (a["s"] + v).alias("s"), (a["q"] + v * v).alias("q"), (a["sa"] + F.abs(v)).alias("sa"), (a["sp"] + F.when(up, v).otherwise(0.0)).alias("sp"),
            (a["sn"] + F.when(up, 0.0).otherwise(v)).alias("sn"), (a["np"] + F.when(up, 1).otherwise(0)).alias("np"), (a["nn"] + F.when(up, 0).otherwise(1)).alias("nn"),
        )

    a = F.aggregate(values, start, step)
    return {"a": a, "lo": F.array_min(values), "hi": F.array_max(values)}


def curvatures(n: int) -> np.ndarray:
    """(n, n): what makes of n samples the second derivatives of the cubic spline through them, whose outer two pieces on each side are one cubic."""
    a, b = np.zeros((n, n)), np.zeros((n, n))
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2], b[k, k - 1 : k + 2] = (1, 4, 1), (6, -12, 6)
    a[0, :3] = a[-1, -3:] = (1, -2, 1)
    return np.linalg.solve(a, b)


def splined(amp: Column, low: int, high: int, ndiv: int) -> Column:
    """Samples low to high - 1 of each trace, ndiv times as dense on the cubic spline through them. Traces are taken in Arrow batches."""
    n = high - low
    bend = curvatures(n) if n > 2 else np.zeros((n, n))

    @F.pandas_udf("array<double>")
    def dense(own: pd.Series) -> pd.Series:
        y = np.stack(own.to_numpy())[:, low:high].astype(float)
        m = y @ bend.T
        t = np.arange(ndiv) / ndiv
        a, b, ma, mb = (x[:, :, None] for x in (y[:, :-1], y[:, 1:], m[:, :-1], m[:, 1:]))
        s = 1 - t
        between = s * a + t * b + ((s**3 - s) * ma + (t**3 - t) * mb) / 6
        return pd.Series(list(np.concatenate([between.reshape(len(y), -1), y[:, -1:]], axis=1)))

    return dense(amp)


def window_around(traces: DataFrame, header: CubeHeader, surface: DataFrame, zrange: float, ndiv: int = 10, method: str = "linear") -> DataFrame:
    """window_attributes() of the samples within a distance of one map."""
    moved = lambda d: surface.withColumn("value", F.col("value") + d)
    return window_attributes(traces, header, moved(-zrange), moved(zrange), ndiv, method=method)


def window_attributes(traces: DataFrame, header: CubeHeader, upper: DataFrame, lower: DataFrame, ndiv: int = 10, minimum_thickness: float = 0.0, method: str = "linear") -> DataFrame:
    """(i, j, 14 attributes) of the samples between two maps of the cube's geometry, both ends included.

    Samples are made ndiv times as dense by lines between them, or (method "cubic") by a cubic spline through those from
    two above the upper map's least depth to two below the lower map's largest; the three sums are over the cube's own samples. Zero counts
    as positive. A kind without samples has null, and so have dead traces and windows not thicker than the minimum.
    """
    maps = upper.select("i", "j", F.col("value").alias("__u")).join(lower.select("i", "j", F.col("value").alias("__l")), ["i", "j"])
    own = traces.where(F.col("traceid") != DEAD).join(maps, ["i", "j"]).where(F.col("__l") - F.col("__u") > minimum_thickness)
    low = 0
    if method == "cubic":
        top, base = maps.agg(F.min("__u"), F.max("__l")).first()
        ends = ((top or 0) - header.zori) / header.zinc - 2, ((base or 0) - header.zori) / header.zinc + 2
        low, high = max(0, math.ceil(ends[0] - 1e-9)), min(header.nlay, math.floor(ends[1] + 1e-9) + 1)
        own = own.withColumn("__dense", splined(F.col("amp"), low, high, ndiv) if high > low else F.array().cast("array<double>"))

    def within(n: int) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col("__u") - header.zori) / header.zinc * n - 1e-9).cast("int"))
        last = F.least(F.lit((header.nlay - 1) * n), F.floor((F.col("__l") - header.zori) / header.zinc * n + 1e-9).cast("int"))
        places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

        def value(p: Column) -> Column:
            if n > 1 and method == "cubic":
                return F.get("__dense", p - low * n)
            k = F.floor(p / n).cast("int")
            a = F.get("amp", k).cast("double")
            return a if n == 1 else a + (p % n) / float(n) * (F.coalesce(F.get("amp", k + 1).cast("double"), a) - a)

        return F.transform(places, value)

    own = own.withColumns({"__v": within(ndiv), "__w": within(1)})
    stats, sums = _attributes(F.col("__v")), _attributes(F.col("__w"))
    own = own.withColumns({"__a": stats["a"], "__b": sums["a"], "__lo": stats["lo"], "__hi": stats["hi"]})
    a, b, lo, hi = (F.col(c) for c in ("__a", "__b", "__lo", "__hi"))
    some = lambda n, v: F.when(n > 0, v)
    return own.select(
        "i", "j", lo.alias("min"), hi.alias("max"), some(a["n"], a["s"] / a["n"]).alias("mean"), some(a["n"], F.greatest(F.lit(0.0), a["q"] / a["n"] - (a["s"] / a["n"]) * (a["s"] / a["n"]))).alias("var"),
        some(a["n"], F.sqrt(a["q"] / a["n"])).alias("rms"), some(a["np"], hi).alias("maxpos"), some(a["nn"], lo).alias("maxneg"), some(a["n"], F.greatest(F.abs(lo), F.abs(hi))).alias("maxabs"), some(a["n"], a["sa"] / a["n"]).alias("meanabs"),
        some(a["np"], a["sp"] / a["np"]).alias("meanpos"), some(a["nn"], a["sn"] / a["nn"]).alias("meanneg"), some(b["np"], b["sp"]).alias("sumpos"), some(b["nn"], b["sn"]).alias("sumneg"), some(b["n"], b["sa"]).alias("sumabs"),
    )


def slice_map(traces: DataFrame, header: CubeHeader, nodes: DataFrame, geometry: MapHeader, method: str = "nearest", dead: bool = True, through: str = "nodes") -> DataFrame:
    """(i, j, value): the amplitude along a map of any geometry, on the map's own nodes; null off the cube and (dead) at dead traces.

    through="nodes": each node gets the cube's value at its place (nearest, trilinear or catmull_rom). "traces": the map is
    brought to the cube's traces, sliced there (nearest, or linear in depth), and the result brought back to the map's
    nodes, bilinear in both steps; nodes without four traces around them are left out. On a map with the cube's geometry
    both are slice_surface().
    """
    from terraspan.operators import surfaces

    if through == "traces":
        own = surfaces.resample(nodes.where(F.col("value").isNotNull()).select("i", "j", "value"), geometry, header.map)
        cut_ = slice_surface(traces, header, own, "nearest" if method == "nearest" else "linear", dead)
        return surfaces.resample(cut_.where(F.col("value").isNotNull()), header.map, geometry)
    if through != "nodes":
        raise ValueError("through is nodes or traces")
    places = surfaces.with_xy(nodes.where(F.col("value").isNotNull()).select("i", "j", F.col("value").alias("z")), geometry)
    live = traces.where(F.col("traceid") != DEAD) if dead else traces
    return with_samples(places, live, header, method, "value").select("i", "j", "value")


def window_map(traces: DataFrame, header: CubeHeader, surface: DataFrame, other: DataFrame | float, geometry: MapHeader, attributes: Sequence[str] = ("mean",), other_position: str = "below", ndiv: int = 10, minimum_thickness: float = 0.1, method: str = "linear") -> DataFrame:
    """(i, j, attributes): window_attributes() between two maps of any one geometry, on their nodes.

    other lies "below" or "above" the surface; a number is a distance to both sides of it. Maps are brought to the cube's
    traces, and each attribute back to the nodes, bilinear. Where the window isn't thicker than the minimum, there is none.
    """
    from terraspan.operators import surfaces

    if other_position not in ("below", "above"):
        raise ValueError("other_position is below or above")
    known = lambda m: m.where(F.col("value").isNotNull()).select("i", "j", "value")
    own = cut(surfaces.resample(known(surface), geometry, header.map))
    if isinstance(other, DataFrame):
        second = cut(surfaces.resample(known(other), geometry, header.map))
        upper, lower = (own, second) if other_position == "below" else (second, own)
    else:
        upper, lower = (own.withColumn("value", F.col("value") + d) for d in (-float(other), float(other)))
    found = cut(window_attributes(traces, header, upper, lower, ndiv, minimum_thickness, method).select("i", "j", *attributes))
    out = surfaces.lattice(traces.sparkSession, geometry)
    for a in attributes:
        back = surfaces.resample(found.select("i", "j", F.col(a).alias("value")).where(F.col("value").isNotNull()), header.map, geometry)
        out = out.join(back.withColumnRenamed("value", a), ["i", "j"], "left")
    return out.where(reduce(lambda p, q: p | q, (F.col(a).isNotNull() for a in attributes)))


def to_cells(cells: DataFrame, traces: DataFrame, header: CubeHeader, method: str = "nearest", outside: float = 0.0, name: str = "sampled_cube") -> DataFrame:
    """Adds the cube's value at each cell's centre (columns x, y, z)."""
    return with_samples(cells, traces, header, method, name, outside)


def trace_xy(traces: DataFrame, header: CubeHeader) -> DataFrame:
    return traces.withColumns({"x": header.map.x(F.col("i"), F.col("j")), "y": header.map.y(F.col("i"), F.col("j"))})

