"""Wells: samples in the order of `seq` along each trajectory.

Every function takes samples(well, seq, x, y, z, ...logs) of any number of wells and works on all of them in one query,
partitioned by well. A log without a value at a sample is null. Discrete logs are ints; their names are in a table
log_codes(log, code, name). Wells are short (thousands of samples), so a window never holds more than one well.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraspan.functions import geometry as g
from terraspan.operators.rounds import cut

KEY = ("well", "seq")
PROTECTED = ("well", "seq", "x", "y", "z")
#: What an undefined value is in files and filled tables.
UNDEF, UNDEF_INT = 1e33, 2000000000


def along() -> Window:
    return Window.partitionBy("well").orderBy("seq")


def until() -> Window:
    return along().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole() -> Window:
    return along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def step(name: str) -> Column:
    """The change from the sample before."""
    return F.col(name) - F.lag(name).over(along())


# --- trajectories ---------------------------------------------------------------------------------------------------


def geometrics(samples: DataFrame) -> DataFrame:
    """Adds Q_MDEPTH (length so far in 3D), Q_INCL and Q_AZI (circular means of the segments before and after, in degrees).

    The first and last sample have the angles of their neighbour; wells of fewer than three samples have null angles.
    """
    w = along()
    seg = samples.withColumns({"__dx": step("x"), "__dy": step("y"), "__dz": step("z")})
    dx, dy, dz = (F.col(c) for c in ("__dx", "__dy", "__dz"))
    seg = seg.withColumns({"__len": F.coalesce(F.sqrt(dx * dx + dy * dy + dz * dz), F.lit(0.0)), "__incl": g.inclination(dx, dy, dz), "__azi": g.azimuth(dx, dy)})
    both = lambda c: F.when(F.lag("seq").over(w).isNotNull() & F.lead("seq").over(w).isNotNull(), g.mean_angle(F.col(c), F.lead(c).over(w)))
    mid = seg.withColumns({"Q_MDEPTH": F.sum("__len").over(until()), "__i": both("__incl"), "__a": both("__azi")})
    near = lambda c: F.coalesce(F.col(c), F.lead(c).over(w), F.lag(c).over(w))
    return mid.withColumns({"Q_INCL": near("__i"), "Q_AZI": near("__a")}).drop("__dx", "__dy", "__dz", "__len", "__incl", "__azi", "__i", "__a")


def relative_hlen(samples: DataFrame, name: str = "R_HLEN") -> DataFrame:
    """Adds the horizontal length so far."""
    d = samples.withColumn("__d", F.coalesce(F.sqrt(step("x") * step("x") + step("y") * step("y")), F.lit(0.0)))
    return d.withColumn(name, F.sum("__d").over(until())).drop("__d")


def limit_tvd(samples: DataFrame, tvdmin: float, tvdmax: float) -> DataFrame:
    return samples.where(F.col("z").between(tvdmin, tvdmax))


def downsample(samples: DataFrame, interval: int = 4, keeplast: bool = True) -> DataFrame:
    """Every interval-th sample; with keeplast the last one is there too, as a second row if it was taken already.

    Wells whose table (samples by columns, seq left out) has under 2 * interval values stay as they are.
    """
    n = samples.withColumns({"__n": F.row_number().over(along()) - 1, "__of": F.count(F.lit(1)).over(Window.partitionBy("well"))})
    width = len(samples.columns) - 2  # well and seq aren't columns of the table
    small = F.col("__of") * width < 2 * interval
    times = F.when(small | (F.col("__n") % interval == 0), 1).otherwise(0)
    if keeplast:
        times = times + F.when(~small & (F.col("__n") == F.col("__of") - 1), 1).otherwise(0)
    return n.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__n", "__of", "__times", "__copy")


def rescale(samples: DataFrame, delta: float = 0.15, md: str = "md", discrete: Sequence[str] = ()) -> DataFrame:
    """Samples at regular md steps: n = round(length / delta) places, evenly from the first to the last md.

    Values between samples are linear in md, null if a side has none; discrete logs are rounded. seq counts from 1.
    """
    names = [c for c in samples.columns if c not in (*KEY, md)]
    ends = samples.groupBy("well").agg(F.min(md).alias("__a"), F.max(md).alias("__b"))
    n = F.rint((F.col("__b") - F.col("__a")) / delta).cast("int")
    places = ends.where(n > 0).select("well", "__a", "__b", n.alias("__n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("__k"))
    at = F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__k") / F.greatest(F.col("__n") - 1, F.lit(1))
    places = places.select("well", F.when((F.col("__k") == F.col("__n") - 1) & (F.col("__n") > 1), F.col("__b")).otherwise(at).alias(md), F.lit(1).alias("__new"))
    both = samples.select("well", md, *names).withColumn("__new", F.lit(0)).unionByName(places, allowMissingColumns=True)
    w = Window.partitionBy("well").orderBy(md, "__new")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)

    def at_place(c: str) -> Column:
        # undefined samples are skipped on either side, as interpolation over the index does
        known = F.when(F.col("__new") == 0, F.when(F.col(c).isNotNull(), F.struct(F.col(md).alias("m"), F.col(c).cast("double").alias("v"))))
        p, q = F.last(known, True).over(back), F.first(known, True).over(ahead)
        # at a sample itself, the row of the sample comes first
        value = F.when(p["m"] == F.col(md), p["v"]).when(q["m"] == F.col(md), q["v"]).otherwise(p["v"] + (q["v"] - p["v"]) * (F.col(md) - p["m"]) / (q["m"] - p["m"]))
        return (F.rint(value).cast("int") if c in discrete else value).alias(c)

    made = both.select("well", md, "__new", *(at_place(c) for c in names)).where("__new = 1").drop("__new")
    return made.withColumn("seq", F.row_number().over(Window.partitionBy("well").orderBy(md))).select(*samples.columns)


# --- logs -----------------------------------------------------------------------------------------------------------


def create_log(samples: DataFrame, name: str, value: float | int = 0.0, discrete: bool = False, force: bool = True) -> DataFrame:
    """A new log with one value; one that exists is replaced, or kept if force is False."""
    if name in PROTECTED:
        raise ValueError(f"{name} is protected")
    if name in samples.columns and not force:
        return samples
    return samples.withColumn(name, F.lit(int(value) if discrete else float(value)))


def copy_log(samples: DataFrame, name: str, new: str, force: bool = True) -> DataFrame:
    return samples if new in samples.columns and not force else samples.withColumn(new, F.col(name))


def rename_log(samples: DataFrame, name: str, new: str) -> DataFrame:
    if name in PROTECTED or new in samples.columns or name not in samples.columns:
        raise ValueError(f"can't rename {name} to {new}")
    return samples.withColumnRenamed(name, new)


def delete_logs(samples: DataFrame, names: Sequence[str], strict: bool = False) -> DataFrame:
    if any(n in PROTECTED for n in names) or strict and any(n not in samples.columns for n in names):
        raise ValueError(f"can't delete {names}")
    return samples.drop(*names)


def set_log_type(samples: DataFrame, name: str, discrete: bool) -> DataFrame:
    """Discrete logs hold ints (rounded half to even), continuous ones doubles."""
    c = F.col(name)
    return samples.withColumn(name, F.rint(c.cast("double")).cast("int") if discrete else c.cast("double"))


def log_catalog(samples: DataFrame) -> list[tuple[str, str]]:
    """(log, DISC or CONT) of each log."""
    return [(n, "DISC" if t in ("tinyint", "smallint", "int", "bigint") else "CONT") for n, t in samples.dtypes if n not in PROTECTED]


def filled(samples: DataFrame, value: float = UNDEF, value_int: int = UNDEF_INT) -> DataFrame:
    """Undefined values replaced by numbers, by the type of the log."""
    types = dict(samples.dtypes)
    numbers = {c: (value_int if types[c] in ("int", "bigint") else value) for c in samples.columns if types[c] in ("int", "bigint", "double", "float")}
    return samples.fillna(numbers)


def named(samples: DataFrame, codes: DataFrame, log: str, name: str) -> DataFrame:
    """Adds the code names of a discrete log; codes(log, code, name) has a row a code."""
    own = codes.where(F.col("log") == log).select(F.col("code").alias(log), F.col("name").alias(name))
    return samples.join(own, log, "left")


def stacked(tables: Sequence[DataFrame], missing: float = -999.0, no_log: float = -9999.0) -> DataFrame:
    """All wells in one table: well, x, y, z first, then all logs in order of name.

    A value that is undefined is `missing`, and one of a log that the well lacks `no_log`.
    """
    logs = sorted({c for t in tables for c in t.columns} - set(PROTECTED))
    own = [t.select(*PROTECTED, *(F.coalesce(F.col(c).cast("double"), F.lit(missing)).alias(c) if c in t.columns else F.lit(no_log).alias(c) for c in logs)) for t in tables]
    out = own[0]
    for t in own[1:]:
        out = out.unionByName(t)
    return out


def names_of(samples: DataFrame) -> DataFrame:
    """One row per well: its name, the safe name (no / and blanks) and the short name."""
    return samples.select("well").distinct().select("well", g.safe_well_name(F.col("well")).alias("safe_name"), g.short_well_name(F.col("well")).alias("short_name"))


def summary(samples: DataFrame, logs: Sequence[str]) -> DataFrame:
    """Per well: samples, bounds, and of each log its count, least, mean and largest value."""
    aggs = [F.count(F.lit(1)).alias("n_samples")]
    for c in ("x", "y", "z"):
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    for c in logs:
        aggs += [F.count(c).alias(f"{c}_n"), F.min(c).alias(f"{c}_min"), F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max")]
    return samples.groupBy("well").agg(*aggs)


# --- zones ----------------------------------------------------------------------------------------------------------


def runs(samples: DataFrame, log: str, run: str = "run") -> DataFrame:
    """Adds the number of the run of equal values (null equals null) that a sample is in, from 1 in each well."""
    new = (F.row_number().over(along()) == 1) | ~F.col(log).eqNullSafe(F.lag(log).over(along()))
    return samples.withColumn("__new", new.cast("int")).withColumn(run, F.sum("__new").over(until()).cast("int")).drop("__new")


def zone_interval(samples: DataFrame, zone: int, log: str = "zone", resample: int = 1) -> DataFrame:
    """Samples of a zone, with POLY_ID: the number of changes into and out of the zone so far, so each run has its own.

    With resample over 1, every so many samples of a run and its last one.
    """
    inside = F.coalesce(F.col(log) == zone, F.lit(False)).cast("int")
    own = samples.withColumn("__in", inside).withColumn("__c", F.abs(F.col("__in") - F.lag("__in", 1, 0).over(along())))
    own = own.withColumn("POLY_ID", F.sum("__c").over(until()).cast("int")).where("__in = 1").drop("__in", "__c")
    if resample > 1:
        run = Window.partitionBy("well", "POLY_ID")
        own = own.withColumns({"__n": F.row_number().over(run.orderBy("seq")), "__of": F.count(F.lit(1)).over(run)})
        own = own.where(((F.col("__n") - 1) % resample == 0) | (F.col("__n") == F.col("__of"))).drop("__n", "__of")
    return own


def zone_polylines(samples: DataFrame, zone: int, log: str = "zone", resample: int = 1) -> DataFrame:
    """zone_interval() of all wells as polylines: POLY_ID is unique over wells, which follow each other by name."""
    own = zone_interval(samples, zone, log, resample)
    ends = own.groupBy("well").agg(F.max("POLY_ID").alias("__max"))  # a row a well
    shift = F.coalesce(F.sum(F.col("__max") + 1).over(Window.orderBy("well").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(ends.select("well", shift.alias("__shift")), "well").withColumn("POLY_ID", (F.col("POLY_ID") + F.col("__shift")).cast("int")).drop("__shift")


def zone_quality(samples: DataFrame, log: str = "zone", name: str = "zoneqc") -> DataFrame:
    """Adds a flag by run: 0 first or last run, 1 increasing, 2 decreasing, 3 turn back from above, 4 from below, 9 a neighbour is undefined.

    An undefined run counts as larger than any zone, so between two defined runs it has 3.
    """
    numbered = runs(samples, log, "__run")
    runs_ = numbered.groupBy("well", "__run").agg(F.coalesce(F.first(log), F.lit(UNDEF_INT)).alias("__z"))
    w = Window.partitionBy("well").orderBy("__run")
    p, z, n = F.lag("__z").over(w), F.col("__z"), F.lead("__z").over(w)
    flag = F.when(p.isNull() | n.isNull(), 0).when((p == UNDEF_INT) | (n == UNDEF_INT), 9).when((n > z) & (z > p), 1).when((n < z) & (z < p), 2).when((n < z) & (z > p), 3).otherwise(4)
    return numbered.join(runs_.select("well", "__run", flag.alias(name)), ["well", "__run"]).drop("__run")


def zone_tops(samples: DataFrame, zones: tuple[int, int], log: str = "zone", md: str = "md", prefix: str = "Top", use_undef: bool = False) -> DataFrame:
    """A pick for each zone boundary that is passed: well, x, y, z, md, Q_INCL, zone, top, in the order of `pick`.

    Going up in zones, the picks are at the current sample, one for each zone entered; going down, at the sample before,
    one for each zone left. zones: the first and last zone that give picks. A step from or to undefined samples gives
    none; with use_undef these are left out first, and a well starts from the zone before the first.
    """
    first, last = zones
    if last <= first:
        raise ValueError("two or more zones are asked for")
    own = geometrics(samples) if "Q_INCL" not in samples.columns else samples
    if use_undef:
        own = own.where(F.col(log).isNotNull())
    w = along()
    place = F.struct("x", "y", "z", F.col(md).alias("md"), "Q_INCL", "seq")
    start = F.when(F.row_number().over(w) == 1, F.lit(first - 1)) if use_undef else F.lit(None).cast("int")
    own = own.withColumns({"__p": F.coalesce(F.lag(log).over(w), start), "__here": place, "__before": F.lag(place).over(w)})
    p, z = F.col("__p"), F.col(log)
    up = (p < z) & (z >= first) & (p < last)
    down = (p > z) & (p >= first) & (z < last) & F.col("__before").isNotNull()
    zone = F.when(up, F.sequence(F.greatest(p + 1, F.lit(first)), F.least(z, F.lit(last)))).when(down, F.sequence(F.least(p, F.lit(last)), F.greatest(z + 1, F.lit(first)), F.lit(-1)))
    picks = own.where(up | down).select("well", F.col("seq").alias("__at"), F.when(up, F.col("__here")).otherwise(F.col("__before")).alias("h"), F.posexplode(zone).alias("__k", "zone"))
    order = F.row_number().over(Window.partitionBy("well").orderBy("__at", "__k"))
    return picks.select("well", order.alias("pick"), "h.x", "h.y", "h.z", "h.md", "h.Q_INCL", "zone", F.concat(F.lit(prefix), F.col("zone").cast("string")).alias("top"))


def zone_thickness(samples: DataFrame, zones: tuple[int, int], log: str = "zone", md: str = "md", incl_limit: float = 80.0, use_undef: bool = False) -> DataFrame:
    """Between consecutive picks of different zones whose mean inclination is under the limit: the midpoint, and the thickness in z."""
    picks = zone_tops(samples, zones, log, md, "", use_undef)
    w = Window.partitionBy("well").orderBy("pick")
    nxt = {c: F.lead(c).over(w) for c in ("x", "y", "z", "md", "Q_INCL", "zone")}
    both = picks.withColumns({f"__{c}": e for c, e in nxt.items()})
    mid = lambda c: ((F.col(c) + F.col(f"__{c}")) / 2)
    return both.where((F.col("zone") != F.col("__zone")) & (mid("Q_INCL") < incl_limit)).select(
        "well", "pick", mid("x").alias("x"), mid("y").alias("y"), F.round(F.abs(F.col("__z") - F.col("z")), 4).alias("z"), mid("md").alias("md_avg"), F.col("md").alias("md1"), F.col("__md").alias("md2"), mid("Q_INCL").alias("incl"), F.least("zone", "__zone").alias("zone")
    )


def zone_holes(samples: DataFrame, log: str = "zone", threshold: int = 5) -> DataFrame:
    """The first sample with a zone after each run of up to `threshold` samples without one, where a zone came before."""
    known = F.col(log).isNotNull()
    own = runs(samples.withColumn("__k", known.cast("int")), "__k", "__run")
    runs_ = own.groupBy("well", "__run").agg(F.first("__k").alias("k"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("at"))
    w = Window.partitionBy("well").orderBy("__run")
    holes = runs_.withColumns({"hole_n": F.lag("n").over(w), "before": F.lag("k", 2).over(w)})
    hits = holes.where((F.col("k") == 1) & (F.col("before") == 1) & (F.col("hole_n") <= threshold)).select("well", F.col("at").alias("seq"))
    return own.drop("__k", "__run").join(hits, ["well", "seq"])


def mask_shoulderbeds(samples: DataFrame, inputs: Sequence[str], targets: Sequence[str], nsamples: int | None = 2, distance: float | None = None, depth: str = "md") -> DataFrame:
    """Targets set to null near changes of discrete logs: within so many samples, or within a distance of the change.

    The distance is measured in `depth` from halfway between the samples where the value changes; steps from or to
    undefined values are no changes for counted samples, and bound the search for distances.
    """
    out = samples
    for log in inputs:
        w = along()
        change = F.coalesce(F.col(log) != F.lag(log).over(w), F.lit(False))
        if distance is None:
            n = int(nsamples or 0)
            edge = out.withColumn("__e", change.cast("int")).withColumn("__e", F.greatest(F.col("__e"), F.coalesce(F.lead("__e").over(w), F.lit(0))))
            hit = F.max("__e").over(w.rowsBetween(-(n - 1), n - 1)) == 1
        else:
            edge = runs(out.withColumn("__k", F.col(log).isNotNull()), "__k", "__part").withColumn("__e", F.when(change, (F.col(depth) + F.lag(depth).over(w)) / 2))
            own = Window.partitionBy("well", "__part").orderBy("seq")
            up, down = F.last("__e", True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.first("__e", True).over(own.rowsBetween(1, Window.unboundedFollowing))
            hit = F.coalesce(F.abs(F.col(depth) - up) <= distance, F.lit(False)) | F.coalesce(F.abs(down - F.col(depth)) <= distance, F.lit(False))
        flagged = edge.withColumn("__hit", hit)
        out = flagged.withColumns({t: F.when(~F.col("__hit"), F.col(t)) for t in targets}).drop("__e", "__hit", "__k", "__part")
    return out


def fraction_per_zone(samples: DataFrame, log: str, codes: Sequence[int], zone: str = "zone", zones: Sequence[int] | None = None, incl_limit: float = 80.0, count_limit: int = 3) -> DataFrame:
    """Per run of a zone that is passed upwards or downwards (zone_quality 1 or 2): the share of samples with the codes.

    Left out are runs with an undefined code, with fewer than count_limit samples, or steeper than incl_limit anywhere.
    """
    own = zone_quality(runs(geometrics(samples) if "Q_INCL" not in samples.columns else samples, zone, "run"), zone, "__q")
    if zones is not None:
        own = own.where(F.col(zone).isin(list(zones)))
    hit = F.when(F.col(log).isin(list(codes)), 1.0).otherwise(0.0)
    per = own.where(F.col(zone).isNotNull() & F.col("__q").isin(1, 2)).groupBy("well", F.col(zone).alias("zone"), "run").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.avg("Q_INCL").alias("incl"), F.avg(hit).alias("dfrac"), F.count(F.lit(1)).alias("n"), F.max("Q_INCL").alias("__max"), F.count(log).alias("__known")
    )
    return per.where((F.col("__max") <= incl_limit) & (F.col("n") >= count_limit) & (F.col("__known") == F.col("n"))).drop("__max", "__known")


# --- wells and other objects ----------------------------------------------------------------------------------------


def surface_picks(samples: DataFrame, md: str = "md", surface: str = "surface_z") -> DataFrame:
    """Where trajectories cross a surface, from the surface's z at each sample (null off the map): the place, by a line between samples.

    DIRECTION is 1 going down through it, -1 going up.
    """
    w = along()
    own = samples.withColumn("__d", F.col("z") - F.col(surface))
    prev = {c: F.lag(c).over(w) for c in ("__d", "x", "y", "z", md)}
    own = own.withColumns({f"__p{c}": e for c, e in prev.items()})
    a, b = F.col("__p__d"), F.col("__d")
    down, up = (a <= 0) & (b > 0), (a >= 0) & (b < 0)
    t = -a / (b - a)
    at = lambda c: (F.col(f"__p{c}") + t * (F.col(c) - F.col(f"__p{c}"))).alias(c)
    return own.where(down | up).select("well", "seq", at("x"), at("y"), at("z"), at(md), F.when(down, 1).otherwise(-1).alias("direction"))


def segments(samples: DataFrame, md: str = "md") -> DataFrame:
    """Pairs of neighbouring samples: well, seq, x1 to md1 and x2 to md2."""
    w = along()
    own = samples.select("well", "seq", *(F.col(c).alias(f"{c}1") for c in ("x", "y", "z")), F.col(md).alias("md1"), *(F.lead(c).over(w).alias(f"{c}2") for c in ("x", "y", "z")), F.lead(md).over(w).alias("md2"))
    return own.where(F.col("x2").isNotNull())


def dealt(rows: DataFrame, tile: Sequence[str], key: Sequence[str], block: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The two sides, a and b, of a join of rows with themselves: rows of a tile are dealt by key into blocks (at most so many), and block p of a meets block q of b, p <= q.

    So two rows of different blocks meet once, in no order; of p = q the caller takes one order.
    """
    n = F.ceil(F.count(F.lit(1)) / block)
    blocks = rows.groupBy(*tile).agg((F.least(n, F.lit(most)) if most else n).cast("long").alias("n"))
    own = rows.join(blocks, list(tile)).withColumn("at", F.pmod(F.xxhash64(*key), F.col("n")))
    a = own.withColumns({"p": F.col("at"), "q": F.explode(F.sequence(F.col("at"), F.col("n") - 1))})
    b = own.withColumns({"q": F.col("at"), "p": F.explode(F.sequence(F.lit(0).cast("long"), F.col("at")))})
    return a.drop("n", "at").alias("a"), b.drop("n", "at").alias("b")


def same(columns: Sequence[str]) -> Column:
    return reduce(lambda s, t: s & t, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in columns))


def intersections(samples: DataFrame, md: str = "md", tile: float | None = None, tolerance: dict[str, float] | None = None, block: int = 4096, blocks: int = 64) -> DataFrame:
    """Where wells cross in the map: well, md on it, other (the crossing well), and x, y, z of the other's line.

    Both directions have their row. Segments meet only in tiles that both touch, so the join is on equal tiles, and each
    pair meets once; tiles of the length of most segments hold few. A crowded tile's segments are dealt into blocks of about
    that size, at most so many (a segment is then written that often and once more, at most), and two blocks meet under a
    key of their own, so that a tile is many tasks. A crossing is reported once. tolerance (x, y, z): samples of a well that
    are within all of these of a sample of the other are left out, so that parallel paths don't cross.
    """
    seg = cut(segments(samples.where(F.col("well").isNotNull()), md))  # both sides have to see the same neighbours, also where seq has ties
    length = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    tile = tile or max(1e-9, 2 * float(seg.agg(F.percentile_approx(length, 0.9)).first()[0] or 1.0))
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / tile).cast("long"), F.floor(F.greatest(a, b) / tile).cast("long"))
    tiled = seg.withColumn("tx", F.explode(span(F.col("x1"), F.col("x2")))).withColumn("ty", F.explode(span(F.col("y1"), F.col("y2"))))
    a, b = dealt(tiled, ("tx", "ty"), ("well", "seq"), block, blocks)
    # boxes of crossing segments overlap; of the tiles that both touch, the first one counts
    overlap = lambda c: (F.least(f"a.{c}1", f"a.{c}2") <= F.greatest(f"b.{c}1", f"b.{c}2")) & (F.least(f"b.{c}1", f"b.{c}2") <= F.greatest(f"a.{c}1", f"a.{c}2"))
    first = lambda c: F.col(f"a.t{c}") == F.greatest(F.floor(F.least(f"a.{c}1", f"a.{c}2") / tile), F.floor(F.least(f"b.{c}1", f"b.{c}2") / tile))
    apart = F.when(F.col("a.p") < F.col("a.q"), F.col("a.well") != F.col("b.well")).otherwise(F.col("a.well") < F.col("b.well"))
    joined = a.join(b, same(("tx", "ty", "p", "q")) & apart & overlap("x") & overlap("y") & first("x") & first("y"))
    c = lambda s: F.col(s)
    rx, ry, sx, sy = c("a.x2") - c("a.x1"), c("a.y2") - c("a.y1"), c("b.x2") - c("b.x1"), c("b.y2") - c("b.y1")
    det = rx * sy - ry * sx
    qx, qy = c("b.x1") - c("a.x1"), c("b.y1") - c("a.y1")
    t, u = (qx * sy - qy * sx) / F.nullif(det, F.lit(0.0)), (qx * ry - qy * rx) / F.nullif(det, F.lit(0.0))
    hit = joined.select(*(c(f"{s}.{n}").alias(f"{s}_{n}") for s in "ab" for n in ("well", "seq", "x1", "y1", "z1", "md1", "x2", "y2", "z2", "md2")), t.alias("t"), u.alias("u"))
    # segments are half open, so that a crossing at a sample is one crossing
    hit = hit.where((F.col("t") >= 0) & (F.col("t") < 1) & (F.col("u") >= 0) & (F.col("u") < 1))

    def seen(s: str, o: str, share: str, at: str) -> Column:
        on = lambda w, n, v: c(f"{w}_{n}1") + c(v) * (c(f"{w}_{n}2") - c(f"{w}_{n}1"))
        return F.struct(c(f"{s}_well").alias("well"), c(f"{s}_seq").alias("seq"), on(s, "md", share).alias("md"), c(f"{o}_well").alias("other"), *(on(o, n, at).alias(n) for n in "xyz"))

    hit = hit.select(F.explode(F.array(seen("a", "b", "t", "u"), seen("b", "a", "u", "t"))).alias("h")).select("h.*")
    if tolerance:
        hit = hit.join(parallel_samples(samples, tolerance), ["well", "seq", "other"], "left_anti")
    return hit.select("well", "seq", "md", "other", "x", "y", "z")


def parallel_samples(samples: DataFrame, tolerance: dict[str, float]) -> DataFrame:
    """(well, seq, other): samples that are within the tolerances of x, y and z of some sample of another well."""
    size = max(tolerance["x"], tolerance["y"])
    own = samples.select("well", "seq", "x", "y", "z").withColumns({"tx": F.floor(F.col("x") / size), "ty": F.floor(F.col("y") / size)})
    around = lambda c: F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.col(c) + k))
    near = own.select(F.col("well").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), around("tx").alias("tx"), "ty").withColumn("ty", around("ty"))
    pairs = own.join(near, ["tx", "ty"]).where((F.col("well") != F.col("other")) & (F.abs(F.col("x") - F.col("ox")) <= tolerance["x"]) & (F.abs(F.col("y") - F.col("oy")) <= tolerance["y"]) & (F.abs(F.col("z") - F.col("oz")) <= tolerance["z"]))
    return pairs.select("well", "seq", "other").distinct()


def may_overlap(samples: DataFrame, tile: float = 1000.0, block: int = 2048) -> DataFrame:
    """Pairs of wells whose bounding boxes in the map overlap, each once; boxes are compared in the tiles that both touch.

    A tile's boxes are dealt into blocks of that size, and two blocks meet under a key of their own: however many wells
    start from one place, no task holds more than it looks at, and all pairs of a tile are many keys.
    """
    box = samples.where(F.col("well").isNotNull()).groupBy("well").agg(*(f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))))
    tiles = cut(box)
    for c in ("x", "y"):
        tiles = tiles.withColumn(f"t{c}", F.explode(F.sequence(F.floor(F.col(f"min{c}") / tile).cast("long"), F.floor(F.col(f"max{c}") / tile).cast("long"))))
    a, b = dealt(tiles, ("tx", "ty"), ("well",), block)
    meet = same(("tx", "ty", "p", "q"))
    for c in ("x", "y"):
        meet = meet & (F.col(f"a.min{c}") <= F.col(f"b.max{c}")) & (F.col(f"b.min{c}") <= F.col(f"a.max{c}"))
        # of the tiles that both touch, the first one counts
        meet = meet & (F.col(f"a.t{c}") == F.floor(F.greatest(f"a.min{c}", f"b.min{c}") / tile))
    meet = meet & ((F.col("a.p") < F.col("a.q")) | (F.col("a.well") < F.col("b.well")))
    return a.join(b, meet).select(F.least("a.well", "b.well").alias("well"), F.greatest("a.well", "b.well").alias("other"))


def with_cell_properties(samples: DataFrame, cells: DataFrame, props: Sequence[str], suffix: str = "_model") -> DataFrame:
    """Adds properties of the cell (i, j, k) that a sample is in; null outside and in inactive cells."""
    own = cells.where("actnum = 1").select("i", "j", "k", *(F.col(p).alias(p + suffix) for p in props))
    return samples.join(own, ["i", "j", "k"], "left")


def zone_mismatch(
    samples: DataFrame, zone: str = "zone", model: str = "zone_model", zones: tuple[int, int] = (0, 9999), shift: int = 0, depths: tuple[float, float] | None = None, perf: str | None = None, perf_range: tuple[float, float] = (1, 9999)
) -> DataFrame:
    """Per well: match1, the share in percent of samples in a zone of the range whose model zone is the same; match2, the share of samples whose model zone is in the range and whose log agrees; with counts."""
    own = samples
    if depths:
        own = own.where((F.col("z") > depths[0]) & (F.col("z") < depths[1]))
    z, m = F.col(zone) + shift, F.col(model)
    z = F.when(z.isNull(), -999).when(~z.between(*zones), -888).otherwise(z)
    if perf:
        z = F.when(F.coalesce(F.col(perf).between(*perf_range), F.lit(False)), z).otherwise(-899)
    m = F.when(m.isNull(), -999).when(~m.between(*zones), -888).otherwise(m)
    own = own.select("well", z.alias("__z"), m.alias("__m"))
    one, two, same = F.col("__z") > -888, F.col("__m") > -888, F.col("__z") == F.col("__m")
    count = lambda c: F.sum(c.cast("long"))
    sums = own.groupBy("well").agg(count(one & same).alias("mcount1"), count(one).alias("tcount1"), count(two & same).alias("mcount2"), count(two).alias("tcount2"))
    return sums.select("well", *(e for k in "12" for e in (F.try_divide(F.col(f"mcount{k}") * 100.0, F.col(f"tcount{k}")).alias(f"match{k}"), F.col(f"mcount{k}"), F.col(f"tcount{k}"))))


def trajectory_polylines(samples: DataFrame) -> DataFrame:
    """Trajectories as polylines, named by their well."""
    return samples.select(F.xxhash64("well").alias("poly_id"), "seq", "x", "y", "z", F.col("well").alias("name"))
