"""Joins of intervals that overlap, by equal keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least and the greatest level: lengths of 2 ** level that are told apart.
LEVELS = (-40, 60)


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Each row of left with each of right that has equal keys and an interval (lo, hi) that shares a length with its own.

    Columns but the keys are told apart by the caller; right's interval has the same column names, which are left's in the
    result. Intervals that are empty or null meet nothing.

    An interval's level is that of its length, doubling from one to the next, and it lies in two or three bands of its level at
    most. Pairs meet on the longer one's level: there the longer one is in few bands, and so is the shorter one. A row
    looks only on levels that rows of the other side have under its keys. So where intervals of one side don't overlap
    each other, the pairs that are looked at grow with those that share a length, whatever the lengths are.
    """
    level = F.least(F.greatest(F.ceil(F.log2(F.col(hi) - F.col(lo))), F.lit(LEVELS[0])), F.lit(LEVELS[1])).cast("int")
    sides = [x.where(F.col(hi) > F.col(lo)).withColumn("__level", level) for x in (left, right)]
    levels = [x.groupBy(*keys).agg(F.collect_set("__level").alias("__levels")) for x in sides]
    band = lambda z, n: F.floor(z / F.pow(F.lit(2.0), n)).cast("long")

    def laid(rows: DataFrame, on: Column) -> DataFrame:
        """Rows in all bands of the levels."""
        own = rows.withColumn("__on", F.explode(on))
        return own.withColumn("__band", F.explode(F.sequence(band(F.col(lo), F.col("__on")), band(F.col(hi), F.col("__on")))))

    outs = []
    for longer in (0, 1):
        other = 1 - longer
        held = laid(sides[longer], F.array("__level"))
        # of equal levels, left's rows are the longer ones
        above = F.filter("__levels", lambda n: n >= F.col("__level") if longer == 0 else n > F.col("__level"))
        looks = laid(sides[other].join(levels[longer], list(keys)), above).drop("__levels")
        # right's interval gets other names
        apart = {c: f"__o{c}" for c in (lo, hi, "__level")}
        held, looks = (held.withColumnsRenamed(apart), looks) if longer else (held, looks.withColumnsRenamed(apart))
        met = held.join(looks, [*keys, "__on", "__band"])
        first = F.greatest(band(F.col(lo), F.col("__on")), band(F.col(f"__o{lo}"), F.col("__on")))
        share = (F.col(lo) < F.col(f"__o{hi}")) & (F.col(f"__o{lo}") < F.col(hi))
        outs.append(met.where(share & (F.col("__band") == first)).drop("__on", "__band", "__level", "__o__level", f"__o{lo}", f"__o{hi}"))
    return outs[0].unionByName(outs[1])
