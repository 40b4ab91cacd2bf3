"""Queries over generated objects, and joins of wells with models."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from terraspan.functions.geometry import MapHeader, rounded
from terraspan.operators import cells as c
from terraspan.operators import surfaces as s
from terraspan.operators import wells as w
from terraspan.plans.cubes import CUBE, SAMPLES
from terraspan.plans.registry import Registry

R = Registry()
DOME = MapHeader(40, 30, 500.0, 600.0, 20.0, 25.0)


def _sizes(table, *columns):
    """The largest index in each column; a row of them comes to the driver."""
    return [int(x or 0) for x in table.agg(*(F.max(c) for c in columns)).first()]


_RANGES = "n AS (SELECT max(i) AS ni, max(j) AS nj FROM traces), lat AS (SELECT cast(i AS int) AS i, cast(j AS int) AS j, ni, nj FROM (SELECT unnest(range(1, {0} + 1)) AS i, ni, nj FROM n) a, (SELECT unnest(range(1, {1} + 1)) AS j FROM n) b)"


@R.query(f"WITH {_RANGES.format('ni', 'nj')} SELECT i, j, 1234.5 AS value FROM lat", "traces")
def surface_from_cube(traces):
    """A constant map over the cube's own lines."""
    ni, nj = _sizes(traces, "i", "j")
    return s.constant(traces.sparkSession, replace(CUBE.map, ncol=ni, nrow=nj), 1234.5)


@R.query(f"""WITH {_RANGES.format('2 * ni', 'nj + 5')}, l AS (SELECT i, j, (i - 1) * 20.0 AS x, (j - 1) * 25.0 AS y, (2 * ni - 1) * 10.0 AS cx, (nj + 4) * 12.5 AS cy FROM lat),
z AS (SELECT i, j, (x * sin(radians(60)) + y * cos(radians(60))) * tan(radians(2)) - 40.0 * sqrt(greatest(0, 1 - ((x - cx) / 250)**2 - ((y - cy) / 200)**2)) AS z FROM l) SELECT i, j, round(z - min(z) OVER () + 1500, 6) AS value FROM z""", "traces")
def surface_synthetic(traces):
    """A dome over twice as many columns as the cube has lines, and five more rows."""
    ni, nj = _sizes(traces, "i", "j")
    return s.synthetic(traces.sparkSession, replace(DOME, ncol=2 * ni, nrow=nj + 5), 250.0, 200.0, 40.0, 1500.0, 2.0, 60.0).withColumn("value", rounded("value"))


@R.query("""WITH m AS (SELECT max(i) AS ni, max(j) AS nj, max(k) AS nk FROM cells)
SELECT cast(i AS int) AS i, cast(j AS int) AS j, cast(k AS int) AS k, round(10 + (i - 0.5) * 5 * cos(radians(30)) - (j - 0.5) * 6 * sin(radians(30)), 6) AS x, round(20 + (i - 0.5) * 5 * sin(radians(30)) + (j - 0.5) * 6 * cos(radians(30)), 6) AS y, 1000 + (k - 0.5) * 7 AS z, 210.0 AS volume
FROM (SELECT unnest(range(1, ni + 1)) AS i FROM m) a, (SELECT unnest(range(1, nj + 1)) AS j FROM m) b, (SELECT unnest(range(1, nk + 1)) AS k FROM m) d""", "cells")
def grid_box(cells):
    """A box of as many cells as the grid has places."""
    own = c.with_centre(c.box_grid(cells.sparkSession, tuple(_sizes(cells, "i", "j", "k")), (10, 20, 1000), (5, 6, 7), 30.0))
    return own.select("i", "j", "k", *(rounded(x).alias(x) for x in "xyz"), rounded(c.bulk_volume()).alias("volume"))


@R.query(f"WITH {SAMPLES} SELECT i, j, k, 1000 + (i - 1) * 50.0 AS x, 2000 + (j - 1) * 40.0 AS y, 1000 + (k - 1) * 4.0 AS z, v AS seismics FROM smp", "traces")
def grid_from_cube(traces):
    own = c.with_centre(c.from_cube(traces, (50.0, 40.0, 4.0), (1000.0, 2000.0, 1000.0)))
    return own.select("i", "j", "k", *(rounded(x).alias(x) for x in "xyz"), "seismics")


_WELL_CELLS = "wc AS (SELECT w.*, cast(seq % 22 AS int) AS i, cast(seq % 19 AS int) AS j, cast(seq % 8 AS int) AS k FROM wells w)"


def _indexed(samples):
    return samples.withColumns({a: F.col("seq") % n for a, n in (("i", 22), ("j", 19), ("k", 8))})


@R.query(f"WITH {_WELL_CELLS} SELECT well, seq, round(c.perm, 6) AS perm_model, c.zone AS zone_model FROM wc LEFT JOIN (SELECT * FROM cells WHERE actnum = 1) c USING (i, j, k)", "wells", "cells")
def well_grid_properties(samples, cells):
    out = w.with_cell_properties(_indexed(samples).drop("zone"), cells, ["perm", "zone"])
    return out.select("well", "seq", rounded("perm_model").alias("perm_model"), "zone_model")


@R.query(f"""WITH {_WELL_CELLS}, m AS (SELECT well, CASE WHEN NOT coalesce(wc.poro BETWEEN 5 AND 80, false) THEN -899 WHEN wc.zone IS NULL THEN -999 WHEN wc.zone NOT BETWEEN 1 AND 3 THEN -888 ELSE wc.zone END AS z,
 CASE WHEN c.zone IS NULL THEN -999 WHEN c.zone NOT BETWEEN 1 AND 3 THEN -888 ELSE c.zone END AS m FROM wc LEFT JOIN (SELECT * FROM cells WHERE actnum = 1) c USING (i, j, k) WHERE z > 1510 AND z < 1620),
a AS (SELECT well, count(*) FILTER (z > -888 AND z = m) AS mcount1, count(*) FILTER (z > -888) AS tcount1, count(*) FILTER (m > -888 AND z = m) AS mcount2, count(*) FILTER (m > -888) AS tcount2 FROM m GROUP BY well)
SELECT well, round(100.0 * mcount1 / nullif(tcount1, 0), 6) AS match1, mcount1, tcount1, round(100.0 * mcount2 / nullif(tcount2, 0), 6) AS match2, mcount2, tcount2 FROM a""", "wells", "cells")
def well_zone_mismatch(samples, cells):
    own = w.with_cell_properties(_indexed(samples), cells, ["zone"])
    out = w.zone_mismatch(own, zones=(1, 3), depths=(1510.0, 1620.0), perf="poro", perf_range=(5.0, 80.0))
    return out.withColumns({"match1": rounded("match1"), "match2": rounded("match2")})


@R.query("SELECT well AS name, seq, x, y, z FROM wells", "wells")
def well_polylines(samples):
    return w.trajectory_polylines(samples).select("name", "seq", "x", "y", "z")


@R.query("SELECT count(DISTINCT well) AS n_wells FROM wells", "wells")
def points_count_wells(samples):
    return samples.agg(F.countDistinct("well").alias("n_wells"))


@R.query("SELECT count(*) AS n, cast(sum(cast('0x' || substr(md5(concat_ws('|', i, j, coalesce(cast(cast(floor(value * 1000000.0 + 0.5) AS bigint) AS varchar), 'null'))), 1, 15) AS bigint)) AS varchar) AS hash FROM nodes WHERE realisation = 1", "nodes")
def surface_content_hash(nodes):
    return s.content_hash(nodes.where("realisation = 1"))
