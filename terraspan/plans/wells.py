"""Queries over wells."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraspan.functions.geometry import rounded
from terraspan.operators import wells as w
from terraspan.plans.registry import Registry

R = Registry()

SEGMENTS = """
s AS (SELECT *, x - lag(x) OVER o AS dx, y - lag(y) OVER o AS dy, z - lag(z) OVER o AS dz, lead(seq) OVER o AS nx FROM wells WINDOW o AS (PARTITION BY well ORDER BY seq)),
a AS (SELECT *, CASE WHEN abs(dz) > 1e-5 THEN degrees(atan2(sqrt(dx*dx + dy*dy), dz)) WHEN dz IS NOT NULL THEN 90.0 END AS si,
  CASE WHEN dx = 0 AND dy = 0 THEN 0.0 WHEN abs(dx) <= 1e-5 THEN CASE WHEN dy < 0 THEN 180.0 ELSE 0.0 END ELSE degrees(atan2(dx, dy)) END AS sa FROM s),
b AS (SELECT *, lead(si) OVER o AS ni, lead(sa) OVER o AS na FROM a WINDOW o AS (PARTITION BY well ORDER BY seq)),
c AS (SELECT *, CASE WHEN dx IS NOT NULL AND nx IS NOT NULL THEN degrees(atan2(sin(radians(si)) + sin(radians(ni)), cos(radians(si)) + cos(radians(ni)))) END AS i1,
  CASE WHEN dx IS NOT NULL AND nx IS NOT NULL THEN degrees(atan2(sin(radians(sa)) + sin(radians(na)), cos(radians(sa)) + cos(radians(na)))) END AS a1 FROM b),
geo AS (SELECT * EXCLUDE (dx, dy, dz, nx, si, sa, ni, na, i1, a1), sum(coalesce(sqrt(dx*dx + dy*dy + dz*dz), 0)) OVER (o ROWS UNBOUNDED PRECEDING) AS Q_MDEPTH,
  coalesce(i1, lead(i1) OVER o, lag(i1) OVER o) AS Q_INCL, (coalesce(a1, lead(a1) OVER o, lag(a1) OVER o) + 360) % 360 AS Q_AZI FROM c WINDOW o AS (PARTITION BY well ORDER BY seq))"""


@R.query(f"WITH {SEGMENTS} SELECT well, seq, round(Q_MDEPTH, 4) AS q_mdepth, round(Q_INCL, 4) AS q_incl, round(Q_AZI, 4) AS q_azi FROM geo", "wells")
def well_geometrics(samples):
    out = w.geometrics(samples)
    return out.select("well", "seq", *(rounded(c, 4).alias(c.lower()) for c in ("Q_MDEPTH", "Q_INCL", "Q_AZI")))


@R.query("SELECT well, seq, round(sum(d) OVER (PARTITION BY well ORDER BY seq ROWS UNBOUNDED PRECEDING), 6) AS r_hlen FROM (SELECT well, seq, coalesce(sqrt((x - lag(x) OVER o)**2 + (y - lag(y) OVER o)**2), 0) AS d FROM wells WINDOW o AS (PARTITION BY well ORDER BY seq))", "wells")
def well_relative_hlen(samples):
    return w.relative_hlen(samples).select("well", "seq", rounded("R_HLEN").alias("r_hlen"))


@R.query("SELECT well, seq, z FROM wells WHERE z >= 1550 AND z <= 1600", "wells")
def well_limit_tvd(samples):
    return w.limit_tvd(samples, 1550.0, 1600.0).select("well", "seq", "z")


@R.query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY well) AS m FROM wells)
SELECT well, seq, x, y, z FROM n WHERE m * 7 < 10 OR k % 5 = 0 UNION ALL SELECT well, seq, x, y, z FROM n WHERE m * 7 >= 10 AND k = m - 1""", "wells")
def well_downsample(samples):
    return w.downsample(samples.select("well", "seq", "x", "y", "z", "md", "zone", "facies", "poro"), 5).select("well", "seq", "x", "y", "z")


@R.query("""WITH e AS (SELECT well, min(md) AS a, max(md) AS b, cast(round_even((max(md) - min(md)) / 7.5, 0) AS int) AS n FROM wells GROUP BY well),
p AS (SELECT well, cast(k + 1 AS int) AS seq, CASE WHEN k = n - 1 AND n > 1 THEN b ELSE a + (b - a) * k / greatest(n - 1, 1) END AS md FROM (SELECT *, unnest(range(n)) AS k FROM e)),
f AS (SELECT p.*, lo.md AS m1, hi.md AS m2, lo.x AS x1, hi.x AS x2, lo.z AS z1, hi.z AS z2, lo.poro AS p1, hi.poro AS p2 FROM p
  ASOF JOIN wells lo ON p.well = lo.well AND p.md >= lo.md ASOF JOIN wells hi ON p.well = hi.well AND p.md <= hi.md)
SELECT well, seq, round(md, 6) AS md, round(CASE WHEN m1 = m2 THEN x1 ELSE x1 + (x2 - x1) * (md - m1) / (m2 - m1) END, 6) AS x,
  round(CASE WHEN m1 = m2 THEN z1 ELSE z1 + (z2 - z1) * (md - m1) / (m2 - m1) END, 6) AS z, round(CASE WHEN m1 = m2 THEN p1 ELSE p1 + (p2 - p1) * (md - m1) / (m2 - m1) END, 6) AS poro FROM f""", "wells")
def well_rescale(samples):
    return w.rescale(samples, 7.5, discrete=("zone", "facies")).select("well", "seq", *(rounded(c).alias(c) for c in ("md", "x", "z", "poro")))


@R.query("SELECT well, seq, coalesce(zone, 2000000000) AS zone, coalesce(cast(facies AS int), 2000000000) AS facies, poro FROM wells", "wells")
def well_filled(samples):
    return w.filled(samples).select("well", "seq", "zone", "facies", "poro")


@R.query("SELECT well, seq, poro AS poro_copy, 7 AS flag, cast(facies AS double) AS litho FROM wells", "wells")
def well_log_ddl(samples):
    own = w.create_log(w.copy_log(samples, "poro", "poro_copy"), "flag", 7, discrete=True)
    own = w.set_log_type(w.rename_log(w.delete_logs(own, ["zone"]), "facies", "litho"), "litho", False)
    return own.select("well", "seq", "poro_copy", "flag", "litho")


@R.query("SELECT well, seq, cast(coalesce(facies, -999) AS double) AS facies, CASE WHEN part = 0 THEN poro ELSE -9999 END AS poro FROM (SELECT *, cast(right(well, 1) AS int) % 2 AS part FROM wells)", "wells")
def wells_stacked(samples):
    own = samples.withColumn("part", F.right("well", F.lit(1)).cast("int") % 2)
    base = ["well", "seq", "x", "y", "z", "facies"]
    return w.stacked([own.where("part = 0").select(*base, "poro"), own.where("part = 1").select(*base)]).select("well", "seq", "facies", "poro")


@R.query("SELECT DISTINCT well, replace(replace('31/2-' || well || ' A', '/', '_'), ' ', '_') AS safe_name, well || 'A' AS short_name FROM wells", "wells")
def well_names(samples):
    full = samples.withColumn("well", F.concat(F.lit("31/2-"), "well", F.lit(" A")))
    return w.names_of(full).withColumn("well", F.substring("well", 6, 6))


@R.query("SELECT well, count(*) AS n_samples, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max, count(poro) AS poro_n, min(poro) AS poro_min, round(avg(poro), 6) AS poro_mean, max(poro) AS poro_max FROM wells GROUP BY well", "wells")
def well_summary(samples):
    return w.summary(samples, ["poro"]).withColumn("poro_mean", rounded("poro_mean"))


INTERVAL = """i AS (SELECT *, CASE WHEN zone = 2 THEN 1 ELSE 0 END AS ind FROM wells), d AS (SELECT *, abs(ind - lag(ind, 1, 0) OVER (PARTITION BY well ORDER BY seq)) AS c FROM i),
iv AS (SELECT *, cast(sum(c) OVER (PARTITION BY well ORDER BY seq ROWS UNBOUNDED PRECEDING) AS int) AS poly_id FROM d)"""


@R.query(f"WITH {INTERVAL}, n AS (SELECT *, row_number() OVER (PARTITION BY well, poly_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY well, poly_id) AS m FROM iv WHERE ind = 1) SELECT well, seq, poly_id, x, y, z FROM n WHERE (k - 1) % 3 = 0 OR k = m", "wells")
def well_zone_interval(samples):
    return w.zone_interval(samples, 2, resample=3).select("well", "seq", F.col("POLY_ID").alias("poly_id"), "x", "y", "z")


@R.query(f"WITH {INTERVAL}, o AS (SELECT well, coalesce(sum(m + 1) OVER (ORDER BY well ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (SELECT well, max(poly_id) AS m FROM iv WHERE ind = 1 GROUP BY well)) SELECT well, seq, cast(poly_id + s AS int) AS poly_id, x, y, z FROM iv JOIN o USING (well) WHERE ind = 1", "wells")
def polygons_from_wells(samples):
    return w.zone_polylines(samples, 2).select("well", "seq", F.col("POLY_ID").alias("poly_id"), "x", "y", "z")


RUNS = """n AS (SELECT *, CASE WHEN row_number() OVER o = 1 OR zone IS DISTINCT FROM lag(zone) OVER o THEN 1 ELSE 0 END AS nw FROM geo WINDOW o AS (PARTITION BY well ORDER BY seq)),
r AS (SELECT *, cast(sum(nw) OVER (PARTITION BY well ORDER BY seq ROWS UNBOUNDED PRECEDING) AS int) AS run FROM n),
g AS (SELECT well, run, coalesce(any_value(zone), 2000000000) AS v FROM r GROUP BY well, run),
h AS (SELECT *, lag(v) OVER o AS p, lead(v) OVER o AS q FROM g WINDOW o AS (PARTITION BY well ORDER BY run)),
f AS (SELECT well, run, CASE WHEN p IS NULL OR q IS NULL THEN 0 WHEN p = 2000000000 OR q = 2000000000 THEN 9 WHEN q > v AND v > p THEN 1 WHEN q < v AND v < p THEN 2 WHEN q < v AND v > p THEN 3 ELSE 4 END AS zoneqc FROM h)"""


@R.query(f"WITH {SEGMENTS}, {RUNS} SELECT well, seq, zoneqc FROM r JOIN f USING (well, run)", "wells")
def well_zone_quality(samples):
    return w.zone_quality(samples).select("well", "seq", "zoneqc")


TOPS = f"""{SEGMENTS}, q AS (SELECT *, lag(zone) OVER o AS p, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(z) OVER o AS pz, lag(md) OVER o AS pm, lag(Q_INCL) OVER o AS pi FROM geo WINDOW o AS (PARTITION BY well ORDER BY seq)),
k AS (SELECT well, seq, x, y, z, md, Q_INCL AS incl, cast(unnest(range(greatest(p + 1, 1), least(zone, 4) + 1)) AS int) AS zone, 1 AS up FROM q WHERE zone > p UNION ALL
 SELECT well, seq, px, py, pz, pm, pi, cast(unnest(range(least(p, 4), greatest(zone + 1, 1) - 1, -1)) AS int), -1 FROM q WHERE zone < p),
tops AS (SELECT *, cast(row_number() OVER (PARTITION BY well ORDER BY seq, up * zone) AS int) AS pick FROM k)"""


@R.query(f"WITH {TOPS} SELECT well, pick, x, y, z, md, round(incl, 4) AS incl, zone, 'Top' || zone AS top FROM tops", "wells")
def well_zone_tops(samples):
    return w.zone_tops(samples, (1, 4)).withColumn("incl", rounded("Q_INCL", 4)).drop("Q_INCL")


@R.query(f"""WITH {TOPS}, u AS (SELECT *, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(z) OVER o AS z2, lead(md) OVER o AS m2, lead(incl) OVER o AS i2, lead(zone) OVER o AS zn FROM tops WINDOW o AS (PARTITION BY well ORDER BY pick))
SELECT well, pick, (x + x2) / 2 AS x, (y + y2) / 2 AS y, round(abs(z2 - z), 4) AS z, (md + m2) / 2 AS md_avg, round((incl + i2) / 2, 4) AS incl, least(zone, zn) AS zone FROM u WHERE zone <> zn AND (incl + i2) / 2 < 80""", "wells")
def well_zone_thickness(samples):
    return w.zone_thickness(samples, (1, 4)).withColumn("incl", rounded("incl", 4)).drop("md1", "md2")


@R.query("""WITH k AS (SELECT *, zone IS NOT NULL AS k, CASE WHEN (zone IS NULL) IS DISTINCT FROM (lag(zone) OVER o IS NULL) OR row_number() OVER o = 1 THEN 1 ELSE 0 END AS nw FROM wells WINDOW o AS (PARTITION BY well ORDER BY seq)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY well ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM k), g AS (SELECT well, run, bool_and(k) AS k, count(*) AS n, min(seq) AS seq FROM r GROUP BY well, run),
h AS (SELECT *, lag(n) OVER o AS hn, lag(k, 2) OVER o AS b FROM g WINDOW o AS (PARTITION BY well ORDER BY run))
SELECT h.well, h.seq, x, y, z, zone, md FROM h JOIN wells USING (well, seq) WHERE h.k AND b AND hn <= 1""", "wells")
def well_zone_holes(samples):
    return w.zone_holes(samples, threshold=1).select("well", "seq", "x", "y", "z", "zone", "md")


@R.query("""WITH t AS (SELECT *, coalesce(facies <> lag(facies) OVER o, false) AS c FROM wells WINDOW o AS (PARTITION BY well ORDER BY seq)), e AS (SELECT *, c OR coalesce(lead(c) OVER (PARTITION BY well ORDER BY seq), false) AS e FROM t)
SELECT well, seq, CASE WHEN NOT bool_or(e) OVER (PARTITION BY well ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) THEN poro END AS poro FROM e""", "wells")
def well_mask_shoulderbeds(samples):
    return w.mask_shoulderbeds(samples, ["facies"], ["poro"], 2).select("well", "seq", "poro")


@R.query("""WITH b AS (SELECT *, lag(facies) OVER o AS f0, (md + lag(md) OVER o) / 2 AS mid, facies IS NOT NULL AS k, CASE WHEN (facies IS NULL) IS DISTINCT FROM (lag(facies) OVER o IS NULL) OR row_number() OVER o = 1 THEN 1 ELSE 0 END AS nw FROM wells WINDOW o AS (PARTITION BY well ORDER BY seq)),
p AS (SELECT *, sum(nw) OVER (PARTITION BY well ORDER BY seq ROWS UNBOUNDED PRECEDING) AS part FROM b), e AS (SELECT well, part, mid FROM p WHERE facies <> f0)
SELECT well, seq, CASE WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.well = p.well AND e.part = p.part AND abs(e.mid - p.md) <= 5) THEN poro END AS poro FROM p""", "wells")
def well_mask_shoulderbeds_by_distance(samples):
    return w.mask_shoulderbeds(samples, ["facies"], ["poro"], distance=5.0).select("well", "seq", "poro")


@R.query(f"""WITH {SEGMENTS}, {RUNS} SELECT well, zone, run, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(CASE WHEN facies IN (0, 1) THEN 1.0 ELSE 0.0 END), 6) AS dfrac, count(*) AS n FROM r JOIN f USING (well, run)
WHERE zoneqc IN (1, 2) AND zone IS NOT NULL GROUP BY well, zone, run HAVING max(Q_INCL) <= 80 AND count(*) >= 3 AND count(facies) = count(*)""", "wells")
def well_fraction_per_zone(samples):
    return w.fraction_per_zone(samples, "facies", [0, 1]).select("well", "zone", "run", rounded("x").alias("x"), rounded("y").alias("y"), rounded("dfrac").alias("dfrac"), "n")


@R.query("""WITH s AS (SELECT well, seq, x, y, z, md, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(z) OVER o AS z2, lead(md) OVER o AS m2 FROM wells WINDOW o AS (PARTITION BY well ORDER BY seq)),
c AS (SELECT a.well, a.seq, a.md, a.m2, b.well AS other, b.x, b.y, b.z, b.x2, b.y2, b.z2, (a.x2 - a.x) * (b.y2 - b.y) - (a.y2 - a.y) * (b.x2 - b.x) AS det, (b.x - a.x) * (b.y2 - b.y) - (b.y - a.y) * (b.x2 - b.x) AS tn, (b.x - a.x) * (a.y2 - a.y) - (b.y - a.y) * (a.x2 - a.x) AS un
 FROM s a JOIN s b ON a.well <> b.well AND least(a.x, a.x2) <= greatest(b.x, b.x2) AND least(b.x, b.x2) <= greatest(a.x, a.x2) AND least(a.y, a.y2) <= greatest(b.y, b.y2) AND least(b.y, b.y2) <= greatest(a.y, a.y2) WHERE a.x2 IS NOT NULL AND b.x2 IS NOT NULL)
SELECT well, seq, round(md + tn / det * (m2 - md), 6) AS md, other, round(x + un / det * (x2 - x), 6) AS x, round(y + un / det * (y2 - y), 6) AS y, round(z + un / det * (z2 - z), 6) AS z FROM c WHERE det <> 0 AND tn / det >= 0 AND tn / det < 1 AND un / det >= 0 AND un / det < 1""", "wells")
def well_intersections(samples):
    out = w.intersections(samples)
    return out.select("well", "seq", rounded("md").alias("md"), "other", *(rounded(c).alias(c) for c in "xyz"))


@R.query("""WITH b AS (SELECT well, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM wells GROUP BY well)
SELECT a.well, b.well AS other FROM b a JOIN b ON a.well < b.well AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2""", "wells")
def well_may_overlap(samples):
    return w.may_overlap(samples)
