"""Files read in ranges by many tasks, and files written by tasks."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraspan.functions.geometry import MapHeader
from terraspan.operators import cells as c
from terraspan.sources import binary, roff, splits
from terraspan.sources.segy import read_segy, segy_bytes, segy_files


@pytest.fixture
def survey(tmp_path):
    r = np.random.default_rng(0)
    traces = pd.DataFrame([{"iline": 1 + k // 30, "xline": 10 + k % 30, "x": 100.25 * k, "y": 50.5, "traceid": 1 + (k == 4), "amp": r.normal(size=25).astype(np.float32)} for k in range(600)])
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.sgy").write_bytes(segy_bytes(traces, 4.0, 1000))
    (tmp_path / "s" / "b.sgy").write_bytes(segy_bytes(traces[:7], 2.0))
    return str(tmp_path / "s"), traces


@pytest.mark.parametrize("split", [1 << 26, 4096, 999])
def test_segy_in_ranges_is_the_whole(spark, survey, split):
    folder, traces = survey
    out = read_segy(spark, f"file://{folder}", split=split)
    rows = {(os.path.basename(r.file), r.n): r for r in out.collect()}
    assert len(rows) == 607 and {k for k in rows if k[0] == "b.sgy"} == {("b.sgy", n) for n in range(7)}
    assert split > 1 << 20 or out.rdd.getNumPartitions() > 50
    for n, t in enumerate(traces.itertuples()):
        r = rows["a.sgy", n]
        assert (r.iline, r.xline, r.x, r.traceid, r.z0, r.dz) == (t.iline, t.xline, t.x, t.traceid, 1000.0, 4.0) and np.array_equal(np.array(r.amp, np.float32), t.amp)


def test_segy_makes_only_what_is_asked_for(spark, survey):
    folder, traces = survey
    out = read_segy(spark, f"{folder}/a*.sgy", columns=["xline", "iline"], split=5000)
    assert out.columns == ["xline", "iline"] and sorted(map(tuple, out.collect())) == sorted(zip(traces.xline, traces.iline, strict=True))
    with pytest.raises(Exception, match="nothing"):
        read_segy(spark, f"{folder}/nothing").count()


def test_filters_are_pushed(spark, survey):
    folder, traces = survey
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        out = read_segy(spark, f"{folder}/a.sgy", split=5000).where("iline between 3 and 4 and xline in (11, 12) and x > 0")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.n for r in out.collect()) == [61, 62, 91, 92]
        left = plan.split("BatchScan")[0]  # what Spark still filters itself
        assert "iline#" not in left.split("Filter")[-1] or ">=" not in left, plan
    finally:
        spark.conf.set(name, before)


def test_a_code_that_cannot_be_read_is_an_error(spark, survey, tmp_path):
    data = bytearray((tmp_path / "s" / "b.sgy").read_bytes())
    data[3224:3226] = (4).to_bytes(2, "big")
    (tmp_path / "c.sgy").write_bytes(data)
    with pytest.raises(Exception, match="code 4"):
        read_segy(spark, str(tmp_path / "c.sgy")).count()


def grid_of(spark):
    grid = c.box_grid(spark, (7, 4, 5), (10, 20, 1000), (5, 6, 7), rotation=30).withColumn("actnum", F.when(F.expr("i = 2 and k = 1"), 0).otherwise(1))
    return grid.withColumns({f"c{n}z": F.col(f"c{n}z") + F.when(F.col("i") > 3, 8.0).otherwise(0.0) for n in range(8)})


@pytest.mark.parametrize("split", [1 << 26, 700, 90])
def test_roff_in_ranges_is_the_whole(spark, tmp_path, split):
    want = grid_of(spark).toPandas().sort_values(c.IJK, ignore_index=True)
    (tmp_path / "g.roff").write_bytes(roff.roff_grid_bytes(want, [2, 3]))
    out = roff.read_roff_grid(spark, str(tmp_path / "g.roff"), columns=2, split=split)
    got = out.toPandas().sort_values(c.IJK, ignore_index=True)
    assert split > 1000 or out.rdd.getNumPartitions() > 5
    assert got[["i", "j", "k", "actnum"]].equals(want[["i", "j", "k", "actnum"]]) and np.allclose(got[c.CORNERS], want[c.CORNERS], atol=1e-3) and set(got.subgrid) == {1, 2}
    some = roff.read_roff_grid(spark, str(tmp_path / "g.roff"), fields=["k", "c0z"], split=split).toPandas()
    assert list(some.columns) == ["k", "c0z"] and len(some) == 140
    values = want[c.IJK].assign(value=np.where(want.k == 2, np.nan, want.i * 100.0 + want.j * 10 + want.k))
    (tmp_path / "p.roff").write_bytes(roff.roff_property_bytes(values, "PORO"))
    rows = roff.read_roff_property(spark, str(tmp_path / "p.roff"), split=split).collect()
    assert {(r.i, r.j, r.k, r.value) for r in rows} == {(r.i, r.j, r.k, None if r.k == 2 else r.value) for r in values.itertuples()} and len(rows) == 140


def test_a_layer_of_a_property(spark, tmp_path):
    values = grid_of(spark).select(*c.IJK).toPandas().assign(value=1.0)
    (tmp_path / "p.roff").write_bytes(roff.roff_property_bytes(values, "PORO"))
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        out = roff.read_roff_property(spark, str(tmp_path / "p.roff"), ["PORO"], split=100).where("k = 3 and i >= 6")
        assert {(r.i, r.k) for r in out.collect()} == {(6, 3), (7, 3)} and out.count() == 8
    finally:
        spark.conf.set(name, before)


def test_tasks_write_files_and_a_failed_job_leaves_none(spark, tmp_path):
    folder = tmp_path / "out"
    files = spark.range(40).repartition(6).select(F.concat(F.lit("f/"), F.col("id").cast("string")).alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    assert splits.save_files(files, f"file://{folder}", suffix=".bin") == 40
    assert {p.name: p.read_bytes() for p in folder.iterdir()} == {f"f_{n}.bin": str(n).encode() for n in range(40)}
    broken = files.withColumn("content", F.when(F.col("name") == "f/33", F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.lit(b"new")))
    with pytest.raises(Exception, match="broken"):
        splits.save_files(broken, str(folder), suffix=".bin")
    assert {p.name: p.read_bytes() for p in folder.iterdir()} == {f"f_{n}.bin": str(n).encode() for n in range(40)}
    with pytest.raises(Exception, match="one file name"):
        splits.save_files(files.withColumn("name", F.lit("same")), str(tmp_path / "other"))
    assert not (tmp_path / "other" / "same").exists() and not any((tmp_path / "other").iterdir())


def test_segy_lines_maps_and_grids_are_written_by_tasks(spark, survey, tmp_path):
    folder, traces = survey
    table = spark.createDataFrame(traces.assign(amp=traces.amp.map(lambda a: [float(x) for x in a])), "iline int, xline int, x double, y double, traceid int, amp array<float>")
    assert binary.save_files(segy_files(table, 4.0, 1000.0), str(tmp_path / "lines")) == 20
    back = read_segy(spark, str(tmp_path / "lines")).select("iline", "xline", "x", "amp").orderBy("iline", "xline").collect()
    assert [(r.iline, r.xline, r.x, list(np.float32(r.amp))) for r in back] == [(t.iline, t.xline, t.x, list(t.amp)) for t in traces.itertuples()]
    nodes = spark.createDataFrame([(f"m{n}", i, j, float(n + i)) for n in range(5) for i in (1, 2) for j in (1, 2)], "name string, i int, j int, value double")
    assert binary.save_files(binary.map_files(nodes, MapHeader(2, 2)), str(tmp_path / "maps"), suffix=".gri") == 5
    grids = spark.range(3).select(F.concat(F.lit("g"), F.col("id")).alias("name")).crossJoin(grid_of(spark))
    own = roff.roff_grid_files(grids)
    assert binary.save_files(own, str(tmp_path / "grids"), suffix=".roff") == 3
    assert roff.read_roff_grid(spark, str(tmp_path / "grids")).count() == 3 * 140
