"""Grid files written in pieces, dual porosity, and merged grids with their gap filled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.operators import cells as c
from terraspan.sources import roff, simulator as sim, splits


def faulted(spark):
    """Slanted pillars, a fault, and layers that a pillar's columns have at depths of their own."""
    grid = c.box_grid(spark, (4, 3, 5), (10, 20, 1000), (5, 6, 7), rotation=30).withColumn("actnum", F.when(F.expr("i = 2 and k = 1"), 0).otherwise(1))
    down = grid.withColumns({f"c{n}z": F.col(f"c{n}z") + F.when(F.col("i") > 2, 4.5).otherwise(0.0) for n in range(8)})
    return down.withColumns({f"c{n}x": F.col(f"c{n}x") + 0.25 * (F.col(f"c{n}z") - 1000) for n in range(8)})


def by_cell(cells):
    return {(r.i, r.j, r.k): [r.actnum, *(r[x] for x in c.CORNERS)] for r in cells.collect()}


@pytest.mark.parametrize("together", [100_000, 1000])
def test_egrid_round_trip_with_a_fault(spark, tmp_path, monkeypatch, together):
    monkeypatch.setattr(sim, "TOGETHER", together)
    grid = faulted(spark)
    parts = sim.egrid_parts(grid, 4, 3, 5).withColumn("name", F.lit("a"))
    splits.save_parts(parts, str(tmp_path), suffix=".EGRID")
    records = sim.read_records(spark, str(tmp_path / "a.EGRID"))
    heads = [(r.keyword, r["count"]) for r in sim.catalog(records).orderBy("n").collect()]
    assert heads == [("FILEHEAD", 100), ("GRIDUNIT", 2), ("GRIDHEAD", 100), ("COORD", 120), ("ZCORN", 480), ("ACTNUM", 60), ("ENDGRID", 0)]
    assert [int(x) for x in records.where("keyword = 'GRIDHEAD'").first().numbers[:4]] == [1, 4, 3, 5]
    back, want = by_cell(sim.corner_grid(sim.values(records, ["COORD", "ZCORN", "ACTNUM"]), 4, 3, 5)), by_cell(grid)
    assert back.keys() == want.keys() and all(np.allclose(back[k], v, atol=1e-3) for k, v in want.items())


def test_dual_porosity_values_of_both_media(spark, tmp_path):
    codes = {(1, 1, 1): 0, (2, 1, 1): 1, (1, 2, 1): 2}
    grid = c.box_grid(spark, (2, 2, 2)).drop("actnum").join(spark.createDataFrame([(*k, v) for k, v in codes.items()], "i int, j int, k int, actnum int"), c.IJK, "left").fillna(3, ["actnum"])
    active = {m: [(i, j, k) for k in (1, 2) for j in (1, 2) for i in (1, 2) if codes.get((i, j, k), 3) in own] for m, own in sim.MEDIA.items()}
    order = {(r.medium, r.i, r.j, r.k): r.pos for r in sim.dual_order(grid).collect()}
    assert order == {(m, *x): n for n, (m, x) in enumerate((m, x) for m in ("matrix", "fracture") for x in active[m])} and len(order) == 12
    head = [0] * 95
    head[64:67] = [1, 6, 2021]
    data = sim.record_bytes("SEQNUM", "INTE", [1]) + sim.record_bytes("INTEHEAD", "INTE", head)
    data += sim.record_bytes("SWAT", "REAL", np.arange(12) / 16) + sim.record_bytes("PORV", "REAL", np.arange(16) + 100)
    (tmp_path / "a.unrst").write_bytes(data)
    (tmp_path / "b.init").write_bytes(sim.record_bytes("PORO", "REAL", np.arange(12) / 8))
    found = sim.values(sim.read_records(spark, str(tmp_path / "a.unrst")), ["SWAT", "PORV"]).unionByName(sim.values(sim.read_records(spark, str(tmp_path / "b.init")), ["PORO"]))
    out = {(r.keyword, r.medium, r.i, r.j, r.k): r.value for r in sim.scatter_dual(found, grid, 2, 2, 2).collect()}
    cell = lambda i, j, k: (k - 1) * 4 + (j - 1) * 2 + i - 1
    want = {("SWAT", *k): n / 16 for k, n in order.items()} | {("PORO", *k): n / 8 for k, n in order.items()}
    want |= {("PORV", m, *x): 100 + cell(*x) + (8 if m == "fracture" else 0) for m in active for x in active[m]}
    assert out == want
    again = sim.dual_arrays(spark.createDataFrame([(k[0], *k[1:], v) for k, v in want.items() if k[0] == "SWAT"], "keyword string, medium string, i int, j int, k int, value double"), grid)
    assert {r.pos: r.value for r in again.collect()} == {n: n / 16 for n in range(12)}
    parts = sim.egrid_parts(grid, 2, 2, 2, dual=True).withColumn("name", F.lit("d"))
    splits.save_parts(parts, str(tmp_path), suffix=".EGRID")
    records = sim.read_records(spark, str(tmp_path / "d.EGRID"))
    assert records.where("keyword = 'FILEHEAD'").first().numbers[5] == 1
    back = sim.corner_grid(sim.values(records, ["COORD", "ZCORN", "ACTNUM"]), 2, 2, 2)
    assert {(r.i, r.j, r.k): r.actnum for r in back.collect()} == {(r.i, r.j, r.k): r.actnum for r in grid.collect()}


def test_merged_grids_are_filled_to_a_box(spark, tmp_path):
    a = c.box_grid(spark, (3, 4, 2), (0, 0, 1000), (100, 100, 10)).withColumn("poro", F.lit(0.25))
    b = c.box_grid(spark, (2, 6, 3), (700, 0, 1100), (100, 100, 5))
    out = c.rectangular(c.merge(a, b, 3), (6, 6, 3))
    rows = {(r.i, r.j, r.k): r for r in out.collect()}
    assert set(rows) == {(i, j, k) for i in range(1, 7) for j in range(1, 7) for k in range(1, 4)} and out.count() == 108
    assert sum(r.actnum for r in rows.values()) == 3 * 4 * 2 + 2 * 6 * 3 and all(r.poro == 0.25 for k, r in rows.items() if k[0] < 4 and k[1] < 5 and k[2] < 3)
    gap = rows[4, 2, 1]  # between the last pillars of a and the first of b
    assert gap.actnum == 0 and (gap.c0x, gap.c0z, gap.c4z, gap.c1x, gap.c1z, gap.c5z) == (300.0, 1000.0, 1010.0, 700.0, 1100.0, 1105.0)
    below = rows[2, 2, 3]  # a layer that a doesn't have
    assert below.actnum == 0 and {below[f"c{n}z"] for n in range(8)} == {1020.0} and (below.c0x, below.c6x) == (100.0, 200.0)
    far = rows[1, 6, 1]  # rows that a doesn't have: as its nearest pillars
    assert far.actnum == 0 and (far.c0x, far.c0y, far.c3y, far.c0z) == (0.0, 400.0, 400.0, 1000.0)
    cells = out.toPandas()
    (tmp_path / "m.roff").write_bytes(roff.roff_grid_bytes(cells))
    back = roff.read_roff_grid(spark, str(tmp_path / "m.roff"))
    assert back.count() == 108 and back.agg(F.sum("actnum")).first()[0] == 60


def test_layers_between_mapped_ones_are_closed(spark):
    a = c.box_grid(spark, (1, 1, 2), (0, 0, 1000), (100, 100, 10))
    b = c.box_grid(spark, (1, 1, 4), (200, 0, 1000), (100, 100, 10))
    out = c.rectangular(c.merge(a, b, 1, layers_a=[1, 4]), (3, 1, 4))
    own = {(r.i, r.k): (r.actnum, r.c0z, r.c4z) for r in out.collect()}
    assert [own[1, k] for k in (1, 2, 3, 4)] == [(1, 1000, 1010), (0, 1010, 1010), (0, 1010, 1010), (1, 1010, 1020)]
