"""ROFF grids and properties: round trips, nodes with one to eight depths, and the text form."""

import numpy as np
from pyspark.sql import functions as F

from terraspan.operators import cells as c
from terraspan.sources import roff


def write(path, data):
    path.write_bytes(data)
    return str(path)


def faulted(spark):
    box = c.box_grid(spark, (4, 3, 5), (1000.0, 2000.0, 1500.0), (50.0, 40.0, 10.0), 20.0)
    down = F.when(F.col("i") > 2, 16.0).otherwise(0.0) + 2.0 * F.col("j")
    return box.withColumns({f"c{n}z": F.col(f"c{n}z") + down for n in range(8)} | {"actnum": F.when((F.col("i") + F.col("k")) % 4 == 0, 0).otherwise(1)})


def test_grid_round_trip(spark, tmp_path):
    want = faulted(spark).toPandas().sort_values(c.IJK, ignore_index=True)
    path = write(tmp_path / "g.roff", roff.roff_grid_bytes(want, [2, 3]))
    got = roff.read_roff_grid(spark, path, columns=3).toPandas().sort_values(c.IJK, ignore_index=True)
    assert (got["subgrid"] == np.where(got["k"] <= 2, 1, 2)).all() and (got["actnum"] == want["actnum"]).all()
    for name in (*c.IJK, *c.CORNERS):
        assert np.allclose(got[name], want[name], atol=1e-3)


def test_property_round_trip(spark, tmp_path):
    own = faulted(spark).select(*c.IJK, (F.col("i") * 100 + F.col("j") * 10 + F.col("k")).alias("value")).toPandas().astype({"value": float})
    own.loc[3, "value"] = np.nan
    poro = write(tmp_path / "p.roff", roff.roff_property_bytes(own, "PORO"))
    got = {(r.i, r.j, r.k): (r.name, r.value, r.code) for r in roff.read_roff_property(spark, poro).collect()}
    assert got == {(r.i, r.j, r.k): ("PORO", None if np.isnan(r.value) else r.value, None) for r in own.itertuples()}
    facies = own.assign(value=own["k"] % 2)
    path = write(tmp_path / "f.roff", roff.roff_property_bytes(facies, "FACIES", codes={0: "SHALE", 1: "SAND"}))
    assert {(r.value, r.code) for r in roff.read_roff_property(spark, path, ["FACIES"]).collect()} == {(0.0, "SHALE"), (1.0, "SAND")}
    assert roff.read_roff_property(spark, path, ["OTHER"]).count() == 0


def test_text_form_and_splits(spark, tmp_path):
    """One cell column of two layers: nodes at the middle have two depths, so there is a gap between the layers."""
    middle = "1 2 1 " * 4
    z = " ".join("-20 -11 -9 0" for _ in range(4))
    lines = " ".join(f"{x} {y} -20 {x} {y} 0" for x in (0, 10) for y in (0, 10))
    text = f"""roff-asc #ROFF file#
tag filedata int byteswaptest 1 char filetype "grid" endtag
tag dimensions int nX 1 int nY 1 int nZ 2 endtag
tag scale float xscale 1 float yscale 1 float zscale -1 endtag
tag cornerLines array float data 24 {lines} endtag
tag zvalues array byte splitEnz 12 {middle} array float data 16 {z} endtag
tag active array bool data 2 1 0 endtag tag eof endtag"""
    rows = {r.k: r for r in roff.read_roff_grid(spark, write(tmp_path / "a.roff", text.encode())).collect()}
    tops, bases = ({k: {rows[k][f"c{n}z"] for n in own} for k in (1, 2)} for own in (range(4), range(4, 8)))
    assert tops == {1: {0.0}, 2: {11.0}} and bases == {1: {9.0}, 2: {20.0}}
    assert (rows[1].actnum, rows[2].actnum) == (0, 1) and (rows[1].c2x, rows[1].c2y, rows[1].c1x, rows[1].c1y) == (10.0, 10.0, 10.0, 0.0)
