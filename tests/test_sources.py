"""Round trips of the formats, and hand-written files."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraspan.functions.geometry import MapHeader
from terraspan.sources import binary, tables

MAP = MapHeader(6, 4, 1000.0, 2000.0, 25.0, 20.0, 30.0, -1)
WELL = """1.0
Unknown
31/2-G-5 AH 123.5 456.25 20.0
3
Zonelog DISC 1 One 2 Two 3 Three
Poro UNK lin
Facies DISC 0 Sand 1 Shale
0 0 1000 -999 -999 -999
1 2 1001 1 0.25 0
1.5 2.5 1002.5 2 0.5 1
"""


def put(tmp_path, name, text):
    (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return f"file://{tmp_path}/{name}"


def test_rms_well_text(spark, tmp_path):
    heads, types, samples = tables.read_wells_rms(spark, put(tmp_path, "a.rmswell", WELL))
    assert [tuple(r) for r in heads.collect()] == [("31/2-G-5 AH", 123.5, 456.25, 20.0)]
    assert {r.log: r.type for r in types.collect()} == {"Zonelog": "DISC", "Poro": "CONT", "Facies": "DISC"}
    assert {r.log: {c.code: c.name for c in r.codes} for r in types.where("type = 'DISC'").collect()}["Zonelog"] == {1: "One", 2: "Two", 3: "Three"}
    own = tables.log(tables.log(samples, types, "Zonelog"), types, "Poro").orderBy("seq")
    assert [(r.seq, r.x, r.z, r.Zonelog, r.Poro) for r in own.collect()] == [(1, 0, 1000, None, None), (2, 1, 1001, 1, 0.25), (3, 1.5, 1002.5, 2, 0.5)]
    wide = own.withColumn("Zonelog", F.col("Zonelog").cast("int")).drop("logs")
    lines = [r.value for r in tables.wells_rms_lines(wide, heads, {"Zonelog": {1: "One", 2: "Two", 3: "Three"}, "Poro": None}).orderBy("n").collect()]
    again = tables.read_wells_rms(spark, put(tmp_path, "b.rmswell", "\n".join(lines)))
    assert [r.logs for r in again[2].orderBy("seq").collect()] == [[None, None], [1, 0.25], [2, 0.5]]


def test_rms_well_without_rkb(spark, tmp_path):
    heads, _, samples = tables.read_wells_rms(spark, put(tmp_path, "a.w", "1.0\nx\nOP_1 1.0 2.0\n1\nPoro\n1 2 3 0.5\n"))
    assert tuple(heads.first()) == ("OP_1", 1.0, 2.0, 0.0) and samples.first().logs == [0.5]


def test_wells_csv(spark, tmp_path):
    path = put(tmp_path, "w.csv", "X_UTME,Y_UTMN,Z_TVDSS,PHIT,WELLNAME\n1,2,3,0.1,A\n4,5,6,,A\n7,8,9,0.3,B\n")
    own = tables.read_wells_csv(spark, path)
    assert [tuple(r) for r in own.orderBy("well", "seq").collect()] == [("A", 1, 1.0, 2.0, 3.0, 0.1), ("A", 2, 4.0, 5.0, 6.0, None), ("B", 1, 7.0, 8.0, 9.0, 0.3)]
    tables.write_wells_csv(own, f"file://{tmp_path}/out")
    assert tables.read_wells_csv(spark, f"file://{tmp_path}/out", logs=["PHIT"], order="seq").count() == 3


def test_xyz_polylines(spark, tmp_path):
    path = put(tmp_path, "p.pol", "1 2 3\n4 5 6\n999.0 999.0 999.0\n7 8 9\n999.000000 999.000000 999.000000\n")
    own = tables.read_points(spark, path, "xyz", polygons=True)
    assert [tuple(r)[1:] for r in own.orderBy("poly_id", "seq").collect()] == [(0, 0, 1, 2, 3), (0, 1, 4, 5, 6), (1, 0, 7, 8, 9)]
    assert tables.read_points(spark, path, "xyz").count() == 3
    tables.write_points(own, f"file://{tmp_path}/out", "xyz")
    assert sorted(tuple(r)[1:] for r in tables.read_points(spark, f"file://{tmp_path}/out", "xyz", polygons=True).collect())[0][2:] == (1, 2, 3)


def test_csv_and_parquet_by_position(spark, tmp_path):
    path = put(tmp_path, "p.csv", "# a comment\nEast,North,Depth,ID,Name\n1,2,3,7,a\n4,5,6,8,b\n")
    own = tables.read_points(spark, path, "csv", polygons=True)
    assert own.columns == ["x", "y", "z", "poly_id", "Name"] and own.count() == 2
    points = spark.createDataFrame([(1.0, 2.0, None, "a"), (3.0, 4.0, 5.0, "b")], "x double, y double, z double, attr string")
    tables.write_points(points, f"file://{tmp_path}/c", "csv", ["attr"], {"attr": ["a"]})
    assert [tuple(r) for r in tables.read_points(spark, f"file://{tmp_path}/c", "csv").collect()] == [(1.0, 2.0, 999.0, "a")]
    tables.write_points(points, f"file://{tmp_path}/q", "parquet", ["attr"])
    assert tables.read_points(spark, f"file://{tmp_path}/q", "parquet").where("z is null").count() == 1


def test_zmap_points_and_attributes(spark, tmp_path):
    path = put(tmp_path, "z.zmap", "!\n! File\n@FREE POINT , DATA, 80, 1\nX (EASTING) , 1, 1, 1, 1, 20,, 1.0E+30,,, 4, 0\n@\n 1.5 2.5 3.5 0\n 4 5 1.0E30 1\n")
    assert [(r.x, r.y, r.z, r.poly_id) for r in tables.read_points(spark, path, "zmap").orderBy("seq").collect()] == [(1.5, 2.5, 3.5, 0), (4, 5, None, 1)]
    path = put(tmp_path, "r.rmsattr", "Discrete  FaultBlock\nString  Tag\n1 2 3 7 foo\n4 5 6 UNDEF bar\n")
    assert [r.attributes for r in tables.read_points(spark, path, "rms_attr").orderBy("n").collect()] == [{"FaultBlock": "7", "Tag": "foo"}, {"FaultBlock": None, "Tag": "bar"}]


def test_well_picks(spark):
    picks = spark.createDataFrame([("Top", "A 1", 1.0, 2.0, 3.0, 10.5)], "h string, w string, x double, y double, z double, md double")
    assert tables.wellpick_lines(picks, "h", "w", "md").first()[0] == '"Top" "A 1" 10.500000'
    assert tables.wellpick_lines(picks, "h", "w").first()[0] == '"Top" "A 1" 1.000000 2.000000 3.000000'


def test_tsurf(spark, tmp_path):
    vertices = spark.createDataFrame([(k, float(k % 2), float(k // 2), 5.0 + k) for k in range(4)], "vid long, x double, y double, z double")
    triangles = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 3, 2)], "tid long, v0 long, v1 long, v2 long")
    text = "\n".join(r.value for r in tables.tsurf_lines(vertices, triangles, "F1").orderBy("part", "n").collect())
    v, t = tables.read_tsurf(spark, put(tmp_path, "a.ts", text))
    assert sorted(tuple(r)[1:] for r in v.collect()) == sorted(tuple(r) for r in vertices.collect())
    assert sorted(tuple(r)[1:] for r in t.collect()) == sorted(tuple(r) for r in triangles.collect())


def test_grdecl(spark, tmp_path):
    path = put(tmp_path, "g.grdecl", "-- a comment\nSPECGRID\n 2 3 1 1 F /\n\nPORO\n 2*0.25 0.5 -- more\n 3*0.125 /\nACTNUM\n 6*1\n/\n")
    out = tables.with_ijk(tables.read_grdecl(spark, path, ["PORO", "ACTNUM"]), 2, 3).orderBy("keyword", "pos").collect()
    assert [r.value for r in out if r.keyword == "PORO"] == [0.25, 0.25, 0.5, 0.125, 0.125, 0.125]
    assert [r.value for r in out if r.keyword == "ACTNUM"] == [1.0] * 6 and [(r.i, r.j, r.k) for r in out[:3]] == [(1, 1, 1), (2, 1, 1), (1, 2, 1)]


@pytest.mark.parametrize(("file_format", "header"), [("irap_binary", MAP), ("irap_ascii", MAP), ("zmap", MapHeader(6, 4, 1000.0, 2000.0, 25.0, 20.0))])
def test_map_files(spark, tmp_path, file_format, header):
    nodes = spark.createDataFrame([(f"m{n}", i, j, float(100 * n + 10 * i + j)) for n in range(3) for i in range(1, 7) for j in range(1, 5) if (i, j) != (2, 3)], "name string, i int, j int, value double")
    assert binary.save_files(binary.map_files(nodes, header, file_format), str(tmp_path), suffix=".bin") == 3
    heads, back = binary.read_maps(spark, f"file://{tmp_path}/*.bin", file_format)
    row = heads.first()
    assert all(abs(float(row[k]) - float(v)) < 1e-4 for k, v in vars(header).items())
    got = {(r.file[-6:-4], r.i, r.j): r.value for r in back.collect()}
    assert got == {(r.name, r.i, r.j): r.value for r in nodes.collect()}
    assert tables.guess_format("x", (tmp_path / "m0.bin").read_bytes()[:128]) == file_format


def test_segy(spark, tmp_path):
    r = np.random.default_rng(0)
    traces = pd.DataFrame([{"iline": 1 + k // 3, "xline": 10 + k % 3, "x": 100.25 * k, "y": 50.5, "traceid": 1 + (k == 4), "amp": r.normal(size=20).astype(np.float32)} for k in range(6)])
    out = binary.read_segy(spark, put(tmp_path, "a.sgy", binary.segy_bytes(traces, 4.0, 1000))).orderBy("n").collect()
    assert [(x.iline, x.xline, x.x, x.traceid, x.dz, x.z0) for x in out] == [(a.iline, a.xline, a.x, a.traceid, 4.0, 1000.0) for a in traces.itertuples()]
    assert all(np.array_equal(np.array(x.amp, np.float32), a.amp) for x, a in zip(out, traces.itertuples(), strict=True))


def test_ibm_floats():
    assert np.allclose(binary.ibm_floats(np.array([0x42640000, 0xC276A000, 0x00000000, 0x40800000], np.int64)), [100.0, -118.625, 0.0, 0.5])


def test_simulator_files(spark, tmp_path):
    from terraspan.operators import cells as c
    from terraspan.sources import simulator as sim

    grid = c.box_grid(spark, (3, 2, 2), (10, 20, 1000), (5, 6, 7), rotation=30).withColumn("actnum", F.when(F.expr("i = 2 and k = 1"), 0).otherwise(1))
    arrays = {k: [r.value for r in sim.corner_arrays(grid, 3, 2).where(F.col("keyword") == k).orderBy("pos").collect()] for k in ("COORD", "ZCORN", "ACTNUM")}
    assert {k: len(v) for k, v in arrays.items()} == {"COORD": 72, "ZCORN": 96, "ACTNUM": 12}
    data = sim.record_bytes("GRIDHEAD", "INTE", [1, 3, 2, 2]) + b"".join(sim.record_bytes(k, "INTE" if k == "ACTNUM" else "DOUB", v) for k, v in arrays.items())
    records = sim.read_records(spark, put(tmp_path, "a.egrid", data))
    assert [(r.keyword, r["count"]) for r in sim.catalog(records).orderBy("n").collect()] == [("GRIDHEAD", 4), ("COORD", 72), ("ZCORN", 96), ("ACTNUM", 12)]
    back = sim.corner_grid(sim.values(records, ["COORD", "ZCORN", "ACTNUM"]), 3, 2, 2)
    key = lambda d: {(r.i, r.j, r.k): [r.actnum, *(round(r[x], 6) for x in c.CORNERS)] for r in d.collect()}
    assert key(back) == key(grid)
    text = "\n".join(r.value for k, digits in (("COORD", 9), ("ZCORN", 9), ("ACTNUM", None)) for r in sim.grdecl_lines(sim.corner_arrays(grid, 3, 2), k, digits=digits).orderBy("n").collect())
    assert key(sim.corner_grid(tables.read_grdecl(spark, put(tmp_path, "a.grdecl", text), ["COORD", "ZCORN", "ACTNUM"]), 3, 2, 2)) == key(grid)


def test_restart_files(spark, tmp_path):
    from terraspan.operators import cells as c
    from terraspan.sources import simulator as sim

    grid = c.box_grid(spark, (2, 2, 2)).withColumn("actnum", F.when(F.expr("i = 1 and j = 1 and k = 1"), 0).otherwise(1))
    data = b""
    for n, day in enumerate((1, 15)):
        head = [0] * 95
        head[64:67] = [day, 6, 2021]
        data += sim.record_bytes("SEQNUM", "INTE", [n]) + sim.record_bytes("INTEHEAD", "INTE", head) + sim.record_bytes("NAMES", "CHAR", ["OP_1", "OP_2"]) + sim.record_bytes("STARTSOL", "MESS", [])
        data += sim.record_bytes("SWAT", "REAL", [0.25 + n * 0.125] * 7) + sim.record_bytes("PRESSURE", "REAL", np.arange(7) + 100 * n)
    records = sim.read_records(spark, put(tmp_path, "a.unrst", data), ["INTEHEAD", "SWAT", "PRESSURE"])
    assert sorted({str(r.date) for r in sim.catalog(records).collect()}) == ["2021-06-01", "2021-06-15"]
    last = sim.scatter(sim.with_remainder(sim.values(records, ["SWAT", "PRESSURE"], "last")), grid)
    got = {(r.keyword, r.i, r.j, r.k): r.value for r in last.collect()}
    assert len(got) == 21 and got["PRESSURE", 2, 1, 1] == 100 and got["PRESSURE", 1, 1, 2] == 103 and got["SWAT", 2, 2, 2] == 0.375 and got["SOIL", 2, 2, 2] == 0.625
    assert sim.values(records, ["SWAT"], ["2021-06-01"]).agg(F.max("value")).first()[0] == 0.25


def test_gxf_round_trip(spark, tmp_path):
    header = MapHeader(4, 3, 100.0, 200.0, 10.0, 20.0, 30.0, -1)
    nodes = spark.createDataFrame([("m", i, j, float(10 * i + j)) for i in range(1, 5) for j in range(1, 4) if (i, j) != (2, 2)], "name string, i int, j int, value double")
    content = binary.map_files(nodes, header, "gxf").first()["content"]
    (tmp_path / "m.gxf").write_bytes(b"## made by a test\n" + bytes(content))
    heads, got = binary.read_maps(spark, str(tmp_path / "m.gxf"), "gxf")
    r = heads.first()
    assert (r.ncol, r.nrow, r.xori, r.yori, r.xinc, r.yinc, r.rotation, r.yflip) == (4, 3, 100.0, 200.0, 10.0, 20.0, 30.0, -1)
    assert {(r.i, r.j, r.value) for r in got.collect()} == {(r.i, r.j, r.value) for r in nodes.collect()}


def test_ijxyz_round_trip(spark, tmp_path):
    for flip in (1, -1):
        header = MapHeader(5, 4, 1000.0, 2000.0, 25.0, 12.5, 40.0, flip)
        nodes = spark.createDataFrame([(i, j, float(i * j)) for i in range(1, 6) for j in range(1, 5) if (i, j) != (3, 2)], "i int, j int, value double")
        lines = spark.createDataFrame([(i, j, 100 + 2 * i, 7 + 3 * j) for i in range(1, 6) for j in range(1, 5)], "i int, j int, iline int, xline int")
        path = str(tmp_path / f"map{flip}")
        binary.ijxyz_lines(nodes, header, lines).coalesce(1).write.text(path)
        found, got, kept = binary.read_ijxyz(spark, path)
        assert (found.ncol, found.nrow, found.yflip) == (5, 4, flip) and all(abs(getattr(found, c) - getattr(header, c)) < 1e-3 for c in ("xori", "yori", "xinc", "yinc", "rotation"))
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in nodes.collect()}
        assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in lines.collect() if (r.i, r.j) != (3, 2)}


def test_points_of_a_list_and_random_ones(spark):
    assert [tuple(r) for r in tables.points_from_list(spark, [(1.0, 2.0, 3.0, 9.0)], ["a"]).collect()] == [(1.0, 2.0, 3.0, 9.0)]
    out = tables.random_points(spark, 50, 3, 10.0).collect()
    assert len({(r.x, r.y, r.z) for r in out}) == 50 and all(0 <= v < 10 for r in out for v in (r.x, r.y, r.z))
