"""Cubes sliced along maps of any geometry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.functions.geometry import MapHeader
from terraspan.operators import cubes
from terraspan.operators import surfaces as s

CUBE = cubes.CubeHeader(MapHeader(9, 8, 100.0, 200.0, 20.0, 25.0, 15.0), 30, 1000.0, 4.0)


@pytest.fixture(scope="module")
def traces(spark):
    """Amplitudes that are linear in x, y and z; one dead trace."""
    own = cubes.trace_xy(s.lattice(spark, CUBE.map), CUBE)
    k = F.sequence(F.lit(0), F.lit(29))
    return own.withColumns({"amp": F.transform(k, lambda n: (F.col("x") * 0.5 - F.col("y") + n * 4.0).cast("double")), "traceid": F.when(F.expr("i = 3 and j = 3"), 2).otherwise(1)}).select("i", "j", "traceid", "amp")


def flat(spark, header, z):
    return s.constant(spark, header, z)


def test_a_map_of_the_cubes_geometry_is_sliced_as_before(spark, traces):
    nodes = s.lattice(spark, CUBE.map).withColumn("value", 1005.0 + F.col("i") * 3 + F.col("j") * 2.5)
    values = lambda out: {(r.i, r.j): r.value for r in out.collect() if r.value is not None}
    for method, old in (("nearest", "nearest"), ("trilinear", "linear")):
        want = values(cubes.slice_surface(traces, CUBE, nodes, old))
        for through in ("nodes", "traces"):
            got = values(cubes.slice_map(traces, CUBE, nodes, CUBE.map, method, through=through))
            keep = [k for k in want if k not in got]
            # between traces a dead neighbour counts
            assert not keep or (method, through) == ("trilinear", "nodes"), keep
            assert all(got[k] == pytest.approx(want[k]) for k in got) and len(got) > 60


@pytest.mark.parametrize("through", ["nodes", "traces"])
def test_linear_cubes_are_met_between_traces(spark, traces, through):
    turned = MapHeader(20, 16, 130.0, 215.0, 7.0, 8.0, 40.0)
    out = cubes.slice_map(traces, CUBE, flat(spark, turned, 1050.0), turned, "trilinear", dead=False, through=through).where("value is not null").collect()
    assert len(out) > 150
    for r in out:
        x, y = turned.at(r.i, r.j)
        assert r.value == pytest.approx(0.5 * x - y + 50.0)


def test_windows_around_and_between_maps_of_another_geometry(spark, traces):
    turned = MapHeader(12, 10, 140.0, 225.0, 8.0, 9.0, 40.0)
    live = traces.withColumn("traceid", F.lit(1))
    upper, lower = flat(spark, turned, 1040.0), flat(spark, turned, 1060.0)
    wide = MapHeader(40, 40, -50.0, 100.0, 12.0, 12.0, 5.0)  # covers the cube
    for header in (wide,):
        up, low = flat(spark, header, 1040.0), flat(spark, header, 1060.0)
        below = cubes.window_map(live, CUBE, up, low, header, ("mean", "max"), "below", 4).collect()
        above = cubes.window_map(live, CUBE, low, up, header, ("mean", "max"), "above", 4).collect()
        around = cubes.window_map(live, CUBE, flat(spark, header, 1050.0), 10.0, header, ("mean", "max"), ndiv=4).collect()
        assert sorted(below) == sorted(above) == sorted(around) and len(below) > 80
        for r in below:
            x, y = header.at(r.i, r.j)
            assert (r.mean, r.max) == pytest.approx((0.5 * x - y + 50.0, 0.5 * x - y + 60.0))
        assert cubes.window_map(live, CUBE, up, low, header, ("mean",), minimum_thickness=25.0).count() == 0
        assert cubes.window_map(live, CUBE, low, up, header, ("mean",)).count() == 0  # the other one isn't below
    with pytest.raises(ValueError):
        cubes.window_map(live, CUBE, upper, lower, turned, other_position="beside")
    with pytest.raises(ValueError):
        cubes.slice_map(live, CUBE, upper, turned, through="air")
    assert np.isfinite([r.mean for r in below]).all()
