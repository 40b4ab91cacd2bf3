"""Many wells and points at one place: work is dealt out, and every pair counts once."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from terraspan.operators import cells, polygons, wells
from terraspan.operators.rounds import shared_folder


def crowd(spark, n=150, spread=2500):
    """Wells of 2 to 6 samples in eighths, most of them around one place; one more has no name."""
    rnd, rows = random.Random(4), []
    for k in range(n):
        x, y = (rnd.randrange(0, 8 * spread) / 8 for _ in "xy") if k % 3 == 0 else (rnd.randrange(0, 800) / 8 for _ in "xy")
        for seq in range(1, rnd.randrange(3, 8)):
            rows.append((f"W{k:03d}" if k else None, seq, x, y, 1000.0 + seq, 10.0 * seq))
            x, y = x + rnd.randrange(-400, 400) / 8, y + rnd.randrange(-400, 400) / 8
    return rows, spark.createDataFrame(rows, "well string, seq int, x double, y double, z double, md double")


@pytest.mark.parametrize("block", [7, 2048])
def test_overlapping_boxes_in_blocks(spark, block):
    rows, samples = crowd(spark)
    boxes = {}
    for w, _, x, y, *_ in rows:
        if w:
            a = boxes.get(w, (x, x, y, y))
            boxes[w] = (min(a[0], x), max(a[1], x), min(a[2], y), max(a[3], y))
    meet = lambda a, b: a[0] <= b[1] and b[0] <= a[1] and a[2] <= b[3] and b[2] <= a[3]
    want = sorted((p, q) for p in boxes for q in boxes if p < q and meet(boxes[p], boxes[q]))
    assert sorted(map(tuple, wells.may_overlap(samples, 300.0, block).collect())) == want and len(want) > 1000


def close(rows, distance):
    """The least id that each of rows (pid, x, y, z) reaches."""
    least = {r[0]: r[0] for r in rows}
    known = [r for r in rows if r[1] is not None and abs(r[1]) < float("inf")]
    for first in sorted(known):
        if least[first[0]] != first[0]:
            continue
        todo = [first]
        while todo:
            _, x, y, _ = todo.pop()
            for q in known:
                if least[q[0]] == q[0] and q[0] > first[0] and (q[1] - x) ** 2 + (q[2] - y) ** 2 <= distance * distance:
                    least[q[0]] = first[0]
                    todo.append(q)
    return least


def test_clusters_of_crowded_points(spark):
    rnd = random.Random(7)
    rows = [(k, rnd.randrange(0, 300) / 8 * (5 if k % 2 else 1), rnd.randrange(0, 300) / 8 * (5 if k % 3 else 1), k / 8) for k in rnd.sample(range(1000), 220)]
    rows += [(1000, None, 1.0, 0.0), (1001, float("inf"), 1.0, 0.0), (1002, float("nan"), 0.0, 0.0)]
    points = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    for distance in (1.0, 3.0, 6.5):
        want = close(rows, distance)
        assert {r.pid: r.cluster for r in polygons.clusters(points, distance).collect()} == want and 20 < len(set(want.values())) < 220


@pytest.mark.parametrize("method", ["average", "min_z"])
def test_copies_of_a_place_are_not_paired(spark, method):
    """3000 points at three places: what is written doesn't grow with their pairs."""
    k = F.col("id")
    points = spark.range(3000).select(k.alias("pid"), (k % 3 * 10.0).alias("x"), F.lit(5.0).alias("y"), (k % 700 * 1.0).alias("z"))
    root = Path(shared_folder(spark).removeprefix("file://"))
    size = lambda: sum(f.stat().st_size for f in root.rglob("*") if f.is_file())
    before = size()
    out = polygons.merge_close(points, 12.0, method).collect()
    assert [(r.cluster, r.n) for r in out] == [(0, 3000)]
    assert size() - before < 1_000_000


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_long_paths_through_cells(spark, broadcast):
    """Segments through many cells at once give what cutting them at the planes of the box grid gives, with and without a broadcast."""
    rnd, dim, origin, step = random.Random(5), (9, 8, 6), (100.0, 200.0, 1000.0), (20.0, 25.0, 5.0)
    rows = [(f"W{w}", seq, rnd.uniform(60, 320), rnd.uniform(160, 440), rnd.uniform(995, 1035), 50.0 * seq) for w in range(6) for seq in range(8)]
    samples = spark.createDataFrame(rows, "well string, seq int, x double, y double, z double, md double")
    grid = cells.box_grid(spark, dim, origin, step)
    order = lambda df: sorted((r.well, r.visit, r.i, r.j, r.k, round(r.md_in, 6), round(r.md_out, 6)) for r in df.collect())
    want = order(cells.trajectory_cells(samples, dim, origin, step))
    assert order(cells.trajectory_in_cells(samples, grid, 37.0, broadcast=broadcast)) == want and len(want) > 200


@pytest.mark.parametrize("block", [5, 4096])
def test_crossings_in_blocks(spark, block):
    """Each crossing of a crowd has its two rows, whatever the blocks."""
    rows, samples = crowd(spark, 40)
    seg = [(p, q) for p, q in zip(rows, rows[1:], strict=False) if p[0] == q[0] and p[0]]
    want = []
    for p, q in seg:
        for u, v in seg:
            rx, ry, sx, sy, qx, qy = q[2] - p[2], q[3] - p[3], v[2] - u[2], v[3] - u[3], u[2] - p[2], u[3] - p[3]
            det = rx * sy - ry * sx
            if p[0] != u[0] and det and 0 <= (qx * sy - qy * sx) / det < 1 and 0 <= (qx * ry - qy * rx) / det < 1:
                want.append((p[0], p[1], u[0]))
    got = wells.intersections(samples, tile=40.0, block=block, blocks=6).collect()
    assert sorted((r.well, r.seq, r.other) for r in got) == sorted(want) and len(want) > 100
