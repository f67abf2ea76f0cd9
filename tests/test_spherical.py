"""Conservative weights of cells with corners: against random points on the sphere, by conservation, over poles and the date line."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopycna.operators import regrid, spherical
from isopycna.sources import views

SCHEMA = "cell_id long, corners array<struct<lat:double,lon:double>>"
GRID = regrid.Grid(10.0)


def box(south, west, north, east):
    return [(south, west), (south, east), (north, east), (north, west)]


def turned(corners):
    return corners[::-1]


CELLS = [
    (0, box(3.0, 4.0, 17.0, 26.0)),
    (1, turned(box(-33.0, 170.0, -18.0, 195.0))),
    (2, [(71.0, 10.0 + 72 * k) for k in range(5)]),
    (3, turned([(-80.0, 30.0 + 120 * k) for k in range(3)])),
    (4, [(50.0, -5.0), (48.0, 20.0), (66.0, 8.0)]),
    (5, [(50.0, -5.0), (48.0, 20.0), (48.0, 20.0), (66.0, 8.0), (66.0, 8.0)]),
    (6, box(84.0, 0.0, 90.0, 90.0)),
    (7, box(-90.0, 300.0, -70.0, 360.0)),
    (8, box(10.0, 20.0, 20.0, 30.0)),
    (9, box(12.0, 21.0, 12.001, 21.001)),
    (10, [(-5.0, 355.0), (-6.0, 366.0), (4.0, 364.0), (6.0, 357.0), (2.0, 353.0)]),
    (11, box(-20.0, -179.0, 25.0, -10.0)),
]
ODD = [(20, None), (21, []), (22, [(1.0, 2.0), (2.0, 3.0)]), (23, [(1.0, 2.0), None, (2.0, 3.0), (0.0, 3.0)]), (24, [(1.0, None), (2.0, 3.0), (0.0, 3.0)]), (25, [(1.0, float("nan")), (2.0, 3.0), (0.0, 3.0)]), (26, [(5.0, 5.0)] * 4), (27, [(95.0, 5.0), (2.0, 3.0), (0.0, 3.0)])]


def overlaps(spark, cells, grid=GRID):
    rows = spherical.overlaps(spark.createDataFrame(cells, SCHEMA), grid).collect()
    out = {(r.cell_id, r.lat_bin, r.lon_bin): r.overlap for r in rows}
    assert len(out) == len(rows)
    return out, {r.cell_id: r.area for r in rows}


def inside(points, corners):
    """Whether points lie in a convex polygon, by the side of each great circle."""
    v = spherical.unit(*np.array(corners).T)
    v = v[np.r_[True, np.linalg.norm(np.diff(v, axis=0), axis=1) > 1e-12]]
    turn = 1.0 if spherical.areas(v[None])[0] > 0 else -1.0
    return np.all([turn * (points @ np.cross(v[k], v[(k + 1) % len(v)])) >= 0 for k in range(len(v))], axis=0)


def test_areas_of_known_polygons():
    octant = spherical.unit(np.array([0.0, 0, 90]), np.array([0.0, 90, 0]))
    assert spherical.areas(octant[None])[0] == pytest.approx(math.pi / 2, rel=1e-14)
    assert spherical.areas(octant[None, ::-1])[0] == pytest.approx(-math.pi / 2, rel=1e-14)
    tiny = spherical.unit(np.array([10.0, 10, 10.00001, 10.00001]), np.array([5.0, 5.00001, 5.00001, 5.0]))
    assert spherical.areas(tiny[None])[0] == pytest.approx(math.radians(1e-5) ** 2 * math.cos(math.radians(10.000005)), rel=1e-6)


def test_every_cell_is_covered(spark):
    got, own = overlaps(spark, CELLS)
    assert own.keys() == {c for c, _ in CELLS}
    for c in own:
        assert sum(x for k, x in got.items() if k[0] == c) == pytest.approx(own[c], rel=1e-9), c
    # A copy with repeated corners, and a cell that is a target cell itself.
    assert {k[1:]: x for k, x in got.items() if k[0] == 4} == pytest.approx({k[1:]: x for k, x in got.items() if k[0] == 5})
    assert [k[1:] for k in got if k[0] == 8] == [(10, 20)]


def test_against_random_points(spark):
    """Overlaps are the shares of points on the sphere that are in both polygons."""
    dice = np.random.default_rng(7)
    points = dice.normal(size=(400_000, 3))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    got, _ = overlaps(spark, CELLS)
    for c, corners in CELLS:
        if c == 9:
            continue
        near = points[inside(points, corners)]
        mine = {k[1:]: x for k, x in got.items() if k[0] == c}
        for (a, b), area in mine.items():
            south, west = -90.0 + 10 * a, -180.0 + 10 * b
            target = box(south, west, south + 10, west + 10)
            n = inside(near, target).sum()
            expected = area / (4 * math.pi) * len(points)
            assert abs(n - expected) < 5 * math.sqrt(max(expected, 1)) + 1, (c, a, b)
        # Points of the cell are in the targets that were found, and in no others.
        assert abs(len(near) - sum(mine.values()) / (4 * math.pi) * len(points)) < 5 * math.sqrt(len(near)) + 1


@pytest.mark.parametrize("resolution", [10.0, 30.0, 4.5])
def test_targets_tile_the_sphere(spark, resolution):
    grid = regrid.Grid(resolution)
    total = grid.mesh(spark).agg(F.sum(spherical.target_area(grid, F.col("lat_bin")))).first()[0]
    assert total == pytest.approx(4 * math.pi, rel=1e-12)
    octants = [(k, box(0.0, 90.0 * k, 90.0, 90.0 * k + 90.0)) for k in range(4)] + [(4 + k, [(0.0, 90.0 * k + 90.0), (0.0, 90.0 * k), (-90.0, 0.0)]) for k in range(4)]
    w = spherical.conservative(spark.createDataFrame(octants, SCHEMA), grid)
    rows = w.groupBy("lat_bin", "lon_bin").agg(F.sum("w").alias("w")).collect()
    assert len(rows) == grid.n_lat * grid.n_lon and all(r.w == pytest.approx(1.0, abs=1e-9) for r in rows)


def test_odd_cells_have_no_overlaps(spark):
    assert overlaps(spark, ODD)[0] == {}
    assert overlaps(spark, [])[0] == {}
    assert overlaps(spark, ODD + CELLS[:1])[0].keys() == overlaps(spark, CELLS[:1])[0].keys()


def test_applied(spark):
    """Means are over what is there; the integral is kept."""
    w = spherical.conservative(spark.createDataFrame(CELLS, SCHEMA), GRID)
    field = spark.createDataFrame([("A", c, float(c) if c % 4 else None) for c, _ in CELLS], "model string, cell_id long, v double")
    out = spherical.applied(field, w, "v", ("model",)).agg(F.sum(F.col("v") * F.col("overlap")).alias("x")).first().x
    own = overlaps(spark, CELLS)[1]
    assert out == pytest.approx(sum(c * own[c] for c in own if c % 4), rel=1e-9)
    everywhere = spherical.applied(field.withColumn("v", F.lit(3.0)), w, "v", ("model",)).collect()
    assert all(r.v == pytest.approx(3.0) and 0 < r.covered for r in everywhere)


def test_stored_weights_are_taken_again(spark, tmp_path):
    cells = spark.createDataFrame(CELLS, SCHEMA)
    first, there = spherical.stored(cells, GRID, f"{tmp_path}/w", 4)
    again, there_again = spherical.stored(cells.repartition(3), GRID, f"{tmp_path}/w", 4)
    other, changed = spherical.stored(cells.where("cell_id < 5"), GRID, f"{tmp_path}/w", 4)
    assert (there, there_again, changed) == (False, True, False)
    rows = lambda t: sorted(map(repr, t.collect()))
    assert rows(first) == rows(again) and 0 < other.count() < first.count()
    assert len(list((tmp_path / "w").iterdir())) == 2
    # The join takes the stored side where it lies: only the field is exchanged.
    field = spark.createDataFrame([("A", c, 1.0) for c, _ in CELLS], "model string, cell_id long, v double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = field.join(again, "cell_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_corners_of_the_tables(spark):
    places = views.with_corners(views.cells(spark, "/root/testdata/sf0.01")).select("cell_id", "corners")
    t = spherical.overlaps(places, GRID).groupBy("cell_id").agg(F.max("area").alias("a"), F.sum("overlap").alias("x"))
    worst = t.agg(F.max(F.abs(F.col("x") / F.col("a") - 1)), F.count("*")).first()
    assert worst[0] < 1e-6 and worst[1] == places.count()


def test_nearest_valid_of_each_slice(spark):
    """Against all pairs; slices that share their valid cells are searched once."""
    dice = np.random.default_rng(3)
    cells = [(i, float(dice.uniform(-90, 90)), float(dice.uniform(-180, 180))) for i in range(60)] + [(60, 1.0, 1.0), (61, 1.0, 1.0)]
    rows = []
    for m in range(6):
        valid = {c[0] for c in cells if (c[0] + m // 2) % 3}
        rows += [("A", m, *c, 1.0 if c[0] in valid else None) for c in cells]
    rows += [("B", 0, *c, None) for c in cells]
    field = spark.createDataFrame(rows, "model string, ym int, cell_id long, lat double, nlon double, tos double")
    got = {(r.model, r.ym, r.lat_bin, r.lon_bin): (r.chord, r.cell_id) for r in regrid.nearest_valid(field, "tos", GRID, 20.0).collect()}
    assert {k[0] for k in got} == {"A"}
    limit = 2 * math.sin(math.radians(10.0))
    for m in range(6):
        valid = [c for c in cells if (c[0] + m // 2) % 3]
        v = spherical.unit(*np.array([c[1:] for c in valid]).T)
        for a in range(18):
            for b in range(0, 36, 5):
                d = np.linalg.norm(v - spherical.unit(-85.0 + 10 * a, -175.0 + 10 * b), axis=1).round(9)
                best = min(zip(d, (c[0] for c in valid)))
                assert got.get(("A", m, a, b)) == (best if best[0] < limit else None)


@pytest.mark.parametrize("by", [(), ("model",)])
def test_where_cells_are_dense_few_bins_are_asked(spark, by):
    """Dense in the north, single cells and empty bins in the south: the same as of all pairs, while dense bins ask their own only."""
    dice = np.random.default_rng(21)
    lat, lon = np.append(dice.uniform(0, 90, 30_000), dice.uniform(-90, 0, 60)), dice.uniform(-180, 180, 30_060)
    cells = spark.createDataFrame([("A", k, float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lon))], "model string, cell_id long, lat double, nlon double")
    got = {(r.lat_bin, r.lon_bin): (r.chord, r.cell_id) for r in regrid.nearest(cells, GRID, spark, by=by).collect()}
    p, want = spherical.unit(lat, lon), {}
    for a in range(18):
        for b in range(36):
            chord = np.round(np.sqrt(((p - spherical.unit(np.array(-85.0 + 10 * a), np.array(-175.0 + 10 * b))) ** 2).sum(axis=1)), 9)
            k = int(np.lexsort((np.arange(len(p)), chord))[0])
            if chord[k] < 2 * np.sin(np.radians(15.0)):
                want[a, b] = (chord[k], k)
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=2e-9) for k in want)
    src = GRID.assign(cells).select(*by, "cell_id", F.col("lat_bin").alias("s_lat"), F.col("lon_bin").alias("s_lon"), *regrid._vector("lat", "nlon", "b"))
    assert regrid.asked(src, GRID, 30.0, by).where("lat_bin between 10 and 15").count() < 2 * 6 * 36
