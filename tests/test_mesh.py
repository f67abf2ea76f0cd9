"""Bilinear weights on curvilinear meshes: known places, seams, poles, and every centre against every square."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopycna.operators import mesh, regrid

SCHEMA = "cell_id long, j long, i long, lat double, lon double"


def rotated(lat, lon, tilt):
    """Places of a grid whose pole is moved by ``tilt`` degrees."""
    a, b, c = np.radians(lat), np.radians(lon), math.radians(tilt)
    x, y, z = np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)
    x, z = x * math.cos(c) + z * math.sin(c), -x * math.sin(c) + z * math.cos(c)
    return np.degrees(np.arcsin(np.clip(z, -1, 1))), np.degrees(np.arctan2(y, x))


def places(spark, n_j, n_i, tilt, gap=None):
    j, i = (a.ravel() for a in np.meshgrid(np.arange(n_j), np.arange(n_i), indexing="ij"))
    lat, lon = rotated(-80 + 160.0 * j / (n_j - 1), 360.0 * i / n_i + 0.3, tilt)
    rows = [(int(k), int(a), int(b), None if k == gap else float(x), float(y)) for k, (a, b, x, y) in enumerate(zip(j, i, lat, lon))]
    return spark.createDataFrame(rows, SCHEMA), rows


def unit(lat, lon):
    a, b = np.radians(lat), np.radians(lon)
    return np.array([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


@pytest.mark.parametrize("tilt,n_i", [(0, 40), (35, 40), (90, 40), (35, None)])
def test_weights_rebuild_the_place(spark, tilt, n_i):
    """Weights add up to one and carry the corners to the direction of the centre; with a seam every centre between the rings has them."""
    table, rows = places(spark, 21, 40, tilt)
    grid = regrid.Grid(10.0)
    got = {}
    for r in mesh.bilinear(table, grid, n_i).collect():
        got.setdefault((r.lat_bin, r.lon_bin), []).append((r.cell_id, r.w))
    at = {k: unit(lat, lon) for k, _, _, lat, lon in rows}
    for (a, b), found in got.items():
        centre = unit(-85 + 10 * a, -175 + 10 * b)
        assert sum(w for _, w in found) == pytest.approx(1.0, abs=1e-9) and len(found) <= 4
        # Corners as seen from the centre: their weighted mean is the centre itself.
        seen = sum(w * (at[c] / (at[c] @ centre)) for c, w in found)
        assert np.allclose(seen, centre, atol=1e-8)
    if n_i:
        # The rings at 80 degrees of the moved grid bound what is inside.
        c = math.radians(tilt)
        pole = np.array([math.sin(c), 0, math.cos(c)])
        inside = {(a, b) for a in range(18) for b in range(36) if abs(math.degrees(math.asin(unit(-85 + 10 * a, -175 + 10 * b) @ pole))) < 79}
        assert inside <= got.keys()
    else:
        assert 0 < len(got) < 18 * 36


def test_a_missing_place_takes_its_squares(spark):
    full, _ = places(spark, 5, 8, 10)
    less, _ = places(spark, 5, 8, 10, gap=2 * 8 + 3)
    assert mesh.squares(full, 8).count() == 32 and mesh.squares(less, 8).count() == 28 and mesh.squares(full).count() == 28


def test_a_square_around_the_pole(spark):
    """A pole within a square is found whatever the longitudes of its corners."""
    table = spark.createDataFrame([(0, 0, 0, 84.0, -130.0), (1, 0, 1, 83.0, -40.0), (2, 1, 1, 84.5, 50.0), (3, 1, 0, 82.0, 140.0)], SCHEMA)
    got = mesh.bilinear(table, regrid.Grid(10.0)).groupBy("lat_bin", "lon_bin").agg(F.sum("w").alias("w")).collect()
    assert {r.lat_bin for r in got} == {17} and len(got) > 10 and all(r.w == pytest.approx(1.0) for r in got)


def test_applied_needs_all_places(spark):
    table, rows = places(spark, 21, 40, 0)
    weights = mesh.bilinear(table, regrid.Grid(10.0), 40)
    field = lambda f: spark.createDataFrame([("A", k, f(lat, lon)) for k, _, _, lat, lon in rows], "model string, cell_id long, v double")
    whole = {(r.lat_bin, r.lon_bin): r.v for r in mesh.applied(field(lambda lat, lon: lat), weights, "v", ("model",)).collect()}
    # Of a grid of parallels the value is that of the latitude, but for what great circles rise above parallels.
    assert len(whole) == 16 * 36 and all(abs(v - (-85 + 10 * a)) < 0.5 for (a, _), v in whole.items())
    some = mesh.applied(field(lambda lat, lon: None if lat > 0 else 1.0), weights, "v", ("model",))
    top, low, high = some.agg(F.max("lat_bin"), F.min("v"), F.max("v")).first()
    assert top == 8 and low == pytest.approx(1.0) and high == pytest.approx(1.0)


def test_nothing(spark):
    assert mesh.bilinear(spark.createDataFrame([], SCHEMA), regrid.Grid(10.0), 50).count() == 0


def test_inverse_of_plane_quadrilaterals():
    """Points of a bilinear map are found again; points outside are not."""
    dice = np.random.default_rng(5)
    square = np.array([[0.0, 0], [1, 0], [1, 1], [0, 1]])
    for _ in range(300):
        corners = square + dice.uniform(-0.25, 0.25, (4, 2)) * dice.integers(0, 2)
        s, t = dice.uniform(0, 1, 2)
        at = (1 - s) * (1 - t) * corners[0] + s * (1 - t) * corners[1] + s * t * corners[2] + (1 - s) * t * corners[3]
        x, y = (corners - at).T[:, None]
        assert np.allclose([v[0] for v in mesh.inverse(x, y)], [s, t], atol=1e-9)
        x, y = (corners - at + [3.0, 0.5]).T[:, None]
        assert all(np.isnan(v[0]) for v in mesh.inverse(x, y))


@pytest.mark.parametrize("tilt,n_i", [(0, 40), (50, 40), (50, None)])
def test_patches_are_exact_on_quadratics(spark, tilt, n_i):
    """Against fields that are quadratic in the plane of a centre, and against least squares solved one patch at a time."""
    table, rows = places(spark, 21, 40, tilt)
    at = {k: (j, i, lat, lon) for k, j, i, lat, lon in rows}
    got, bilinear = {}, {}
    for r in mesh.patch(table, regrid.Grid(10.0), n_i).collect():
        got.setdefault((r.lat_bin, r.lon_bin), {})[r.cell_id] = r.w
    for r in mesh.bilinear(table, regrid.Grid(10.0), n_i).collect():
        bilinear.setdefault((r.lat_bin, r.lon_bin), {})[r.cell_id] = r.w
    assert got.keys() == bilinear.keys()
    inner = 0
    for (a, b), found in got.items():
        assert sum(found.values()) == pytest.approx(1.0, abs=1e-9) and len(found) <= 16
        ids = list(found)
        x, y, _ = mesh.plane(np.array([[at[c][2] for c in ids]]), np.array([[at[c][3] for c in ids]]), np.array([-85.0 + 10 * a]), np.array([-175.0 + 10 * b]))
        w, x, y = np.array([found[c] for c in ids]), x[0], y[0]
        js = [at[c][0] for c in bilinear[a, b]]
        if min(js) >= 1 and max(js) <= 19 and (n_i or 1 <= min(at[c][1] for c in bilinear[a, b]) and max(at[c][1] for c in bilinear[a, b]) <= 38):
            inner += 1
            assert np.allclose([w @ x, w @ y, w @ (x * x), w @ (x * y), w @ (y * y)], 0, atol=1e-8)
    assert inner > 200


def test_patches_against_least_squares():
    dice = np.random.default_rng(9)
    x, y = (np.arange(16) % 4 + dice.uniform(-0.2, 0.2, 16) - 1.4)[None], (np.arange(16) // 4 + dice.uniform(-0.2, 0.2, 16) - 1.6)[None]
    share, values = np.array([[0.1, 0.2, 0.3, 0.4]]), dice.normal(size=16)
    got = mesh.patch_rows(x, y, np.ones((1, 16), bool), share)[0] @ values
    want = 0.0
    for c, nodes in enumerate(mesh.PATCHES):
        u, v = x[0, nodes], y[0, nodes]
        want += share[0, c] * np.linalg.lstsq(np.stack([np.ones(9), u, v, u * u, u * v, v * v], axis=1), values[nodes], rcond=None)[0][0]
    assert got == pytest.approx(want)
    # Without the lower row the patches of the lower corners don't settle: those give their own values.
    there = (np.arange(16) >= 4)[None]
    low = mesh.patch_rows(x, y, there, np.array([[0.5, 0.5, 0.0, 0.0]]))[0]
    assert low[5] == low[6] == 0.5 and np.count_nonzero(low) == 2


@pytest.mark.parametrize("rows", [40, 2400, 144_000])
def test_flat_patches_settle(rows):
    """Rows of a fine mesh lie close together while its columns stay far apart: patches are as exact as on square meshes."""
    dice = np.random.default_rng(17)
    at_lat, at_lon = dice.uniform(-70, 70, 200), dice.uniform(-180, 180, 200)
    j = np.floor((at_lat + 75.0) * rows / 150.0)[:, None] + np.arange(16) // 4 - 1
    i = np.floor((at_lon + 180.0) / 7.2)[:, None] + np.arange(16) % 4 - 1
    lat, lon = -75.0 + 150.0 * (j + 0.1 * np.sin(np.radians(i * 7.2))) / rows, i * 7.2 + 3.0 * np.cos(np.radians(j * 40.0)) - 180.0
    x, y, _ = mesh.plane(lat, lon, at_lat, at_lon)
    w = mesh.patch_rows(x, y, np.ones(x.shape, bool), np.full((200, 4), 0.25))
    assert np.allclose(w.sum(axis=1), 1.0, atol=1e-9)
    assert np.allclose([(w * t).sum(axis=1) for t in (x, y, x * x, x * y, y * y)], 0.0, atol=1e-9)
    # Places on one line don't settle.
    alone = mesh.patch_rows(x, 2.0 * x, np.ones(x.shape, bool), np.full((200, 4), 0.25))
    assert (np.count_nonzero(alone, axis=1) == 4).all()
