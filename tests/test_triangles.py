"""Tiled triangulation against empty circles tried one by one, and against one tile for all points."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopycna.operators import triangles

SCHEMA = "id long, x double, y double"


def table(spark, xy):
    return spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in enumerate(xy)], SCHEMA)


def found(spark, xy, radius, tile=triangles.TILE):
    rows = triangles.triangulation(table(spark, xy), radius, tile).collect()
    out = {(r.a, r.b, r.c): r.radius for r in rows}
    assert len(out) == len(rows)
    return out


def naive(xy, radius):
    out = {}
    for t in itertools.combinations(range(len(xy)), 3):
        c, s = triangles.circles(xy[list(t)][None])
        if s[0] <= radius * radius and (((xy - c[0]) ** 2).sum(axis=1) >= s[0] * (1 - 1e-9)).all():
            out[t] = float(np.sqrt(s[0]))
    return out


@pytest.mark.parametrize("tile", [0.7, 4.0, 100.0])
def test_against_empty_circles(spark, tile):
    """Clusters, gaps wider than the radius, and points far off."""
    dice = np.random.default_rng(11)
    xy = np.vstack([dice.uniform(0, 10, (40, 2)), dice.normal([30, 30], 0.5, (30, 2)), [[-50.0, 80.0], [200.0, -7.0]]])
    want = naive(xy, 2.5)
    got = found(spark, xy, 2.5, tile)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 60


def test_tiles_change_nothing(spark):
    dice = np.random.default_rng(12)
    xy = dice.uniform(-40, 40, (1500, 2))
    one = found(spark, xy, 4.0, 1000.0)
    assert found(spark, xy, 4.0, 4.0).keys() == found(spark, xy, 4.0, 1.5).keys() == one.keys()
    # Inside, triangles cover the plane once: twice as many as points, about.
    assert 2700 < len(one) < 3000


def test_regular_grids_are_split_once(spark):
    """Four points on each circle: every square has two triangles, the same in all tiles."""
    xy = np.array([(x, y) for x in range(-12, 13) for y in range(-12, 13)], float)
    for tile in (1.3, 4.0, 100.0):
        got = found(spark, xy, 1.0, tile)
        assert len(got) == 2 * 24 * 24
        double = lambda a, b, c: abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        assert sum(double(*xy[list(t)]) / 2 for t in got) == pytest.approx(24 * 24)
    assert found(spark, xy, 1.0, 1.3).keys() == got.keys()


def test_odd_points(spark):
    nan = float("nan")
    xy = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (-0.0, 0.0), (nan, 1.0), (float("inf"), 0.0)]
    assert set(found(spark, xy, 2.0)) == {(0, 1, 2)}
    assert found(spark, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], 5.0) == {}
    assert found(spark, xy[:2], 2.0) == {} and triangles.triangulation(spark.createDataFrame([], SCHEMA), 1.0).count() == 0
    assert triangles.triangulation(spark.createDataFrame([(1, None, 2.0), (None, 1.0, 1.0)], SCHEMA), 1.0).count() == 0
    with pytest.raises(ValueError):
        triangles.triangulation(spark.createDataFrame([], SCHEMA), 0.0)


def test_linear_fields_are_exact(spark):
    dice = np.random.default_rng(13)
    xy = dice.uniform(0, 20, (300, 2))
    points = table(spark, xy)
    weights = triangles.at_points(triangles.triangulation(points, 6.0), 1.0)
    field = points.select(F.lit("A").alias("model"), "id", (2.0 * F.col("x") - F.col("y") + 3.0).alias("v"))
    rows = triangles.interpolated(field, weights, "v", ("model",)).collect()
    assert len({(r.x, r.y) for r in rows}) == len(rows) > 300
    assert all(r.v == pytest.approx(2 * r.x - r.y + 3, abs=1e-9) for r in rows)
    # A place needs all three corners.
    less = triangles.interpolated(field.withColumn("v", F.when(F.col("id") != 7, F.col("v"))), weights, "v", ("model",))
    assert less.count() == len(rows) - weights.where("a = 7 or b = 7 or c = 7").count() < len(rows)


@pytest.mark.parametrize("held", [30, 200])
def test_rounds_change_nothing(spark, held):
    """Dense and thin parts, gaps, points alone, and circles of just the radius of a round: the same triangles as in one round."""
    dice = np.random.default_rng(14)
    grid = np.array([(40 + 0.6 * x, 0.8 * y) for x in range(14) for y in range(14)])
    xy = np.vstack([dice.uniform(0, 12, (250, 2)), dice.normal([20, 5], 0.4, (200, 2)), dice.uniform(-10, 30, (40, 2)), grid, [[90.0, 90.0]]])
    one = {(r.a, r.b, r.c): r.radius for r in triangles.triangulation(table(spark, xy), 4.0, held=10**9).collect()}
    rows = triangles.triangulation(table(spark, xy), 4.0, held=held).collect()
    assert len(rows) == len(one) > 1000 and {(r.a, r.b, r.c): r.radius for r in rows} == one
    assert max(one.values()) > 2.0 > 0.5 > min(one.values())


def test_triangles_are_set_aside(monkeypatch):
    """Triangles that no later point can reach are not looked at: what is looked at for a point doesn't grow with all."""
    looked, found = [], np.flatnonzero
    monkeypatch.setattr(triangles.np, "flatnonzero", lambda a: looked.append(len(a)) or found(a))
    xy = np.random.default_rng(15).uniform(0, 40, (3000, 2))
    assert len(triangles.delaunay(xy[np.lexsort((xy[:, 1], xy[:, 0]))], 4.0)) > 5900
    assert np.median(looked) < 600
