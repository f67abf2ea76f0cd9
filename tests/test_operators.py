"""Literal cases: edges, gaps, the dateline, the poles, missing values."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from isopycna.functions import eos, geo, means
from isopycna.operators import bins, catalog, metrics, months, overturn, profiles, regrid
from isopycna.plans import surface
from isopycna.sources.views import finite


def values(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(
    "s,t,rho,alpha,beta",
    [
        (35.0, 10.0, 1026.82464446, 1.66256125402e-4, 7.53667844991e-4),
        (35.0, 0.0, 1027.97454781, 5.24995790328e-5, 7.80827691469e-4),
        (32.0, -1.8, 1025.62443459, 1.88042763086e-5, 7.88087736021e-4),
        (0.0, 4.0, 999.975798526, -3.02140119661e-6, 8.0182536444e-4),
    ],
)
def test_density(spark, s, t, rho, alpha, beta):
    row = eos.with_density(spark.createDataFrame([(s, t)], "sos double, tos double")).first()
    assert row.rho == pytest.approx(rho, abs=1e-7)
    assert row.alpha == pytest.approx(alpha, rel=1e-9)
    assert row.beta == pytest.approx(beta, rel=1e-9)


@pytest.mark.parametrize("step,count", [(0.05, 302), (0.01, 1502), (0.5, 32)])
def test_number_of_classes(step, count):
    assert bins.Classes(step=step).count == count


def test_bad_classes():
    with pytest.raises(ValueError):
        bins.Classes(step=0.0)


def cells(spark, rows):
    return spark.createDataFrame(rows, "model string, ym int, rho double, fsurf double, heat double, fw double, area double")


def test_class_edges(spark):
    c = bins.Classes(1.0, 3.0, 1.0)
    assert (c.lower, c.upper, c.count) == (0.0, 4.0, 4)
    df = cells(spark, [("A", 1, r, 1.0, 1.0, 0.0, 1.0) for r in (0.0, 1.0, 1.5, 3.999, 4.0)])
    got = df.select("rho", c.index(F.col("rho")).alias("k"), bins.strict_index(c).alias("s")).collect()
    assert [r.k for r in got] == [None, 1, 1, 3, None]
    assert [r.s for r in got] == [None, None, 1, 3, None]


def test_profile_counts_empty_months_and_missing_fluxes(spark):
    c = bins.Classes(1.0, 3.0, 1.0)
    df = cells(spark, [("A", 1, 1.5, None, None, None, 4.0), ("A", 1, 1.6, 2.0, 1.0, 1.0, 3.0)])
    frame = spark.createDataFrame([("A", 1), ("A", 2)], "model string, ym int")
    rows = {r.bin_idx: r for r in bins.profile(df, frame, c).collect()}
    assert len(rows) == 4
    assert rows[1].area_sum == 3.5
    assert rows[1].fgen == pytest.approx(2.0 * 3.0 / 1e6 / 2)
    assert rows[0].fgen == 0.0
    assert bins.profile(df.limit(0), frame, c).count() == 4


def test_places(spark):
    rows = [(45.0, 0.0), (45.1, 270.0), (50.0, 60.0), (50.0, 60.1), (50.0, 180.0), (-90.0, 0.0), (90.0, 0.0)]
    df = spark.createDataFrame(rows, "lat double, lon double").withColumn("nlon", geo.normalized_longitude(F.col("lon")))
    assert [r.nlon for r in df.collect()][:5] == pytest.approx([0.0, -90.0, 60.0, 60.1, -180.0])
    assert [r[0] for r in df.select(geo.north_atlantic(F.col("lat"), F.col("nlon"))).collect()] == [False, True, True, False, False, False, True]
    g = regrid.Grid(10.0)
    assert [r[0] for r in df.select(g.lat_bin(F.col("lat"))).collect()][-2:] == [0, None]
    assert spark.range(1).select(geo.normalized_longitude(F.lit(-190.0))).first()[0] == 170.0


def test_missing_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (-math.inf,), (None,)], "x double")
    assert [r[0] for r in df.select(finite(F.col("x"))).collect()] == [1.0, None, None, None, None]


def test_coarsening(spark):
    rows = [("A", 1, 0, 0, None, 2.0), ("A", 1, 1, 1, 3.0, 1.0), ("A", 1, 2, 0, None, 5.0), ("A", 1, 4, 0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "model string, ym int, j int, i int, v double, area double")
    got = {r.j_block: r.v for r in regrid.coarsened(df, "v").collect()}
    assert got == {0: 1.0, 1: 0.0, 2: None}


def test_coarsening_of_rows(spark):
    """Several rows of a cell, a place listed twice, cells without a place, a value or an area: the same as of a join with the means."""
    rows = [("A", 1, 1, 2.0), ("A", 1, 1, 4.0), ("A", 1, 2, None), ("A", 1, 3, 7.0), ("A", 1, 4, 9.0), ("A", 2, 4, None), ("B", 1, 3, 1.0), ("B", 1, 5, 8.0), ("B", 1, 6, 3.0), ("B", 1, None, 3.0)]
    places = [(1, 0, 0, 2.0), (2, 1, 1, 4.0), (3, 1, 0, 3.0), (3, 1, 0, 3.0), (4, 2, 5, 0.0), (5, 2, 4, None), (7, 0, 0, 1.0), (None, 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "model string, ym int, cell_id long, v double")
    at = spark.createDataFrame(places, "cell_id long, j long, i long, area double")
    want = regrid.coarsened(df.groupBy("model", "ym", "cell_id").agg(F.avg("v").alias("v")).join(at, "cell_id"), "v")
    got = regrid.coarsened_rows(df, at, "v", 3)
    assert got.columns == want.columns and values(got) == values(want) and len(values(got)) == 5


def test_tasks_of_coarsening_follow_the_rows(spark, tmp_path):
    """Four times the rows, four times the tasks; the largest takes no more of them. Results are those of the means."""
    most = []
    for n in (20_000, 80_000):
        path = str(tmp_path / str(n))
        spark.range(n).selectExpr("'A' model", "1 ym", "id cell_id", "id % 7 / 2e0 v").write.parquet(path)
        df = spark.read.parquet(path)
        at = df.selectExpr("cell_id", "cell_id div 50 j", "cell_id % 50 i", "cell_id % 3 + 1e0 area")
        parts = regrid.parts(df, 1_000)
        got = regrid.coarsened_rows(df, at, "v", parts)
        assert parts == n // 1_000
        per = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(per) > 0.9 * parts and sum(per) == n / 4
        most.append(max(per))
        assert values(got.selectExpr("j_block", "i_block", "round(v, 9)", "area")) == values(regrid.coarsened(df.join(at, "cell_id"), "v").selectExpr("j_block", "i_block", "round(v, 9)", "area"))
    assert most[1] < 2 * most[0]


def test_nearest_at_pole_and_dateline(spark):
    src = spark.createDataFrame([(1, 89.0, 10.0), (2, 5.0, 179.9), (3, 5.0, -140.0)], "cell_id long, lat double, nlon double")
    got = {(r.lat_bin, r.lon_bin): r.cell_id for r in regrid.nearest(src, regrid.Grid(10.0), spark).collect()}
    assert got[(17, 35)] == 1 and got[(17, 0)] == 1
    assert got[(9, 0)] == 2 and got[(9, 35)] == 2
    assert (3, 3) not in got


def test_corner_mesh(spark):
    at = lambda j, i: [float(10 * (j + dj) + i + di) for dj, di in ((0, 0), (0, 1), (1, 1), (1, 0))]
    df = spark.createDataFrame([(j, i, at(j, i)) for j in range(2) for i in range(3)], "j int, i int, corners array<double>")
    assert values(regrid.corner_mesh(df)) == [(j, i, float(10 * j + i)) for j in range(3) for i in range(4)]


def test_gaps_overlaps_versions(spark):
    rows = [("A", 0, 9, 1, 1), ("A", 5, 12, 2, 2), ("A", 20, 30, 3, 3), ("B", 0, 5, 1, 4)]
    df = spark.createDataFrame(rows, "model string, start_ym int, end_ym int, version int, seq long")
    assert values(catalog.gaps(df, ("model",), 31)) == [("A", 13, 3), ("B", -25, 1)]
    assert values(catalog.overlaps(df, ("model",), 31)) == [("A", True), ("B", False)]
    kept = catalog.newest(df, ["model"], F.coalesce("version", F.lit(-1)).desc(), F.col("seq"))
    assert [r.seq for r in kept.orderBy("model").collect()] == [3, 4]


def test_greedy_cover(spark):
    year = lambda a, b, s: ("A", 12 * a, 12 * b + 11, s)
    df = spark.createDataFrame([year(0, 9, 1), year(5, 14, 2), year(5, 12, 3), year(10, 19, 4), year(10, 18, 5)], "model string, start_ym int, end_ym int, seq long")
    got = [(r.y0, r.y1, r.seq) for r in catalog.greedy_cover(df, ("model",), 20).orderBy("step").collect()]
    assert got == [(10, 19, 4), (0, 9, 1)]


def test_names(spark):
    rows = [("tos_Omon_X-1_piControl_r1i1p1f1_gn_000101-010012.nc",), ("areacello_Ofx_X_piControl_r1i1p1f1_gr.nc",), ("junk.nc",), (None,)]
    got = catalog.parse(spark.createDataFrame(rows, "filename string")).collect()
    assert (got[0].p_model, got[0].p_start, got[0].p_end, got[0].kind) == ("X-1", 101, 10012, "time")
    assert (got[1].p_grid, got[1].p_start, got[1].kind) == ("gr", None, "static")
    assert got[2].kind == got[3].kind == "other"


def test_availability_rule(spark):
    rows = [("A", v) for v in ("msftmz", "wfo", "hfds", "tos", "sos")] + [("B", "tos"), ("B", "sos")]
    got = catalog.availability(spark.createDataFrame(rows, "model string, variable string"), ("msftmz", "wfo", "hfds", "tos", "sos")).collect()
    assert {r.model: (r.msftmz, r.tos) for r in got} == {"A": (1, 1), "B": (0, 1)}


def test_months(spark):
    df = spark.createDataFrame([("A", m) for m in (1, 2, 3, 7, 8, 8)], "model string, ym int")
    assert values(months.islands(df)) == [("A", 1, 3, 3), ("A", 7, 8, 2)]
    four = df.distinct().crossJoin(spark.createDataFrame([(v,) for v in "abcd"], "variable string"))
    assert values(months.common(four, 4, 2)) == [("A", False, 7), ("A", False, 8)]
    assert values(months.common(four, 4, 3).select("short").distinct()) == [(True,)]


def test_rolling_needs_all_values(spark):
    df = spark.createDataFrame([("A", y, float(y)) for y in range(4)] + [("B", y, float(y)) for y in range(6)], "model string, year int, v double")
    got = {(r.model, r.year): r.rolling for r in months.rolling(df, "v", ("model",), "year").collect()}
    assert all(got["A", y] is None for y in range(4))
    assert got["B", 2] == 2.0 and got["B", 3] == 3.0 and got["B", 1] is None


def test_constant_has_no_r2(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double")
    assert metrics.linear_fit(df, "x", "y").first().r2 is None


def test_profiles(spark):
    df = spark.createDataFrame([("A", 1.0, -2.0), ("A", 2.0, -2.0), ("A", 3.0, 1.0), ("A", 4.0, None)], "model string, rho double, fgen double")
    assert profiles.at_minimum(df, ("model",)).first().rho_at_min == 1.0
    assert profiles.trapezoid(df, "rho", profiles.negative_part(F.col("fgen")), ("model",), "x").first().x == 3.0
    pct = spark.range(1).select(profiles.percent_difference(F.lit(1.0), F.lit(0.0)).alias("z"), profiles.percent_difference(F.lit(1.0), F.lit(-2.0)).alias("p")).first()
    assert pct.z is None and pct.p == 150.0


def test_basins(spark):
    rows = [("A", "global_ocean", 0), ("A", "atlantic_arctic_ocean", 1), ("B", "pacific", 0), ("C", "none", 0)]
    got = overturn.chosen_basin(spark.createDataFrame(rows, "model string, label string, idx int"))
    assert {r.model: r.label for r in got.collect()} == {"A": "atlantic_arctic_ocean", "B": "pacific"}


def test_scan_prunes_and_pushes(spark):
    from isopycna.sources import views

    plan = views.surface_cells(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "l_shipdate" in plan and "l_returnflag" not in plan.split("ReadSchema")[-1]


def test_exact_mean_in_any_order(spark):
    """As rounded from the exact sum, for values of many sizes that cancel out but for a little; missing ones don't count."""
    rng = random.Random(1)
    groups = {"none": [None, None], "one": [0.1, None], "large": [1e300, 1.0], "long": [0.1] * 1000}
    for k in range(40):
        some = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-6, 3) for _ in range(rng.randint(1, 6))]
        groups[f"g{k}"] = some + [-x * (1 + rng.choice([0, 1e-15])) for x in some] + [None]
    want = {}
    for k, v in groups.items():
        there = [x for x in v if x is not None]
        want[k] = math.fsum(there) / len(there) if there else None
    for turn in range(2):
        rows = [(k, x) for k, v in groups.items() for x in v]
        rng.shuffle(rows)
        got = spark.createDataFrame(rows, "k string, x double").repartition(3 + turn).groupBy("k").agg(means.exact_mean(F.col("x")).alias("m")).collect()
        assert len(got) == len(want) and [r.k for r in got if r.m is None] == ["none"]
        assert all(r.m == pytest.approx(want[r.k], rel=4.5e-16, abs=0) for r in got if r.m is not None)


def test_sign_of_forcing_in_any_order(spark, tmp_path):
    """Three rows of a cell whose taxes cancel out but for rounding errors: valid in all orders or in none."""
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    line = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(1).drop("l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_shipdate")
    taxes = [(t / 100, u / 100, v / 100) for t, u, v in itertools.combinations_with_replacement(range(9), 3) if t + u + v == 12]
    orders = [(k, s, x) for s, three in enumerate(taxes) for k, p in enumerate(itertools.permutations(three)) for x in p]
    rows = spark.createDataFrame(orders, "k int, s int, tax double").coalesce(1)
    rows = rows.selectExpr("cast(10 * s + k as long) l_partkey", "1 l_linenumber", "50.0D l_quantity", "100.0D l_extendedprice", "0.05D l_discount", "tax l_tax", "0L l_suppkey", "timestamp'1995-03-01' l_shipdate")
    rows.crossJoin(F.broadcast(line)).write.parquet(f"{tmp_path}/lineitem.parquet")
    valid = sum(6 for three in taxes if math.fsum((x - 0.04) * 5e3 for x in three) < 0)
    assert values(surface.joint_valid(spark, str(tmp_path))) == [("M0", 6 * len(taxes), valid)]
