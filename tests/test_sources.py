"""Sinks, reloads, the NetCDF adapter and the stream."""

import struct

import numpy as np
import pytest

from isopycna.operators import bins
from isopycna.sources import adapters, results
from isopycna.streaming import monthly


def classic(values, fill=1e20):
    """A small classic NetCDF file with a record dimension."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    t, y, x = values.shape
    dims = struct.pack(">ii", 10, 3) + text("time") + struct.pack(">i", 0) + text("j") + struct.pack(">i", y) + text("i") + struct.pack(">i", x)
    attr = struct.pack(">ii", 12, 1) + text("_FillValue") + struct.pack(">iif", 5, 1, fill)
    head = b"CDF\x01" + struct.pack(">i", t) + dims + struct.pack(">ii", 0, 0)
    body = lambda begin: head + struct.pack(">ii", 11, 1) + text("tos") + struct.pack(">iiii", 3, 0, 1, 2) + attr + struct.pack(">iii", 5, y * x * 4, begin)
    begin = len(body(0))
    return body(begin) + values.astype(">f4").tobytes()


def test_netcdf(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(2, 2, 3)
    a[1, 1, 2] = 1e20
    (tmp_path / "a.nc").write_bytes(classic(a))
    (tmp_path / "empty.nc").write_bytes(b"")
    spark.dataSource.register(adapters.NetcdfSource)
    read = lambda skip: spark.read.format("netcdf").option("variable", "tos").option("skip_bad", skip).load(f"{tmp_path}/*.nc")
    rows = read("true").collect()
    assert len(rows) == 12
    assert {(r.time_index, r.y, r.x): r.value for r in rows}[(1, 0, 2)] == 8.0
    assert sum(r.value is None for r in rows) == 1
    with pytest.raises(Exception, match="empty.nc"):
        read("false").collect()
    assert adapters.stacked(read("true"), 3).selectExpr("max(cell_id)").first()[0] == 5


def test_months_of_calendars():
    assert adapters.month_of(400.0, "days since 2000-01-01", "standard") == 2001 * 12 + 1
    assert adapters.month_of(59.0, "days since 2000-01-01", "noleap") == 2000 * 12 + 2
    assert adapters.month_of(59.0, "days since 2000-01-01", "standard") == 2000 * 12 + 1
    assert adapters.month_of(-1.0, "days since 2000-01-01", "360_day") == 1999 * 12 + 11
    assert adapters.month_of(24.0 * 365, "hours since 2501-01-01 00:00:00", "365_day") == 2502 * 12
    with pytest.raises(ValueError, match="units"):
        adapters.month_of(1.0, "months", "standard")


def test_written_files_are_read(spark, tmp_path):
    """Packed values, fill, a coordinate known by its standard name only, and a header longer than the first read."""
    values = np.array([[[1, 2], [3, -9]], [[5, 6], [7, 8]]], np.int16)
    raw = adapters.classic_bytes(
        {"time": 2, "y": 2, "x": 2, "nv": 2},
        {
            "time": (("time",), np.array([14.0, 45.0]), {"units": "days since 2000-01-01"}),
            "phi": (("y", "x"), np.zeros((2, 2)), {"standard_name": "latitude", "bounds": "phi_bnds"}),
            "phi_bnds": (("y", "nv"), np.zeros((2, 2)), {"standard_name": "latitude"}),
            "tos": (("time", "y", "x"), values, {"scale_factor": 0.5, "add_offset": 10.0, "_FillValue": -9.0, "comment": "x" * 100_000}),
        },
    )
    (tmp_path / "a.nc").write_bytes(raw)
    (tmp_path / "b.nc").write_bytes(adapters.classic_bytes({"x": 1}, {"tos": (("x",), np.ones(1), {})}))
    rows = adapters.netcdf(spark, f"{tmp_path}/*.nc", "tos", skip_bad="true", deep_check="true").collect()
    assert {(r.ym, r.y, r.x): r.value for r in rows} == {(24000 + t, y, x): None if values[t, y, x] == -9 else 10.0 + values[t, y, x] / 2 for t in (0, 1) for y in (0, 1) for x in (0, 1)}
    cube = adapters.ClassicNetcdf(raw)
    assert adapters.coordinate(cube.variables, "lat") == "phi"
    with pytest.raises(ValueError, match="coordinate lon"):
        adapters.coordinate(cube.variables, "lon")
    assert [(r.name, r.why) for r in adapters.faults(spark, f"{tmp_path}/*.nc", "tos").collect()] == [("b.nc", "tos has no time axis")]


def test_replace(spark, tmp_path):
    path = f"{tmp_path}/one"
    for n in (3, 2):
        results.replace(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert not (tmp_path / "one.old").exists() and not (tmp_path / "one.new").exists()


def test_replace_undoes_what_failed(spark, tmp_path):
    """A write or a rename that fails leaves the old table; what a dead run left beside is put back."""
    path = f"{tmp_path}/one"
    results.replace(spark.range(3), path)
    bad = spark.range(5).selectExpr("raise_error('stop') as id")
    with pytest.raises(Exception, match="stop"):
        results.replace(bad, path)
    assert spark.read.parquet(path).count() == 3
    (tmp_path / "one").rename(tmp_path / "one.old")
    with pytest.raises(Exception, match="stop"):
        results.replace(bad, path)
    assert spark.read.parquet(path).count() == 3
    results.replace(spark.range(4).selectExpr("id", "id % 2 as b"), path, ("b",))
    assert spark.read.parquet(path).where("b = 1").count() == 2


def test_names(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "nav_lat double, lon double")
    assert adapters.homogenized(df).columns == ["lat", "lon"]


def test_save_and_resume(spark, tmp_path):
    path = f"{tmp_path}/out"
    a = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "model string, v double")
    assert results.load(spark, path, a.schema).count() == 0
    results.save(a, path)
    results.save(spark.createDataFrame([("B", 3.0)], "model string, v double"), path)
    have = results.load(spark, path, a.schema)
    assert sorted((r.model, r.v) for r in have.collect()) == [("A", 1.0), ("B", 3.0)]
    todo = spark.createDataFrame([("A",), ("C",)], "model string")
    assert [r.model for r in results.remaining(todo, have).collect()] == ["C"]
    results.save_list(todo, f"{tmp_path}/list")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/list").collect()) == ["A", "C"]
    results.save_report(a, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 2
    cube = spark.createDataFrame([("rho", 1, 0, 0, 1.5)], "variable string, month int, lat_bin int, lon_bin int, value double")
    results.save_cube(cube, f"{tmp_path}/cube")
    assert spark.read.parquet(f"{tmp_path}/cube").first().value == 1.5


def test_stream(spark, tmp_path):
    c = bins.Classes(1.0, 3.0, 1.0)
    kind = "model string, ym int, rho double, fsurf double, heat double, fw double, area double"
    for month in (1, 2):
        spark.createDataFrame([("A", month, 1.5, 1.0, 1.0, 0.0, 2.0)] * month, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = monthly.read(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1)
    query = monthly.start(monthly.class_sums(stream, c), "sums", f"{tmp_path}/check")
    query.processAllAvailable()
    query.stop()
    assert sorted((r.ym, r.bin_idx, r.area_sum) for r in spark.table("sums").collect()) == [(1, 1, 2.0), (2, 1, 4.0)]
