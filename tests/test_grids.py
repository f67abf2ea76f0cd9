"""Scans of gridded files: kinds of grid, levels, truncated files, calendars, ranges of steps and pruning."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopycna.functions import calendars
from isopycna.sources import adapters, views

TIME = {"units": "days since 2000-01-01", "calendar": "standard"}


def days(n):
    return (("time",), np.arange(n) * 31.0 + 10.0, TIME)


def put(folder, name, dims, variables, record="time"):
    (folder / name).write_bytes(adapters.classic_bytes(dims, variables, record=record))


def north(extra=None):
    return {"units": "degrees_north", "standard_name": "latitude", **(extra or {})}


def east(extra=None):
    return {"units": "degrees_east", "standard_name": "longitude", **(extra or {})}


def scanned(spark, folder, variable="tos", **options):
    return adapters.netcdf(spark, f"{folder}/*.nc", variable, **options)


def joined(spark, folder, variable="tos"):
    """Rows of the scan with their places, as {(ym, level, cell): (lat, lon, value)}."""
    t = scanned(spark, folder, variable)
    cells = adapters.cells_of(t.select("path").distinct(), str(folder), variable)
    rows = t.join(cells.drop("y", "x"), ["path", "cell"]).collect()
    out = {(r.ym, r.level, r.cell): (r.lat, r.lon, r.value) for r in rows}
    assert len(out) == len(rows) == t.count()
    return out


@pytest.mark.parametrize("order", [("lat", "lon"), ("lon", "lat")])
def test_axes_in_any_order(spark, tmp_path, order):
    size = {"lat": 2, "lon": 3}
    values = np.arange(12.0).reshape(2, size[order[0]], size[order[1]])
    bounds = {"lat_b": (("lat", "n"), np.array([[-20.0, 0], [0, 20]]), {}), "lon_b": (("lon", "n"), np.array([[0.0, 120], [120, 240], [240, 360]]), {})}
    put(tmp_path, "a.nc", {"time": 2, "n": 2, **size}, {"time": days(2), "lat": (("lat",), np.array([-10.0, 10]), north({"bounds": "lat_b"})), "lon": (("lon",), np.array([60.0, 180, 300]), east({"bounds": "lon_b"})), **bounds, "tos": (("time", *order), values, {})})
    got = joined(spark, tmp_path)
    lat, lon = np.array([-10.0, 10]), np.array([60.0, 180, 300])
    for t in range(2):
        for i in range(6):
            a, b = divmod(i, size[order[1]])
            at = (lat[a], lon[b]) if order[0] == "lat" else (lat[b], lon[a])
            assert got[24000 + t, 0, i] == (*at, values[t, a, b])
    first = adapters.cells_of(scanned(spark, tmp_path).select("path").distinct(), str(tmp_path), "tos").where("lat = -10 and lon = 60").first()
    assert [(c.lat, c.lon) for c in first.corners] == [(-20.0, 0.0), (-20.0, 120.0), (0.0, 120.0), (0.0, 0.0)]


def test_mesh_levels_and_staggered_coordinates(spark, tmp_path):
    """Two-dimensional coordinates with a place that has none, a level axis, and coordinates of another field with the same standard name."""
    lat, lon = np.array([[1.0, 2, 3], [4, 5, 1e20]]), np.array([[10.0, 20, 30], [40, 50, 1e20]])
    corners = np.stack([lat - 0.5, lat - 0.5, lat + 0.5, lat + 0.5], axis=2)
    values = np.arange(24.0).reshape(2, 2, 2, 3)
    fill = {"_FillValue": 1e20}
    put(
        tmp_path, "a.nc", {"time": 2, "lev": 2, "j": 2, "i": 3, "ju": 3, "v": 4},
        {
            "time": days(2),
            "ulat": (("ju", "i"), np.zeros((3, 3)), north()),
            "nav_lat": (("j", "i"), lat, north({"bounds": "lat_v", **fill})),
            "nav_lon": (("j", "i"), lon, east({"bounds": "lon_v", **fill})),
            "lat_v": (("j", "i", "v"), corners, north()),
            "lon_v": (("j", "i", "v"), corners * 10, {}),
            "tos": (("time", "lev", "j", "i"), values, {"coordinates": "nav_lat nav_lon"}),
        },
    )
    got = joined(spark, tmp_path)
    assert len(got) == 24
    assert got[24001, 1, 4] == (5.0, 50.0, values[1, 1, 1, 1]) and got[24000, 1, 5] == (None, None, values[0, 1, 1, 2])
    cell = adapters.cells_of(scanned(spark, tmp_path).select("path").distinct(), str(tmp_path), "tos").where("cell = 1").first()
    assert (cell.y, cell.x, [c.lat for c in cell.corners]) == (0, 1, [1.5, 1.5, 2.5, 2.5])
    places = adapters.first_coordinates(spark, f"{tmp_path}/*.nc", scanned(spark, tmp_path).withColumn("model", F.lit("A")), "tos")
    assert places.columns[:2] == ["model", "cell"] and places.count() == 6


def test_list_of_cells_and_fixed_time(spark, tmp_path):
    """A field over one axis of cells, in a file whose time axis has a fixed length."""
    values = np.arange(8.0).reshape(2, 4)
    put(tmp_path, "a.nc", {"time": 2, "i": 4}, {"time": days(2), "clat": (("i",), np.array([1.0, 2, 3, 4]), north()), "clon": (("i",), np.array([5.0, 6, 7, 8]), east()), "tos": (("time", "i"), values, {})}, record="none")
    got = joined(spark, tmp_path)
    assert got == {(24000 + t, 0, i): (i + 1.0, i + 5.0, values[t, i]) for t in range(2) for i in range(4)}


def whole(n=6, cells=20):
    values = np.arange(float(n * cells)).reshape(n, cells)
    return {"time": n, "i": cells}, {"time": days(n), "clat": (("i",), np.arange(float(cells)), north()), "clon": (("i",), np.arange(float(cells)), east()), "tos": (("time", "i"), values, {})}


@pytest.mark.parametrize("short,why", [(1, "truncated: 5 of 6 steps of tos"), (50, "truncated: 5 of 6 steps of tos"), (200, "truncated: 4 of 6 steps of tos"), (900, "truncated: 0 of 6 steps of tos"), (1450, "truncated: the header is incomplete")])
def test_truncated_files_are_named(spark, tmp_path, short, why):
    put(tmp_path, "a.nc", *whole())
    raw = (tmp_path / "a.nc").read_bytes()
    (tmp_path / "b.nc").write_bytes(raw[:-short])
    assert [(r.name, r.why) for r in adapters.faults(spark, f"{tmp_path}/*.nc", "tos").collect()] == [("b.nc", why)]
    good = scanned(spark, tmp_path, skip_bad="true", deep_check="true")
    assert good.count() == 120 and good.where("path like '%b.nc'").count() == 0
    with pytest.raises(Exception, match="b.nc: truncated"):
        scanned(spark, tmp_path).collect()


def test_numbers_of_steps_left_open(spark, tmp_path):
    """A file that was never closed says -1 for its number of steps; the whole ones count."""
    put(tmp_path, "a.nc", *whole())
    raw = bytearray((tmp_path / "a.nc").read_bytes())
    raw[4:8] = b"\xff" * 4
    (tmp_path / "a.nc").write_bytes(bytes(raw[:-100]))
    assert scanned(spark, tmp_path).agg(F.countDistinct("time_index")).first()[0] == 5


@pytest.mark.parametrize("calendar", ["lunar", ""])
def test_unknown_calendars_raise(spark, tmp_path, calendar):
    dims, variables = whole()
    put(tmp_path, "a.nc", dims, variables | {"time": (("time",), np.arange(6.0), {"units": "days since 2000-01-01", "calendar": calendar})})
    with pytest.raises(Exception, match="unknown calendar"):
        scanned(spark, tmp_path).collect()
    assert "unknown calendar" in adapters.faults(spark, f"{tmp_path}/*.nc", "tos").first().why


def test_split_by_steps(spark, tmp_path):
    put(tmp_path, "a.nc", *whole(50))
    t = scanned(spark, tmp_path, split_bytes="1000")
    assert t.rdd.getNumPartitions() == -(-(tmp_path / "a.nc").stat().st_size // 1000)
    assert sorted((r.time_index, r.cell, r.value) for r in t.collect()) == [(k, i, k * 20.0 + i) for k in range(50) for i in range(20)]
    most = t.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.countDistinct("time_index").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 6


def test_months_choose_files_and_steps(spark, tmp_path):
    """Files outside the months aren't opened: those here cannot be read."""
    put(tmp_path, "tos_Omon_A_x_r1i1p1f1_gn_200001-200006.nc", *whole())
    for name in ("tos_Omon_A_x_r1i1p1f1_gn_199001-199912.nc", "tos_Omon_A_x_r1i1p1f1_gn_200101-200112.nc"):
        (tmp_path / name).write_bytes(b"not to be opened")
    t = scanned(spark, tmp_path, first_ym="24001", last_ym="24002")
    assert sorted({r.ym for r in t.collect()}) == [24001, 24002] and t.count() == 40
    # The same by filters, which the session pushes to the source.
    for where, months in (("ym between 24001 and 24002", [24001, 24002]), ("ym > 24003 and ym < 24009", [24004, 24005]), ("ym = 24000 and value < 5", [24000]), ("ym in (24002, 24005)", [24002, 24005])):
        assert sorted({r.ym for r in scanned(spark, tmp_path).where(where).collect()}) == months
    with pytest.raises(Exception, match="not a classic"):
        scanned(spark, tmp_path).collect()
    assert adapters.may_hold("no_dates.nc", 1, 2)


# -- calendars ------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(calendars.NAMES))
def test_dates_and_numbers(spark, name):
    """Back and forth over the gap of 1582, leap days and centuries, for ints and columns alike."""
    numbers = [*range(577_000, 579_000), *range(-800, 800, 7), *range(690_000, 800_000, 331)]
    want = {n: calendars.date(n, name) for n in numbers}
    assert all(calendars.day_number(*d, name) == n for n, d in want.items())
    assert all(want[a] < want[b] for a, b in zip(sorted(want), sorted(want)[1:]))
    y, m, d = calendars.date(F.col("n"), name)
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", y.alias("y"), m.alias("m"), d.alias("d"))
    rows = rows.withColumn("back", calendars.day_number(F.col("y"), F.col("m"), F.col("d"), name)).collect()
    assert {r.n: (r.y, r.m, r.d) for r in rows} == want and all(r.n == r.back for r in rows)


@pytest.mark.parametrize(
    "value,calendar,date",
    [
        (59, "standard", (2000, 2, 29)), (60, "proleptic_gregorian", (2000, 3, 1)), (59, "noleap", (2000, 3, 1)), (366, "all_leap", (2001, 1, 1)),
        (59, "360_day", (2000, 2, 30)), (365, "julian", (2000, 12, 31)), (-36524, "proleptic_gregorian", (1900, 1, 1)), (-36525, "julian", (1900, 1, 1)),
    ],
)
def test_literal_dates(value, calendar, date):
    assert calendars.date(calendars.day_number(2000, 1, 1, calendar) + value, calendar) == date


def test_days_that_do_not_exist(spark):
    for date, name in (((1582, 10, 10), "standard"), ((1900, 2, 29), "standard"), ((2001, 2, 29), "noleap"), ((2000, 1, 31), "360_day"), ((2000, 13, 1), "julian")):
        with pytest.raises(ValueError, match="no such day"):
            calendars.day_number(*date, name)
        y, m, d = map(F.lit, date)
        assert spark.range(1).select(calendars.day_number(y, m, d, name)).first()[0] is None
    assert calendars.day_number(1500, 2, 29, "standard") > 0 and calendars.day_number(2001, 2, 29, "all_leap") > 0
    assert calendars.day_number(1582, 10, 15, "standard") - calendars.day_number(1582, 10, 4, "standard") == 1
    with pytest.raises(ValueError, match="unknown calendar"):
        calendars.known("lunar")


def test_gregorian_as_the_library_has_it():
    first = calendars.day_number(1, 1, 1, "proleptic_gregorian")
    for k in range(0, 900_000, 997):
        d = datetime.date(1, 1, 1) + datetime.timedelta(k)
        assert calendars.date(first + k, "proleptic_gregorian") == (d.year, d.month, d.day)


@pytest.mark.parametrize(
    "date,years,calendar,back",
    [
        ((2000, 2, 29), 1, "standard", (1999, 2, 28)), ((2000, 2, 29), 1, "all_leap", (1999, 2, 29)), ((2000, 2, 30), 7, "360_day", (1993, 2, 30)),
        ((1900, 2, 29), 4, "julian", (1896, 2, 29)), ((1904, 2, 29), 4, "standard", (1900, 2, 28)), ((1604, 2, 29), 4, "standard", (1600, 2, 29)), ((1602, 10, 10), 20, "standard", (1582, 10, 15)),
    ],
)
def test_years_before(spark, date, years, calendar, back):
    assert calendars.years_before(*date, years, calendar) == back
    columns = calendars.years_before(*map(F.lit, date), years, calendar)
    assert tuple(spark.range(1).select(*columns).first()) == back


def test_months_of_steps():
    assert adapters.month_of(0.0, "days since 1582-10-04", "standard") == adapters.month_of(1.0, "days since 1582-10-04", "standard") == 1582 * 12 + 9
    assert adapters.month_of(366.0, "days since 2001-01-01", "julian") == 2002 * 12
    assert adapters.month_of(365.0, "days since 2001-01-01", "366_day") == 2001 * 12 + 11
    assert adapters.month_of(30 * 86400.0, "seconds since 2000-01-01 12:00:00", "360_day") == 24001
    assert adapters.month_of(0.5, "days since 2000-01-31 12:00:00", "standard") == 24001


def test_corners_are_convex(spark):
    places = views.with_corners(spark.createDataFrame([(-89.95, 0.0), (0.0, 359.0), (89.9, 10.0)], "lat double, lon double"))
    for r in places.collect():
        v = [np.array([np.cos(np.radians(c.lat)) * np.cos(np.radians(c.lon)), np.cos(np.radians(c.lat)) * np.sin(np.radians(c.lon)), np.sin(np.radians(c.lat))]) for c in r.corners]
        assert all(np.dot(np.cross(v[k], v[(k + 1) % 4]), v[(k + 2) % 4]) > 0 for k in range(4))


def test_wide_steps_are_read_and_written_by_chunks(spark, tmp_path):
    """More cells than a chunk: nothing that a task holds is a whole step, and every value is at its place."""
    n = adapters.CHUNK + 5000
    cells = spark.range(n).selectExpr("'M1' model", "id div 1000 j", "cast(id % 1000 as long) i", "cast(id % 180 - 90 as double) lat", "cast(id % 360 as double) lon")
    cells = cells.selectExpr("*", "array(named_struct('lat', lat, 'lon', lon), named_struct('lat', lat, 'lon', lon + 1), named_struct('lat', lat + 1, 'lon', lon)) corners")
    field = cells.where("i % 7 <> 3").crossJoin(spark.range(2)).selectExpr("model", "cast(24000 + 3 * id as int) ym", "j", "i", "cast(j * 1000 + i + id as double) value")
    for mesh in (True, False):
        (tmp_path / str(mesh)).mkdir()
        made = adapters.save_cells(field, cells, str(tmp_path / str(mesh)), "tos", {"units": "degC"}, mesh=mesh).collect()
        assert [(r.steps, r.cells) for r in made] == [(2, field.count())]
        reader = adapters.NetcdfReader({"variable": "tos", "path": f"{tmp_path}/{mesh}/*.nc"})
        batches = [b for p in reader.partitions() for b in reader.read(p)]
        assert len(batches) == 4 and max(b.num_rows for b in batches) == adapters.CHUNK
        got = {(ym, c): v for b in batches for ym, c, v in zip(*(b.column(k).to_pylist() for k in ("ym", "cell", "value"))) if v is not None}
        assert got == {(24000 + 3 * k, c): float(c + k) for k in (0, 1) for c in range(n) if c % 1000 % 7 != 3}
        places = adapters.cells_of(spark.createDataFrame([(made[0].path,)], "path string"), str(tmp_path / str(mesh)), "tos").where("lat is not null")
        assert places.count() == places.where("lat = cell % 180 - 90 and lon = cell % 360 and corners[1].lon = lon + 1 and corners[2].lat = lat + 1").count() == n


def test_list_files_of_several_models_are_whole(spark, tmp_path):
    """A field with fewer rows than there are cells: all that the files consist of comes by model already, in parts of different sizes."""
    n, models = 2000, 3
    cells = spark.range(n * models).selectExpr("concat('M', id % 3) model", "id div 3 div 100 j", "id div 3 % 100 i", "cast(id div 3 % 180 - 90 as double) lat", "cast(id div 3 % 360 as double) lon")
    cells = cells.selectExpr("*", "array(named_struct('lat', lat, 'lon', lon), named_struct('lat', lat, 'lon', lon + 1), named_struct('lat', lat + 1, 'lon', lon)) corners")
    field = spark.range(60).selectExpr("concat('M', id % 3) model", "cast(24000 + id % 2 as int) ym", "id div 6 j", "7 * id % 100 i", "cast(id as double) value")
    # Parts of 20 kB here stand for larger ones: the heads of files fit into one, cells do not.
    sizes = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000"}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        made = adapters.save_cells(field, cells, str(tmp_path), "tos", {"units": "degC"}, mesh=False).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.path.rpartition("/")[2], r.steps, r.cells) for r in made) == [(f"tos_M{m}.nc", 2, 20) for m in range(models)]
    t = scanned(spark, tmp_path)
    got = {(r.path[-5:-3], r.ym, r.cell): r.value for r in t.where("value is not null").collect()}
    assert t.count() == 2 * n * models and got == {(f"M{k % 3}", 24000 + k % 2, k // 6 * 100 + 7 * k % 100): float(k) for k in range(60)}
