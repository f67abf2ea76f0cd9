"""Conservative regridding of cells with corners, on the sphere.

A cell is a convex polygon of great-circle edges, its corners in either turn, as many as it
has; it may hold a pole or cross the date line, and spans less than 180 degrees of longitude
otherwise.  The cells of the target grid have great-circle edges as well, so that they tile the sphere without gaps.

``overlaps`` finds for each cell the target bins that its bounding box meets, by arithmetic,
and clips the cell against each in Arrow batches; areas are spherical excesses in steradians.  The
candidates of a cell follow from its own extent, and each is a row of its own, so no
task grows with a grid.  Cells without corners, or with missing ones, have no overlaps, as have cells of no area.

Weights can be stored, bucketed by source cell, under a digest of all that they depend on: a later
run with the same cells reads them and joins them where they lie.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import results
from .regrid import Grid

#: Overlaps below this part of their cell are noise of the last bits.
SLIVER = 1e-13
BUCKETS = 64
WEIGHTS = "cell_id long, lat_bin int, lon_bin int, overlap double, w double"


def unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=-1)


def areas(p: np.ndarray) -> np.ndarray:
    """Signed areas of polygons ``p`` (row, corner, 3), positive where corners turn left; repeated corners add nothing."""
    if p.shape[1] < 3:
        return np.zeros(len(p))
    a, b, c = p[:, :1], p[:, 1:-1], p[:, 2:]
    # Differences first, so that small cells keep their digits.
    volume = (a * np.cross(b - a, c - a)).sum(axis=2)
    return (2.0 * np.arctan2(volume, 1.0 + (a * b).sum(axis=2) + (b * c).sum(axis=2) + (c * a).sum(axis=2))).sum(axis=1)


def clipped(p: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """Polygons ``p`` cut to where their ``normal`` (row, 3) points; corners that are left over repeat the last one."""
    q = np.roll(p, -1, axis=1)
    d = (p * normal[:, None]).sum(axis=2)
    e = np.roll(d, -1, axis=1)
    crosses = (d > 0) & (e < 0) | (d < 0) & (e > 0)
    t = np.where(crosses, d / np.where(crosses, d - e, 1.0), 0.0)
    between = p + t[..., None] * (q - p)
    between /= np.linalg.norm(between, axis=2, keepdims=True)
    n, v = d.shape
    points = np.stack([p, between], axis=2).reshape(n, 2 * v, 3)
    keep = np.stack([d >= 0, crosses], axis=2).reshape(n, 2 * v)
    order = np.argsort(~keep, axis=1, kind="stable")
    count = keep.sum(axis=1)
    width = max(int(count.max(initial=0)), 3)
    place = np.minimum(np.arange(width), np.maximum(count - 1, 0)[:, None])
    out = np.take_along_axis(points, np.take_along_axis(order, place, axis=1)[..., None], axis=1)
    # Nothing left: one point, which has no area.
    return np.where((count > 0)[:, None, None], out, points[:, :1])


def overlap_areas(p: np.ndarray, south: np.ndarray, west: np.ndarray, resolution: float) -> np.ndarray:
    """Areas of polygons ``p`` that lie in the target cells with these lower left corners."""
    north, east = south + resolution, west + resolution
    corner = [unit(south, west), unit(south, east), unit(north, east), unit(north, west)]
    for k in range(4):
        # At a pole two corners are one, and their edge cuts nothing.
        p = clipped(p, np.cross(corner[k], corner[(k + 1) % 4]))
    return areas(p)


def wrapped(x: Column) -> Column:
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def target_area(grid: Grid, lat_bin: Column) -> Column:
    """Steradians of a target cell: a triangle from the pole to its lower parallel's chord less that to its upper one."""
    turn = math.radians(grid.resolution)

    def cap(lat: Column) -> Column:
        t = F.tan((math.pi / 2 - F.radians(lat)) / 2.0)
        # From the south pole the triangle is the whole lune less what lies below it.
        below = F.tan((math.pi / 2 + F.radians(lat)) / 2.0)
        north = 2.0 * F.atan2(t * t * math.sin(turn), 1.0 + t * t * math.cos(turn))
        south = 2.0 * turn - 2.0 * F.atan2(below * below * math.sin(turn), 1.0 + below * below * math.cos(turn))
        return F.when(lat >= 0, north).otherwise(south)

    low = -90.0 + lat_bin * grid.resolution
    return cap(low) - cap(low + grid.resolution)


def candidates(cells: DataFrame, grid: Grid) -> DataFrame:
    """``cells`` (cell_id, corners) with each target bin (lat_bin, lon_bin) that the cell may meet."""
    part = lambda c: F.transform("corners", lambda x: x[c])
    ok = (F.size("corners") >= 3) & ~F.exists("corners", lambda x: x.isNull() | x["lat"].isNull() | x["lon"].isNull() | F.isnan(x["lat"]) | F.isnan(x["lon"]) | (F.abs(x["lat"]) > 90.0) | (F.abs(x["lon"]) > 1e6))
    t = cells.select("cell_id", "corners").where(F.coalesce(ok, F.lit(False))).select("*", part("lat").alias("_lat"), part("lon").alias("_lon"))
    t = t.withColumn("_d", F.transform("_lon", lambda x: wrapped(x - F.get("_lon", F.lit(0)))))
    # Corners at a pole have no longitude of their own.
    turns = F.aggregate(F.sequence(F.lit(0), F.size("_lon") - 1), F.lit(0.0), lambda acc, k: acc + wrapped(F.get("_lon", F.pmod(k + 1, F.size("_lon"))) - F.get("_lon", k)))
    at_pole = F.exists("_lat", lambda x: F.abs(x) > 90.0 - 1e-9)
    t = t.withColumns({"_around": (F.abs(turns) > 180.0) | at_pole, "_low": F.array_min("_lat"), "_high": F.array_max("_lat"), "_from": F.array_min("_d"), "_to": F.array_max("_d")})
    # How far a great circle rises above a parallel between two of its points: that of the cell, and at most that of target edges.
    wide = F.when(F.col("_around"), F.lit(0.0)).otherwise(F.radians(F.least(F.col("_to") - F.col("_from"), F.lit(179.0)) / 2.0))
    rise = lambda x: F.degrees(F.atan(F.tan(F.radians(x)) / F.cos(wide)))
    half = math.cos(math.radians(grid.resolution) / 2.0)
    margin = max(math.degrees(math.atan(math.tan(math.radians(x / 10.0)) / half)) - x / 10.0 for x in range(900)) + 1e-6
    north, south = F.col("_around") & ((F.col("_low") + F.col("_high")) > 0), F.col("_around") & ((F.col("_low") + F.col("_high")) <= 0)
    top = F.when(north | F.col("_around") & (F.col("_high") > 0), F.lit(90.0)).when(F.col("_high") > 0, rise(F.col("_high"))).otherwise(F.col("_high"))
    bottom = F.when(south | F.col("_around") & (F.col("_low") < 0), F.lit(-90.0)).when(F.col("_low") < 0, rise(F.col("_low"))).otherwise(F.col("_low"))
    row = lambda x: F.greatest(F.lit(0), F.least(F.lit(grid.n_lat - 1), F.floor((x + 90.0) / grid.resolution).cast("int")))
    t = t.withColumn("lat_bin", F.explode(F.sequence(row(bottom - margin), row(top + margin))))
    first = F.floor((wrapped(F.get("_lon", F.lit(0))) + F.col("_from") + 180.0 - 1e-9) / grid.resolution).cast("int")
    last = F.floor((wrapped(F.get("_lon", F.lit(0))) + F.col("_to") + 180.0 + 1e-9) / grid.resolution).cast("int")
    steps = F.when(F.col("_around"), F.sequence(F.lit(0), F.lit(grid.n_lon - 1))).otherwise(F.sequence(first, F.least(last, first + grid.n_lon - 1)))
    return t.select("cell_id", "corners", "lat_bin", F.explode(F.transform(steps, lambda k: F.pmod(k, F.lit(grid.n_lon)))).alias("lon_bin"))


def overlaps(cells: DataFrame, grid: Grid) -> DataFrame:
    """(cell_id, lat_bin, lon_bin, overlap, area): the steradians of each cell in each target cell that it meets, and the cell's own."""
    key = dict(cells.dtypes)["cell_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            around = batch.column("corners")
            flat = around.flatten()
            count = around.value_lengths().to_numpy()
            if not len(count):
                continue
            start = np.cumsum(count) - count
            width = int(count.max())
            at = start[:, None] + np.minimum(np.arange(width), count[:, None] - 1)
            lat, lon = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon"))
            p = unit(lat, lon)[at]
            own = areas(p)
            p = np.where((own < 0)[:, None, None], p[:, ::-1], p)
            own = np.abs(own)
            lat_bin, lon_bin = (batch.column(c).to_numpy() for c in ("lat_bin", "lon_bin"))
            overlap = overlap_areas(p, -90.0 + lat_bin * grid.resolution, -180.0 + lon_bin * grid.resolution, grid.resolution)
            some = pa.array(overlap > SLIVER * own)
            yield pa.RecordBatch.from_arrays([batch.column("cell_id"), batch.column("lat_bin"), batch.column("lon_bin"), pa.array(overlap), pa.array(own)], ["cell_id", "lat_bin", "lon_bin", "overlap", "area"]).filter(some)

    return candidates(cells, grid).mapInArrow(run, f"cell_id {key}, lat_bin int, lon_bin int, overlap double, area double")


def conservative(cells: DataFrame, grid: Grid) -> DataFrame:
    """(cell_id, lat_bin, lon_bin, overlap, w): ``w`` is the share of the target cell that lies in the cell."""
    return overlaps(cells, grid).select("cell_id", "lat_bin", "lon_bin", "overlap", (F.col("overlap") / target_area(grid, F.col("lat_bin"))).alias("w"))


def applied(field: DataFrame, weights: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """(by, lat_bin, lon_bin, value, covered, overlap): means of ``field`` (by, cell_id, value) over what is there of each target cell."""
    t = field.where(F.col(value).isNotNull()).join(weights, "cell_id")
    mean = (F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value)
    return t.groupBy(*by, "lat_bin", "lon_bin").agg(mean, F.sum("w").alias("covered"), F.sum("overlap").alias("overlap"))


def digest(cells: DataFrame, grid: Grid) -> str:
    """What the weights of ``cells`` depend on, whatever the order of the rows, as hexadecimal text."""
    row = F.to_json(F.struct("cell_id", "corners"), {"ignoreNullFields": "false"})
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring(F.md5(row), k, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    found = cells.agg(F.count("*").cast("string").alias("n"), part(1).alias("a"), part(17).alias("b")).first()
    return hashlib.sha256(f"{grid.resolution!r} {found.n} {found.a} {found.b}".encode()).hexdigest()[:32]


def stored(cells: DataFrame, grid: Grid, folder: str, buckets: int = BUCKETS) -> tuple[DataFrame, bool]:
    """``conservative`` weights from ``folder``, computed and put there only if they aren't; and whether they were.

    They are a table in buckets of ``cell_id``: a join by it takes them without an exchange.
    """
    spark = cells.sparkSession
    path = f"{folder.rstrip('/')}/weights-{digest(cells, grid)}"
    name = f"weights_{uuid.uuid4().hex}"
    # Written beside and renamed, so that weights which are there are whole.
    there = results.exists(spark, path)
    if not there:
        part = f"{path}.{name}"
        # Dealt as the buckets are, so that each is one file.
        conservative(cells, grid).repartition(buckets, "cell_id").write.bucketBy(buckets, "cell_id").sortBy("cell_id").option("path", part).saveAsTable(f"{name}_new")
        spark.sql(f"drop table {name}_new")
        results.put(spark, part, path)
    spark.sql(f"create table {name} ({WEIGHTS}) using parquet clustered by (cell_id) sorted by (cell_id) into {buckets} buckets location '{path}'")
    return spark.table(name), there

