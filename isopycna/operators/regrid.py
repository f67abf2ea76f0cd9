"""Regridding to a regular latitude/longitude grid, and coarsening.

Cells fall into target bins by arithmetic, never by a range join.  The nearest
neighbour is looked for among cells of nearby bins only: a target cell asks the
bins within the cutoff (all longitudes near the poles), so the candidates of a
cell do not grow with the source grid's extent.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo


@dataclass(frozen=True)
class Grid:
    """Regular grid of ``resolution`` degrees; bins are half-open, so latitude 90 itself is outside."""

    resolution: float = 10.0

    def __post_init__(self):
        if self.resolution <= 0 or 180 % self.resolution:
            raise ValueError("the resolution must divide 180")

    @property
    def n_lat(self) -> int:
        return int(180 / self.resolution)

    @property
    def n_lon(self) -> int:
        return 2 * self.n_lat

    def lat_bin(self, lat: Column) -> Column:
        return geo.bin_of(lat, -90.0, self.resolution, self.n_lat)

    def lon_bin(self, nlon: Column) -> Column:
        return geo.bin_of(nlon, -180.0, self.resolution, self.n_lon)

    def mesh(self, spark: SparkSession) -> DataFrame:
        """(lat_bin, lon_bin, lat, lon) of the centres."""
        k = spark.range(self.n_lat * self.n_lon)
        lat, lon = F.floor(F.col("id") / self.n_lon).cast("int"), (F.col("id") % self.n_lon).cast("int")
        center = lambda b, low: low + (b + 0.5) * self.resolution
        return k.select(lat.alias("lat_bin"), lon.alias("lon_bin"), center(lat, -90.0).alias("lat"), center(lon, -180.0).alias("lon"))

    def assign(self, cells: DataFrame) -> DataFrame:
        """``cells`` (lat, nlon) with their bins; cells outside the grid are dropped."""
        return cells.withColumn("lat_bin", self.lat_bin(F.col("lat"))).withColumn("lon_bin", self.lon_bin(F.col("nlon"))).where("lat_bin is not null and lon_bin is not null")


def binned(cells: DataFrame, value: str, grid: Grid, by: tuple[str, ...] = ("model", "ym")) -> DataFrame:
    """Area-weighted mean of each target cell and the area it comes from; cells without a value or area don't count."""
    ok = F.col(value).isNotNull() & (F.col("area") > 0)
    t = grid.assign(cells.where(ok))
    return t.groupBy(*by, "lat_bin", "lon_bin").agg((F.sum(F.col(value) * F.col("area")) / F.sum("area")).alias(value), F.sum("area").alias("source_area_sum"))


def coarsened(cells: DataFrame, value: str, by: tuple[str, ...] = ("model", "ym"), factor: int = 2) -> DataFrame:
    """Weighted mean of blocks; a missing value adds nothing, but its area stays in the denominator."""
    return blocks(cells, by, factor).agg(*_weighted(value))


def coarsened_rows(rows: DataFrame, places: DataFrame, value: str, parts: int, by: tuple[str, ...] = ("model", "ym"), factor: int = 2) -> DataFrame:
    """As ``coarsened`` of the mean of each cell over ``rows`` (by, cell_id, value), at ``places`` (cell_id, j, i, area).

    Rows are dealt by block into ``parts`` tasks, in which both the cells and the blocks are summed: one exchange, and
    tasks whose size is the caller's choice, where Spark's would each take as much as fits a shuffle partition.
    """
    at = ["j_block", "i_block"]
    # A place listed twice counts twice, as it would in a join with the means.
    area = places.groupBy("cell_id", *_block("ji", factor)).agg(F.sum("area").alias("area"))
    dealt = rows.select(*by, "cell_id", value).join(area, "cell_id").repartition(parts, *by, *at)
    means = dealt.groupBy(*by, *at, "cell_id").agg(F.avg(value).alias(value), F.max("area").alias("area"))
    return means.groupBy(*by, *at).agg(*_weighted(value))


def parts(table: DataFrame, each: int = 250_000) -> int:
    """Tasks for the rows of a stored ``table``: one for so many rows, and no fewer than run at once."""
    return max(table.sparkSession.sparkContext.defaultParallelism, math.ceil(table.count() / each))


def blocks(cells: DataFrame, by: tuple[str, ...], factor: int):
    return cells.groupBy(*by, *_block("ji", factor))


def _block(axes: str, factor: int) -> list[Column]:
    return [F.floor(F.col(c) / factor).cast("long").alias(f"{c}_block") for c in axes]


def _weighted(value: str) -> list[Column]:
    v = F.coalesce(F.sum(F.col(value) * F.col("area")), F.lit(0.0)) / F.nullif(F.sum("area"), F.lit(0.0))
    return [v.alias(value), F.sum("area").alias("area")]


def nearest(source: DataFrame, grid: Grid, spark: SparkSession, degrees: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, lat_bin, lon_bin, cell_id, chord): the nearest of ``source`` (by, cell_id, lat, nlon) by chord within ``degrees``, for each key; ties go to the smaller id.

    A target cell asks the bins around its own that the cutoff reaches, but none that begin farther off than the
    nearest cell of its own bin: where cells are dense, it asks few, and a cell is compared a few times only.
    """
    cutoff = 3.0 * grid.resolution if degrees is None else degrees
    limit = 2.0 * math.sin(math.radians(cutoff) / 2.0)
    # Unit vectors are formed before the join, so that a pair costs a few products.
    src = grid.assign(source).select(*by, "cell_id", F.col("lat_bin").alias("s_lat"), F.col("lon_bin").alias("s_lon"), *_vector("lat", "nlon", "b"))
    # Rounding is dear, so most pairs go before it.
    near = asked(src, grid, cutoff, by).join(src, [*by, "s_lat", "s_lon"]).withColumn("square", _square()).where(F.col("square") < limit * limit + 1e-6)
    near = near.withColumn("chord", F.round(F.sqrt("square"), 9)).where(F.col("chord") < limit)
    best = near.groupBy(*by, "lat_bin", "lon_bin").agg(F.min(F.struct("chord", "cell_id")).alias("m"))
    return best.select(*by, "lat_bin", "lon_bin", "m.cell_id", "m.chord")


def _vector(lat: str, lon: str, k: str) -> list[Column]:
    return [v.alias(f"{k}{i}") for i, v in enumerate(geo.unit_vector(F.col(lat), F.col(lon)))]


def _square() -> Column:
    gap = [F.col(f"a{i}") - F.col(f"b{i}") for i in range(3)]
    return gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]


def asked(src: DataFrame, grid: Grid, cutoff: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, lat_bin, lon_bin, s_lat, s_lon, a0 to a2): the bins of ``src`` (by, s_lat, s_lon, b0 to b2) in which the nearest cell of a target cell may be."""
    limit = 2.0 * math.sin(math.radians(cutoff) / 2.0)
    reach = math.ceil(cutoff / grid.resolution)
    target = grid.mesh(src.sparkSession)
    lat_steps = F.explode(F.sequence(F.greatest(F.col("lat_bin") - reach, F.lit(0)), F.least(F.col("lat_bin") + reach, F.lit(grid.n_lat - 1)))).alias("s_lat")
    asked = target.select("*", lat_steps)
    # A parallel shortens with the cosine of its latitude, so poleward more longitudes are near.
    poleward = F.greatest(F.abs(F.col("s_lat") * grid.resolution - 90.0), F.abs((F.col("s_lat") + 1) * grid.resolution - 90.0), F.abs("lat"))
    width = F.when(poleward + cutoff >= 90.0, F.lit(grid.n_lon)).otherwise(
        F.ceil(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(cutoff)) / F.cos(F.radians(poleward))))) / grid.resolution) + 1
    )
    width = F.least(width, F.lit(grid.n_lon // 2)).cast("int")
    around = F.array_distinct(F.transform(F.sequence(-width, width), lambda k: F.pmod(F.col("lon_bin") + k, F.lit(grid.n_lon))))
    asked = asked.select("lat_bin", "lon_bin", "lat", "lon", "s_lat", *_vector("lat", "lon", "a"), F.explode(around).alias("s_lon"))
    # How far off a bin begins, at least: by latitude, and by the nearer of its meridians.
    between = lambda x, low: F.greatest(F.lit(0.0), low - x, x - low - grid.resolution)
    turn = F.abs(F.pmod(F.col("s_lon") - F.col("lon_bin") + grid.n_lon // 2, F.lit(grid.n_lon)) - grid.n_lon // 2)
    aside = F.least(F.greatest(F.lit(0.0), (turn - 0.5) * grid.resolution), F.lit(90.0))
    off = F.greatest(F.radians(between(F.col("lat"), F.col("s_lat") * grid.resolution - 90.0)), F.asin(F.sin(F.radians(aside)) * F.cos(F.radians("lat"))))
    asked = asked.withColumn("begins", 4.0 * F.pow(F.sin(off / 2.0), F.lit(2.0))).drop("lat", "lon")
    own = F.broadcast(target.select("lat_bin", "lon_bin", *_vector("lat", "lon", "a")))
    best = src.join(own, (F.col("s_lat") == F.col("lat_bin")) & (F.col("s_lon") == F.col("lon_bin"))).groupBy(*by, "lat_bin", "lon_bin").agg(F.min(_square()).alias("most"))
    if by:
        # Every target cell of each key asks, also those whose own bin has none.
        best = best.select(*by).distinct().crossJoin(F.broadcast(target.select("lat_bin", "lon_bin"))).join(best, [*by, "lat_bin", "lon_bin"], "left")
    return F.broadcast(asked).join(best, ["lat_bin", "lon_bin"], "inner" if by else "left").where(F.col("begins") <= F.coalesce("most", F.lit(limit * limit)) + 1e-6).drop("begins", "most")


def nearest_valid(field: DataFrame, value: str, grid: Grid, degrees: float | None = None, by: tuple[str, ...] = ("model", "ym")) -> DataFrame:
    """(by, lat_bin, lon_bin, cell_id, chord): for each slice of ``field`` (by, cell_id, lat, nlon, value) the nearest of the cells that have a value in it.

    Slices are grouped by a digest of their valid cells, and each distinct set is searched once: a
    model whose land never changes asks once for all its months.  Slices without any valid cell have no rows.
    """
    valid = field.where(F.col(value).isNotNull()).select(*by, "cell_id", "lat", "nlon")
    # Two sums and a number tell sets apart; sums are formed before rows are exchanged.
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "cell_id", "lat", "nlon").cast("decimal(20,0)"))
    slices = valid.groupBy(*by).agg(F.concat_ws(":", F.count("*").cast("string"), h(1).cast("string"), h(2).cast("string")).alias("mask"))
    one = slices.groupBy("mask").agg(F.min(F.struct(*by)).alias("_one")).select("mask", *(F.col(f"_one.{c}").alias(c) for c in by))
    found = nearest(valid.join(one, list(by)).select("mask", "cell_id", "lat", "nlon"), grid, field.sparkSession, degrees, ("mask",))
    return slices.join(found, "mask").select(*by, "lat_bin", "lon_bin", "cell_id", "chord")


def bilinear_weights(spark: SparkSession, source: Grid, target: Grid, periodic: bool) -> DataFrame:
    """(lat_bin, lon_bin, s_lat, s_lon, w): the four source centres around each target centre; without ``periodic``, centres beyond the last column have none."""
    t = target.mesh(spark)
    y, x = (F.col("lat") + 90.0) / source.resolution - 0.5, (F.col("lon") + 180.0) / source.resolution - 0.5
    t = t.withColumn("y", y).withColumn("x", x).withColumn("y0", F.floor("y")).withColumn("x0", F.floor("x"))
    corner = lambda dy, dx: F.struct(
        (F.col("y0") + dy).cast("int").alias("s_lat"), (F.col("x0") + dx).cast("int").alias("s_lon"),
        ((1.0 - F.abs(F.col("y") - F.col("y0") - dy)) * (1.0 - F.abs(F.col("x") - F.col("x0") - dx))).alias("w"),
    )
    rows = t.select("lat_bin", "lon_bin", F.explode(F.array(*(corner(dy, dx) for dy in (0, 1) for dx in (0, 1)))).alias("c")).select("lat_bin", "lon_bin", "c.*")
    if periodic:
        rows = rows.withColumn("s_lon", F.pmod("s_lon", F.lit(source.n_lon)))
    inside = F.col("s_lat").between(0, source.n_lat - 1) & F.col("s_lon").between(0, source.n_lon - 1)
    return rows.where(inside & (F.col("w") > 0))


def conservative_weights(spark: SparkSession, source: Grid, target: Grid) -> DataFrame:
    """(lat_bin, lon_bin, s_lat, s_lon, w): the share of each target cell's area on the sphere that lies in each source cell."""
    t = target.mesh(spark).select("lat_bin", "lon_bin")

    def overlaps(k: str, low: float, n: int, measure) -> Column:
        """The source bins that a target bin meets on one axis, with the share of it that lies in them."""
        a, b = low + F.col(k) * target.resolution, low + (F.col(k) + 1) * target.resolution
        first = F.floor(F.col(k) * target.resolution / source.resolution)
        last = F.least(F.ceil((F.col(k) + 1) * target.resolution / source.resolution) - 1, F.lit(n - 1))

        def part(i: Column) -> Column:
            c, d = low + i * source.resolution, low + (i + 1) * source.resolution
            return F.struct(i.cast("int").alias("i"), ((measure(F.least(b, d)) - measure(F.greatest(a, c))) / (measure(b) - measure(a))).alias("w"))

        return F.transform(F.sequence(first.cast("int"), last.cast("int")), part)

    on_sphere = lambda x: F.sin(F.radians(x))
    t = t.withColumn("y", F.explode(overlaps("lat_bin", -90.0, source.n_lat, on_sphere))).withColumn("x", F.explode(overlaps("lon_bin", -180.0, source.n_lon, lambda x: x)))
    return t.select("lat_bin", "lon_bin", F.col("y.i").alias("s_lat"), F.col("x.i").alias("s_lon"), (F.col("y.w") * F.col("x.w")).alias("w")).where("w > 0")


def nearest_weights(spark: SparkSession, source: Grid, target: Grid, to_target: bool = True) -> DataFrame:
    """Weights of 1: from the nearest source centre to each target centre, or, without ``to_target``, from each source centre to its nearest target centre."""
    one, other = (target, source) if to_target else (source, target)
    # Half-way centres go to the lower bin.
    near = lambda c, low, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), (F.ceil((F.col(c) - low) / other.resolution) - 1).cast("int")))
    m = one.mesh(spark).select("lat_bin", "lon_bin", near("lat", -90.0, other.n_lat).alias("o_lat"), near("lon", -180.0, other.n_lon).alias("o_lon"))
    names = ("lat_bin", "lon_bin", "s_lat", "s_lon") if to_target else ("s_lat", "s_lon", "lat_bin", "lon_bin")
    return m.toDF(*names).select("lat_bin", "lon_bin", "s_lat", "s_lon", F.lit(1.0).alias("w"))


def apply_normed(field: DataFrame, weights: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Sparse product over what is there, divided by the weights of it; ``covered`` is their sum."""
    joined = field.withColumnsRenamed({"lat_bin": "s_lat", "lon_bin": "s_lon"}).where(F.col(value).isNotNull()).join(weights, ["s_lat", "s_lon"])
    return joined.groupBy(*by, "lat_bin", "lon_bin").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value), F.sum("w").alias("covered"))


def triangulated(field: DataFrame, source: Grid, degrees: int, value: str, by: tuple[str, ...]) -> DataFrame:
    """(by, lat, lon, value) at every ``degrees``: linear within the two triangles of each four neighbouring centres of ``source``.

    A point on an edge belongs to the first triangle that has it; points outside all triangles have no row.
    Each triangle asks only the points of its own bounding box.
    """
    r = source.resolution
    f = field.where(F.col(value).isNotNull()).select(*by, "lat_bin", "lon_bin", F.col(value).alias("v"))
    corner = lambda dy, dx: F.struct(F.lit(2 * dy + dx).alias("k"), (F.col("lat_bin") - dy).alias("y"), (F.col("lon_bin") - dx).alias("x"))
    # Every centre stands at a corner of up to four squares of centres; only those are gathered.
    squares = f.select(*by, "v", F.explode(F.array(*(corner(dy, dx) for dy in (0, 1) for dx in (0, 1)))).alias("c")).select(*by, "v", "c.*")
    each = [F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k}") for k in range(4)]
    squares = squares.groupBy(*by, "y", "x").agg(*each).where(f"y between 0 and {source.n_lat - 2} and x between 0 and {source.n_lon - 2}")
    low = lambda c, base: base + (F.col(c) + 0.5) * r
    points = lambda a: F.transform(F.sequence(F.ceil(a / degrees).cast("int"), F.floor((a + r) / degrees).cast("int")), lambda k: k * degrees)
    p = squares.withColumn("lat", F.explode(points(low("y", -90.0)))).withColumn("lon", F.explode(points(low("x", -180.0))))
    b, a = (F.col("lat") - low("y", -90.0)) / r, (F.col("lon") - low("x", -180.0)) / r
    # The lower left triangle has the corners 0, 1, 2, the upper right one 3, 2, 1.
    lower = F.when(a + b <= 1.0, F.col("v0") + a * (F.col("v1") - F.col("v0")) + b * (F.col("v2") - F.col("v0")))
    upper = F.when(a + b > 1.0, F.col("v3") + (1.0 - a) * (F.col("v2") - F.col("v3")) + (1.0 - b) * (F.col("v1") - F.col("v3")))
    p = p.withColumn(value, F.coalesce(lower, upper)).where(F.col(value).isNotNull())
    return p.groupBy(*by, "lat", "lon").agg(F.min(F.struct("y", "x", value))[value].alias(value))


def nearest_on_axis(axis: DataFrame, name: str, low: float, resolution: float, n: int) -> DataFrame:
    """(target, value): for each of ``n`` centres the nearest of ``axis``; ties go to the smaller value.

    The nearest one is the highest or lowest of a half bin, so only those, at most 4n, meet the centres.
    """
    half = F.floor((F.col(name) - low) / (resolution / 2.0))
    ends = axis.groupBy(half.alias("h")).agg(F.min(name).alias("a"), F.max(name).alias("b")).select(F.explode(F.array_distinct(F.array("a", "b"))).alias("value"))
    target = axis.sparkSession.range(n).select((low + (F.col("id") + 0.5) * resolution).alias("target"))
    best = F.min(F.struct(F.round(F.abs(F.col("value") - F.col("target")), 9).alias("gap"), F.col("value"))).alias("m")
    return F.broadcast(target).crossJoin(ends).groupBy("target").agg(best).select("target", "m.value")


def apply_weights(field: DataFrame, weights: DataFrame, value: str, by: tuple[str, ...], full: float = 1.0 - 1e-9) -> DataFrame:
    """Sparse product; a target cell needs all its weights."""
    joined = field.withColumnsRenamed({"lat_bin": "s_lat", "lon_bin": "s_lon"}).where(F.col(value).isNotNull()).join(weights, ["s_lat", "s_lon"])
    out = joined.groupBy(*by, "lat_bin", "lon_bin").agg(F.sum(F.col("w") * F.col(value)).alias(value), F.sum("w").alias("_w"))
    return out.where(F.col("_w") >= full).drop("_w")


def corner_mesh(cells: DataFrame, value: str = "corners") -> DataFrame:
    """(j, i, corner) on the mesh of one more row and column, from cells (j, i, corners) with corners lower left, lower right, upper right, upper left.

    Each cell gives its lower left corner; the last column, row and cell also give the others.
    """
    c = F.col(value)
    ends = cells.agg(F.max("j").alias("_mj"), F.max("i").alias("_mi"))
    corner = lambda ok, dj, di, k: F.when(ok, F.struct((F.col("j") + dj).alias("j"), (F.col("i") + di).alias("i"), c[k].alias("corner")))
    right, top = F.col("i") == F.col("_mi"), F.col("j") == F.col("_mj")
    each = F.array_compact(F.array(corner(F.lit(True), 0, 0, 0), corner(right, 0, 1, 1), corner(right & top, 1, 1, 2), corner(top, 1, 0, 3)))
    return cells.join(F.broadcast(ends)).select(F.explode(each).alias("m")).select("m.*")
