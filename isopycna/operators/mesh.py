"""Bilinear weights on curvilinear meshes: (j, i) places with latitudes and longitudes, and a seam where the last column meets the first.

Four neighbouring places make a quadrilateral of great-circle edges.  Each asks only the
target centres in its own bounding box.  Seen from such a centre (gnomonic projection, in
which great circles are straight) the quadrilateral is plane, and the centre's place in it
follows from a quadratic equation, solved for whole Arrow batches.  A
centre on an edge belongs to the quadrilateral of smallest (j, i); centres in none have no
weights.  Patch recovery fits a quadratic surface to the nine places around each of the four, in the
plane of the centre, after stretching the nine to equal extents, and blends their values there with the bilinear weights; where fewer than
``LEAST`` of nine are there, as at the rim of the mesh, or they lie along a curve, a place gives its own value.  Places without coordinates make no quadrilaterals, and those over 90 degrees from a centre don't hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regrid import Grid

#: Beyond the unit square by so much still counts as on its edge.
EDGE = 1e-10
#: Places that a patch needs.
LEAST = 7
#: Below this part of the greatest extent of a patch the least one is noise.
FLAT = 1e-6


def squares(places: DataFrame, n_i: int | None = None) -> DataFrame:
    """(y, x, v0, v1, v2, v3) of the complete squares of ``places`` (cell_id, j, i, lat, lon), counter-clockwise from (j, i); with ``n_i`` columns the last meets the first."""
    ok = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")

    def at(k: int, dj: int, di: int) -> Column:
        x = F.col("i") - di
        x = F.pmod(x, F.lit(n_i)) if n_i else x
        return F.struct(F.lit(k).alias("k"), (F.col("j") - dj).cast("long").alias("y"), x.cast("long").alias("x"))

    # A place stands at a corner of up to four squares; only those are gathered.
    corner = F.explode(F.array(at(0, 0, 0), at(1, 0, 1), at(2, 1, 1), at(3, 1, 0))).alias("c")
    each = places.where(ok).select(F.struct("lat", "lon", "cell_id").alias("v"), corner).select("v", "c.*")
    out = each.groupBy("y", "x").agg(*(F.first(F.when(F.col("k") == k, F.col("v")), ignorenulls=True).alias(f"v{k}") for k in range(4)))
    return out.where(" and ".join(f"v{k} is not null" for k in range(4)))


def centres(quads: DataFrame, grid: Grid) -> DataFrame:
    """``quads`` with each target centre (lat_bin, lon_bin, lat, lon) of its bounding box."""
    lat, lon = (lambda k: F.col(f"v{k}.lat")), (lambda k: F.col(f"v{k}.lon"))
    off = [F.pmod(lon(k) - lon(0) + 180.0, F.lit(360.0)) - 180.0 for k in range(4)]
    low, high = F.least(*off), F.greatest(*off)
    # A square around a pole turns once; its box is a cap.
    turn = sum((F.pmod(lon((k + 1) % 4) - lon(k) + 180.0, F.lit(360.0)) - 180.0 for k in range(4)), F.lit(0.0))
    around = F.abs(turn) > 180.0
    wide = F.radians(F.least(high - low, F.lit(179.0)) / 2.0)
    rise = lambda x: F.degrees(F.atan(F.tan(F.radians(x)) / F.cos(wide)))
    south, north = F.least(*map(lat, range(4))), F.greatest(*map(lat, range(4)))
    top = F.when(around & (north > 0), 90.0).when(north > 0, rise(north)).otherwise(north)
    bottom = F.when(around & (south < 0), -90.0).when(south < 0, rise(south)).otherwise(south)
    r = grid.resolution
    first, last = F.greatest(F.lit(0), F.ceil((bottom + 90.0) / r - 0.5 - 1e-9).cast("int")), F.least(F.lit(grid.n_lat - 1), F.floor((top + 90.0) / r - 0.5 + 1e-9).cast("int"))
    rows = F.when(first <= last, F.sequence(first, last))
    west, east = F.ceil((lon(0) + low + 180.0) / r - 0.5 - 1e-9).cast("int"), F.floor((lon(0) + high + 180.0) / r - 0.5 + 1e-9).cast("int")
    columns = F.when(around, F.sequence(F.lit(0), F.lit(grid.n_lon - 1))).when(west <= east, F.transform(F.sequence(west, east), lambda k: F.pmod(k, F.lit(grid.n_lon))))
    t = quads.withColumn("lat_bin", F.explode(rows)).withColumn("lon_bin", F.explode(columns))
    return t.withColumns({"lat": -90.0 + (F.col("lat_bin") + 0.5) * r, "lon": -180.0 + (F.col("lon_bin") + 0.5) * r})


def inverse(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the origin lies between the corners (row, 4) of plane quadrilaterals, along the first edge and across it; NaN where outside."""
    vector = lambda c: np.stack([c[:, 1] - c[:, 0], c[:, 3] - c[:, 0], c[:, 0] - c[:, 1] + c[:, 2] - c[:, 3], -c[:, 0]])
    ex, fx, gx, hx = vector(x)
    ey, fy, gy, hy = vector(y)
    k2, k1, k0 = gx * fy - gy * fx, ex * fy - ey * fx + hx * gy - hy * gx, hx * ey - hy * ex
    with np.errstate(invalid="ignore", divide="ignore"):
        root = np.sqrt(k1 * k1 - 4.0 * k0 * k2)
        # The stable form of both roots; of a parallelogram only the second is finite.
        half = -0.5 * (k1 + np.where(k1 < 0, -root, root))
        s, t = np.full(len(x), np.nan), np.full(len(x), np.nan)
        for v in (k0 / half, half / k2):
            dx, dy = ex + gx * v, ey + gy * v
            u = np.where(np.abs(dx) >= np.abs(dy), (hx - fx * v) / dx, (hy - fy * v) / dy)
            inside = np.isnan(s) & (v >= -EDGE) & (v <= 1.0 + EDGE) & (u >= -EDGE) & (u <= 1.0 + EDGE)
            s, t = np.where(inside, u, s), np.where(inside, v, t)
    return np.clip(s, 0.0, 1.0), np.clip(t, 0.0, 1.0)


def plane(lat: np.ndarray, lon: np.ndarray, at_lat: np.ndarray, at_lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (row, k) as seen from one place a row, in degrees: x to the east, y to the north, and which are in front; great circles are straight."""
    a, b, d = np.radians(at_lat)[:, None], np.radians(lat), np.radians(lon) - np.radians(at_lon)[:, None]
    depth = np.sin(a) * np.sin(b) + np.cos(a) * np.cos(b) * np.cos(d)
    front = depth > 1e-6
    depth = np.where(front, depth, 1.0)
    return np.cos(b) * np.sin(d) / depth, (np.cos(a) * np.sin(b) - np.sin(a) * np.cos(b) * np.cos(d)) / depth, front


def placed(t: DataFrame) -> DataFrame:
    """``t`` (y, x, v0 to v3, lat_bin, lon_bin, lat, lon and others) with ``s`` and ``t``, where the centre lies between the corners; only those it lies in."""
    names = t.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            corner = lambda c: np.stack([batch.column(f"v{k}").field(c).to_numpy(zero_copy_only=False) for k in range(4)], axis=1)  # noqa: B023, E731
            x, y, front = plane(corner("lat"), corner("lon"), batch.column("lat").to_numpy(), batch.column("lon").to_numpy())
            s, u = inverse(x, y)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(s), pa.array(u)], [*names, "s", "t"])
            yield out.filter(pa.array(front.all(axis=1) & ~np.isnan(s)))

    kinds = dict(t.dtypes)
    return t.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", s double, t double")


def bilinear(places: DataFrame, grid: Grid, n_i: int | None = None) -> DataFrame:
    """(lat_bin, lon_bin, cell_id, w): the four places around each target centre that lies in the mesh; their weights add up to one."""
    t = placed(centres(squares(places, n_i), grid))
    s, u = F.col("s"), F.col("t")
    four = F.array(*(F.struct(F.col(f"v{k}.cell_id").alias("cell_id"), w.alias("w")) for k, w in enumerate(((1 - s) * (1 - u), s * (1 - u), s * u, (1 - s) * u))))
    best = t.groupBy("lat_bin", "lon_bin").agg(F.min(F.struct("y", "x", four.alias("four"))).alias("m"))
    return best.select("lat_bin", "lon_bin", F.explode("m.four").alias("p")).select("lat_bin", "lon_bin", "p.cell_id", "p.w").where("w > 0")


#: Places of the four by four around a square, by rows from below, that make the patches of its corners 0 to 3; the fifth of each is the corner.
PATCHES = [[(a + da) * 4 + b + db for da in range(3) for db in range(3)] for a, b in ((0, 0), (0, 1), (1, 1), (1, 0))]


def surroundings(places: DataFrame, n_i: int | None = None) -> DataFrame:
    """(y, x, around): the up to sixteen places (k, lat, lon, cell_id) in and around each square."""
    ok = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")

    def at(k: int) -> Column:
        x = F.col("i") - (k % 4 - 1)
        x = F.pmod(x, F.lit(n_i)) if n_i else x
        return F.struct(F.lit(k).alias("k"), (F.col("j") - (k // 4 - 1)).cast("long").alias("y"), x.cast("long").alias("x"))

    each = places.where(ok).select("lat", "lon", "cell_id", F.explode(F.array(*map(at, range(16)))).alias("c"))
    # At most sixteen rows a square.
    return each.groupBy("c.y", "c.x").agg(F.collect_list(F.struct("c.k", "lat", "lon", "cell_id")).alias("around"))


def patch_rows(x: np.ndarray, y: np.ndarray, there: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weights (row, 16) of the places around squares, from their places in the plane of the centre and the bilinear weights (row, 4) of the corners."""
    out = np.zeros(x.shape)
    basis = lambda p: np.stack([np.ones_like(p[..., 0]), p[..., 0], p[..., 1], p[..., 0] ** 2, p[..., 0] * p[..., 1], p[..., 1] ** 2], axis=-1)
    for c, patch in enumerate(PATCHES):
        ok = there[:, patch, None] > 0
        places = np.where(ok, np.stack([x[:, patch], y[:, patch]], axis=2), 0.0)
        middle = places.sum(axis=1, keepdims=True) / np.maximum(ok.sum(axis=1, keepdims=True), 1)
        # Quadratic surfaces stay such when stretched: along the axes of the places, each to its own length, flat patches are as well told as square ones.
        own, length, turn = np.linalg.svd(np.where(ok, places - middle, 0.0), full_matrices=False)
        size = np.abs(own).max(axis=1, keepdims=True)
        centre = (-middle @ turn.transpose(0, 2, 1))[:, 0] / np.where(length > 0, length, 1.0)
        left, value, right = np.linalg.svd(basis(own / np.where(size > 0, size, 1.0)) * ok, full_matrices=False)
        # Places on a line or another curve say nothing of a bend across it, whatever their digits.
        settled = (ok.sum(axis=(1, 2)) >= LEAST) & (length[:, 1] > FLAT * length[:, 0]) & (value[:, -1] > FLAT * value[:, 0])
        # The surface at the centre, by the pseudo-inverse.
        at = np.einsum("nkj,nj->nk", right, basis(centre / np.where(size > 0, size, 1.0)[:, 0]))
        first = np.einsum("nk,npk->np", at / np.where(settled[:, None], value, 1.0), left)
        alone = np.zeros_like(first)
        alone[:, 4] = 1.0
        out[:, patch] += share[:, c : c + 1] * np.where(settled[:, None], first, alone)
    return out


def patch(places: DataFrame, grid: Grid, n_i: int | None = None) -> DataFrame:
    """(lat_bin, lon_bin, cell_id, w) of patch recovery: up to sixteen places around each target centre in the mesh, exact for fields that are quadratic in its plane."""
    cell = dict(places.dtypes)["cell_id"]
    t = placed(centres(squares(places, n_i), grid))
    best = t.groupBy("lat_bin", "lon_bin").agg(F.min(F.struct("y", "x", "s", "t", "lat", "lon")).alias("m")).select("lat_bin", "lon_bin", "m.*")
    t = best.join(surroundings(places, n_i), ["y", "x"]).select("lat_bin", "lon_bin", "lat", "lon", "s", "t", "around")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            around = batch.column("around")
            flat, count = around.flatten(), around.value_lengths().to_numpy()
            row, k = np.repeat(np.arange(len(count)), count), flat.field("k").to_numpy()
            lat, lon, there = (np.zeros((len(count), 16)) for _ in range(3))
            lat[row, k], lon[row, k], there[row, k] = flat.field("lat").to_numpy(), flat.field("lon").to_numpy(), 1
            x, y, front = plane(lat, lon, batch.column("lat").to_numpy(), batch.column("lon").to_numpy())
            s, u = batch.column("s").to_numpy(), batch.column("t").to_numpy()
            share = np.stack([(1 - s) * (1 - u), s * (1 - u), s * u, (1 - s) * u], axis=1)
            w = patch_rows(x, y, front & (there > 0), share)[row, k]
            out = [batch.column("lat_bin").take(pa.array(row)), batch.column("lon_bin").take(pa.array(row)), flat.field("cell_id"), pa.array(w)]
            yield pa.RecordBatch.from_arrays(out, ["lat_bin", "lon_bin", "cell_id", "w"]).filter(pa.array(w != 0))

    return t.mapInArrow(run, f"lat_bin int, lon_bin int, cell_id {cell}, w double")


def applied(field: DataFrame, weights: DataFrame, value: str, by: tuple[str, ...], full: float = 1.0 - 1e-9) -> DataFrame:
    """(by, lat_bin, lon_bin, value): sums over the weights of a target cell, which needs all of them."""
    t = field.where(F.col(value).isNotNull()).join(weights, "cell_id").groupBy(*by, "lat_bin", "lon_bin")
    out = t.agg(F.sum(F.col("w") * F.col(value)).alias(value), F.sum("w").alias("_w"))
    return out.where(F.col("_w") >= full).drop("_w")
