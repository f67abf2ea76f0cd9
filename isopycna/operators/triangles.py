"""Linear interpolation of scattered points on their Delaunay triangles, tile by tile.

Only triangles whose circumscribed circle has at most ``radius`` are made: wider ones bridge
gaps, such as land.  That bound makes tiles independent: a triangle belongs to the tile of its circle's
centre, and whether the circle is empty is decided by points within ``radius`` of that
centre, so a tile with a rim of ``radius`` has all that its triangles depend on.  The triangles are those of
one triangulation of all points, whatever the tiles.

Dense points go through rounds of growing radius, of which the first is small enough that a tile and its rim
hold about ``HELD`` points where they are densest.  A point whose triangles close around it
has all of its triangles; only the others, at gaps and edges, go on to wider circles.  A wide circle that is empty of those
others holds a settled point only if its centre lies in a triangle that was found, thus has a point within the radius of
the round before; circles whose centre has none are empty of all points.
So what a task holds is bounded by ``HELD``, but for points of one wide rim at gaps.

Points are (id, x, y) in a plane.  Of points at one place the smallest id counts; points without a
finite place are left out; four or more points on an empty circle are triangulated as if each were moved by
a billionth of the radius, in a direction that follows from its place alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

#: What a triangle has besides its corners: the radius of its circle, its places and the centre.
PLACES = ("radius", "ax", "ay", "bx", "by", "cx", "cy", "u", "v")
#: Size of a tile in radii.
TILE = 4.0
#: Points that a tile and its rim are to hold in the first round, about.
HELD = 4000
#: How far points are moved to tell circles apart, in radii.
NUDGE = 1e-9
#: Points after which triangles that no later point can reach are set aside.
SWEEP = 32


def circles(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres (row, 2) and squared radii of the circles through triangles (row, 3, 2)."""
    a, b = p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
    d = 2.0 * (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.stack([b[:, 1] * aa - a[:, 1] * bb, a[:, 0] * bb - b[:, 0] * aa], axis=1) / d[:, None]
    return p[:, 0] + c, (c * c).sum(axis=1)


def delaunay(points: np.ndarray, radius: float) -> np.ndarray:
    """Triangles (row, 3) of ``points`` (row, 2) in general position, one point put in after the other; all those with circles of at most ``radius`` are among them.

    Points come in the order of x, or nearly: a triangle whose circle ends before all later ones is done, and no longer looked at.
    The outer triangle that it starts from is out of reach of such circles, and no farther
    off than that, for wide circles cost digits.
    """
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), np.int64)
    points = points - points.mean(axis=0)
    outer = 20.0 * max(np.ptp(points, axis=0).max(), radius) * np.array([[-1.0, -1.0], [2.0, -1.0], [-0.5, 2.0]])
    every = np.vstack([points, outer])
    xs, ys = every[:, 0].tolist(), every[:, 1].tolist()
    later = np.minimum.accumulate(points[::-1, 0])[::-1].tolist()
    # Circles that are looked at stand in the first ``used`` places, with their triangles beside.
    x, y, square = np.empty(64), np.empty(64), np.empty(64)
    made: list[tuple[int, int, int]] = []
    done: list[tuple[int, int, int]] = []

    def put(at: int, t: tuple[int, int, int]) -> None:
        p, q, r = t
        ax, ay, bx, by = xs[q] - xs[p], ys[q] - ys[p], xs[r] - xs[p], ys[r] - ys[p]
        d, aa, bb = 2.0 * (ax * by - ay * bx), ax * ax + ay * ay, bx * bx + by * by
        # Three points on a line: a circle that holds nothing, as from ``circles``.
        u, v = ((by * aa - ay * bb) / d, (ax * bb - bx * aa) / d) if d else (math.nan, math.nan)
        x[at], y[at], square[at], made[at] = xs[p] + u, ys[p] + v, u * u + v * v, t

    made.append((n, n + 1, n + 2))
    put(0, made[0])
    for k in range(n):
        if k % SWEEP == 0:
            used = len(made)
            gap = later[k] - x[:used]
            behind = (gap > 0) & (gap * gap > square[:used] * (1.0 + 1e-9))
            if behind.any():
                done += [made[j] for j in np.flatnonzero(behind).tolist()]
                kept = np.flatnonzero(~behind)
                made = [made[j] for j in kept.tolist()]
                for a in (x, y, square):
                    a[: len(kept)] = a[kept]
        used = len(made)
        gx, gy = x[:used] - xs[k], y[:used] - ys[k]
        free = np.flatnonzero(gx * gx + gy * gy < square[:used]).tolist()
        # Edges of the hole that the circles around the point leave: those of one triangle only.
        rim: dict[tuple[int, int], tuple[int, int]] = {}
        for j in free:
            p, q, r = made[j]
            for e in ((p, q), (q, r), (r, p)):
                code = e if e[0] < e[1] else (e[1], e[0])
                if rim.pop(code, None) is None:
                    rim[code] = e
        if used + len(rim) > len(x):
            x, y, square = (np.concatenate([a, np.empty(len(a) + len(rim))]) for a in (x, y, square))
        for p, q in rim.values():
            if free:
                put(free.pop(), (p, q, k))
            else:
                made.append((p, q, k))
                put(len(made) - 1, (p, q, k))
        # Places left over, where points repeat others.
        for j in sorted(free, reverse=True):
            last = len(made) - 1
            x[j], y[j], square[j], made[j] = x[last], y[last], square[last], made[last]
            made.pop()
    out = np.array(done + made).reshape(-1, 3)
    return out[(out < n).all(axis=1)]


def nudged(xy: np.ndarray, radius: float) -> np.ndarray:
    """Points moved by a billionth of ``radius``, in directions that follow from their places."""
    bits = np.ascontiguousarray(xy + 0.0).view(np.uint64)
    with np.errstate(over="ignore"):
        h = bits[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ (bits[:, 1] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    turn = (h >> np.uint64(11)).astype(np.float64) * (2.0 * np.pi / 2.0**53)
    return xy + NUDGE * radius * np.stack([np.cos(turn), np.sin(turn)], axis=1)


def triangulation(points: DataFrame, radius: float, tile: float = TILE, held: int = HELD) -> DataFrame:
    """(a, b, c, radius) of the Delaunay triangles of ``points`` (id, x, y) with circles of at most ``radius``, ids ascending, and their places ax, ay to cx, cy."""
    if not radius > 0 or not tile > 0 or not held > 0:
        raise ValueError("radius, tile and held must be above 0")
    ok = ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    distinct = points.where(ok).groupBy((F.col("x").cast("double") + 0.0).alias("x"), (F.col("y").cast("double") + 0.0).alias("y")).agg(F.min("id").alias("id"))
    # The densest square of one radius tells in how many halvings a tile and its rim hold few enough.
    square = [F.floor(F.col(c) / radius).alias(f"_{c}") for c in "xy"]
    most = points.where(ok).groupBy(*square).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    halvings = max(0, math.ceil(math.log2(max(1.0, most * (tile + 2.0) ** 2 / held)) / 2.0))
    every = _moved(distinct, radius)
    if halvings == 0:
        return _round(every, 0.0, radius, tile).drop("u", "v")
    every = _stored(every)
    left, low, out, edges = every, 0.0, None, None
    for k in range(halvings, -1, -1):
        high = radius / 2.0**k
        made = _round(left, low, high, tile)
        made = _stored(made if low == 0.0 else _empty(made, every, low))
        out = made if out is None else out.union(made)
        if k:
            edges = _stored(_counted(made, edges))
            left, low = _stored(_unsettled(left, edges)), high
    return out.drop("u", "v")


def _moved(distinct: DataFrame, radius: float) -> DataFrame:
    """``distinct`` (id, x, y) with the place (mx, my) that each is moved to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = nudged(np.stack([batch.column("x").to_numpy(), batch.column("y").to_numpy()], axis=1), radius)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "x", "y")), pa.array(to[:, 0]), pa.array(to[:, 1])], ["id", "x", "y", "mx", "my"])

    return distinct.select("id", "x", "y").mapInArrow(run, f"id {dict(distinct.dtypes)['id']}, x double, y double, mx double, my double")


def _stored(t: DataFrame) -> DataFrame:
    """``t`` from a table, so that it is computed once."""
    path = scratch.folder(t.sparkSession)
    t.write.parquet(path)
    return t.sparkSession.read.schema(t.schema).parquet(path)


def _counted(made: DataFrame, before: DataFrame | None) -> DataFrame:
    """(p, q, n): the edges of the triangles ``made``, and those that had one triangle ``before``, with how many they have now."""
    pairs = F.explode(F.array(*(F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in ("ab", "ac", "bc")))).alias("e")
    edges = made.select(pairs).select("e.p", "e.q", F.lit(1).alias("n"))
    if before is not None:
        edges = edges.union(before.where("n = 1"))
    return edges.groupBy("p", "q").agg(F.sum("n").cast("int").alias("n"))


def _unsettled(left: DataFrame, edges: DataFrame) -> DataFrame:
    """The points of ``left`` around which triangles don't close: some edge has one triangle, or there is none."""
    ends = edges.select(F.explode(F.array("p", "q")).alias("id"), "n").groupBy("id").agg(F.min("n").alias("n"))
    return left.join(ends.where("n > 1"), "id", "left_anti").select(*left.columns)


def _empty(made: DataFrame, every: DataFrame, low: float) -> DataFrame:
    """``made`` without triangles whose circle's centre (u, v) has one of the points ``every`` within ``low``."""
    # A point in the same bin is within ``low``; only centres of empty bins ask the bins around, two on each side.
    size = low * 0.7
    at = lambda c: F.floor(F.col(c) / size).alias(f"_{c}")
    points = every.select("id", "mx", "my", F.floor(F.col("mx") / size).alias("_u"), F.floor(F.col("my") / size).alias("_v"))
    far = made.select("*", at("u"), at("v")).join(points.select("_u", "_v").distinct(), ["_u", "_v"], "left_anti")
    near = lambda c: F.explode(F.sequence(F.col(c) - 2, F.col(c) + 2)).alias(c)
    asked = far.select("a", "b", "c", "u", "v", near("_u"), "_v").select("a", "b", "c", "u", "v", "_u", near("_v"))
    gap = (F.col("u") - F.col("mx")) * (F.col("u") - F.col("mx")) + (F.col("v") - F.col("my")) * (F.col("v") - F.col("my"))
    held = asked.join(points, ["_u", "_v"]).where((gap <= low * low) & ~F.col("id").isin(F.col("a"), F.col("b"), F.col("c"))).select("a", "b", "c").distinct()
    return far.join(held, ["a", "b", "c"], "left_anti").select(*made.columns)


def _round(points: DataFrame, low: float, high: float, tile: float) -> DataFrame:
    """Triangles of ``points`` (id, x, y, mx, my) with circles above ``low`` and of at most ``high``, with the centre (u, v) of each circle."""
    key, size = dict(points.dtypes)["id"], tile * high
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - high * 1.001) / size), F.floor((F.col(c) + high * 1.001) / size)))
    dealt = points.withColumn("tx", reach("x")).withColumn("ty", reach("y"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        xy = np.stack([table["x"].to_numpy(), table["y"].to_numpy()], axis=1)
        # In one order in every tile, so that rounding is the same.
        order = np.lexsort((xy[:, 1], xy[:, 0]))
        xy, ids = xy[order], table["id"].take(pa.array(order)).combine_chunks()
        moved = np.stack([table["mx"].to_numpy(), table["my"].to_numpy()], axis=1)[order]
        found = delaunay(moved, high)
        centre, square = circles(moved[found])
        own = np.floor(centre / size)
        keep = (square > low * low) & (square <= high * high) & (own == [table["tx"][0].as_py(), table["ty"][0].as_py()]).all(axis=1)
        found, centre = found[keep], centre[keep]
        rank = np.empty(len(ids), np.int64)
        rank[pa.compute.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
        found = np.take_along_axis(found, np.argsort(rank[found], axis=1), axis=1)
        corner = [(ids.take(pa.array(found[:, k])), pa.array(xy[found[:, k], 0]), pa.array(xy[found[:, k], 1])) for k in range(3)]
        return pa.table([c[0] for c in corner] + [pa.array(np.sqrt(circles(xy[found])[1]))] + [v for c in corner for v in c[1:]] + [pa.array(centre[:, 0]), pa.array(centre[:, 1])], [*"abc", *PLACES])

    return dealt.groupBy("tx", "ty").applyInArrow(run, f"a {key}, b {key}, c {key}, " + ", ".join(f"{c} double" for c in PLACES))


def at_points(triangles: DataFrame, step: float) -> DataFrame:
    """(a, b, c, x, y, wa, wb, wc): the places at multiples of ``step`` that lie in a triangle, with the weights of its corners; a place on an edge belongs to the triangle of smallest ids."""
    axis = lambda c: F.sequence(F.ceil(F.least(*(f"{k}{c}" for k in "abc")) / step - 1e-9).cast("long"), F.floor(F.greatest(*(f"{k}{c}" for k in "abc")) / step + 1e-9).cast("long"))
    some = lambda c: F.explode(F.when(F.ceil(F.least(*(f"{k}{c}" for k in "abc")) / step - 1e-9) <= F.floor(F.greatest(*(f"{k}{c}" for k in "abc")) / step + 1e-9), axis(c)))
    t = triangles.withColumn("nx", some("x")).withColumn("ny", some("y")).withColumns({"x": F.col("nx") * step, "y": F.col("ny") * step})
    whole = _area(t, ("ax", "ay"), ("bx", "by"), ("cx", "cy"))
    t = t.withColumns({"wa": _area(t, ("x", "y"), ("bx", "by"), ("cx", "cy")) / whole, "wb": _area(t, ("ax", "ay"), ("x", "y"), ("cx", "cy")) / whole})
    t = t.withColumn("wc", 1.0 - F.col("wa") - F.col("wb")).where("wa >= -1e-12 and wb >= -1e-12 and wc >= -1e-12")
    best = t.groupBy("nx", "ny").agg(F.min(F.struct("a", "b", "c", "x", "y", "wa", "wb", "wc")).alias("m"))
    return best.select("m.*")


def _area(t: DataFrame, p: tuple[str, str], q: tuple[str, str], r: tuple[str, str]) -> Column:
    c = F.col
    return (c(q[0]) - c(p[0])) * (c(r[1]) - c(p[1])) - (c(q[1]) - c(p[1])) * (c(r[0]) - c(p[0]))


def interpolated(field: DataFrame, weights: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """(by, x, y, value) of ``field`` (by, id, value) at the places of ``weights``; a place needs the values of all three corners."""
    each = F.explode(F.array(*(F.struct(F.col(k).alias("id"), F.col(f"w{k}").alias("w")) for k in "abc"))).alias("p")
    t = field.where(F.col(value).isNotNull()).join(weights.select("x", "y", each).select("x", "y", "p.*"), "id")
    out = t.groupBy(*by, "x", "y").agg(F.sum(F.col("w") * F.col(value)).alias(value), F.count("*").alias("_n"))
    return out.where("_n = 3").drop("_n")
