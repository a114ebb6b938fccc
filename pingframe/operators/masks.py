"""Masks as runs: a row (keys, row, start, end) for each stretch of cells in a row of an image, end exclusive.

A mask of any size is as many rows as it has stretches, so unions, intersections and regions are joins and grouped sums, and no mask meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pingframe.functions import geo
from pingframe.operators.graph import connected
from pingframe.plans.tables import written

#: Rows of a mask whose corners are found by themselves before those of the mask are.
BLOCK_ROWS = 4_096
#: Rows that the edges of polygons cross, as many as are sorted at a time.
CROSSINGS = 1_000_000


def runs_of(cells: DataFrame, by: list[str], row: str, col: str) -> DataFrame:
    """The runs of cells (by, row, col); a cell that comes twice counts once."""
    once = cells.select(*by, F.col(row).alias("row"), F.col(col).alias("col")).distinct()
    apart = F.col("col") - F.row_number().over(Window.partitionBy(*by, "row").orderBy("col"))
    return once.withColumn("__g", apart).groupBy(*by, "row", "__g").agg(F.min("col").alias("start"), (F.max("col") + 1).alias("end")).drop("__g")


def filled(polygons: DataFrame, by: list[str], points: str, height: int | None = None, width: int | None = None) -> DataFrame:
    """The runs of polygons (by, points: an array of x and y) by scan lines and the even-odd rule, clipped to the image if its size is given.

    A cell is inside if its centre is. Closing the ring is implied; an edge belongs to the rows whose centres lie in [lower y, upper y). Polygons
    without a cell have no rows, those of equal keys are rings of one mask, and edges that are not finite are left out. Rings are shuffled, not what
    they cross, and not even these if they lie together already.
    """

    @F.arrow_udf("array<struct<row: long, start: long, end: long>>")
    def scanned(rings: pa.Array) -> pa.Array:
        ring = rings.flatten()
        sizes = ring.value_lengths().to_numpy()
        point = ring.flatten()
        x, y = (pc.struct_field(point, c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y"))
        owner = np.repeat(np.repeat(np.arange(len(rings)), rings.value_lengths().to_numpy()), sizes)
        ends, nxt = np.cumsum(sizes)[sizes > 0], np.arange(1, len(x) + 1)
        nxt[ends - 1] = ends - sizes[sizes > 0]
        counts, parts = np.zeros(len(rings), np.int64), []
        for lo, hi in _spans(owner, height, edges := (x, y, x[nxt], y[nxt])):
            own, *run = _scan(owner[lo:hi], *(c[lo:hi] for c in edges), height, width)
            counts += np.bincount(own, minlength=len(rings))
            parts.append(run)
        runs = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(c) for c in runs], ["row", "start", "end"]))

    rings = polygons.where(F.size(points) > 0).groupBy(*by).agg(F.collect_list(F.col(points)).alias("__rings"))
    return rings.select(*by, F.explode(scanned("__rings")).alias("__r")).select(*by, "__r.row", "__r.start", "__r.end")


def _rows(y: np.ndarray, to: np.ndarray, height: int | None) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows whose centres lie between two ends of edges."""
    whole = np.isfinite(y) & np.isfinite(to)
    low, high = (np.ceil(np.where(whole, f(y, to), 0.0) - 0.5).astype(np.int64) for f in (np.minimum, np.maximum))
    if height is not None:
        low, high = np.maximum(low, 0), np.minimum(high, height)
    return low, np.maximum(high - low, 0)


def _spans(owner: np.ndarray, height: int | None, edges: tuple[np.ndarray, ...]) -> Iterator[tuple[int, int]]:
    """Stretches of edges, polygons whole, that cross up to CROSSINGS rows (or are one polygon)."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    before = np.r_[0, np.cumsum(_rows(edges[1], edges[3], height)[1])]
    bounds = np.r_[starts, len(owner)]
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(before[bounds], before[bounds[at]] + CROSSINGS, "right")) - 1)
        yield int(bounds[at]), int(bounds[to])
        at = to


def _scan(owner: np.ndarray, px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray, height: int | None, width: int | None) -> tuple[np.ndarray, ...]:
    """(owner, row, start, end) of the runs between the edges of polygons, in this order; those that touch are one."""
    first, n = _rows(py, qy, height)
    e = np.repeat(np.arange(len(n)), n)
    row = first[e] + np.arange(len(e)) - (np.cumsum(n) - n)[e]
    x = px[e] + (row + 0.5 - py[e]) * (qx[e] - px[e]) / (qy[e] - py[e])
    held = np.isfinite(x)
    x, row, own = np.ceil(x[held] - 0.5).astype(np.int64), row[held], owner[e[held]]
    order = np.lexsort((x, row, own))
    x, row, own = x[order], row[order], own[order]
    new = np.r_[True, (own[1:] != own[:-1]) | (row[1:] != row[:-1])][: len(x)]
    starts = np.flatnonzero(new)
    place = np.arange(len(x)) - starts[np.cumsum(new) - 1]
    left = np.flatnonzero((place[:-1] % 2 == 0) & ~new[1:])
    left = left[x[left] < x[left + 1]]
    start, end, row, own = x[left], x[left + 1], row[left], own[left]
    new = np.r_[True, (own[1:] != own[:-1]) | (row[1:] != row[:-1]) | (start[1:] != end[:-1])][: len(start)]
    last = np.r_[new[1:], True][: len(start)]
    own, row, start, end = own[new], row[new], start[new], end[last]
    if width is None:
        return own, row, start, end
    start, end = np.maximum(start, 0), np.minimum(end, width)
    inside = start < end
    return own[inside], row[inside], start[inside], end[inside]


def clipped(runs: DataFrame, height: int | None, width: int | None) -> DataFrame:
    """runs inside an image; what is empty goes."""
    if width is not None:
        runs = runs.withColumns({"start": F.greatest("start", F.lit(0)), "end": F.least("end", F.lit(width))})
    inside = F.col("start") < F.col("end")
    return runs.where(inside if height is None else inside & (F.col("row") >= 0) & (F.col("row") < height))


def shifted(runs: DataFrame, rows: Column, cols: Column, height: int, width: int) -> DataFrame:
    """runs of tiles as runs of their image: moved by rows and columns and clipped; masks that lie outside have none left."""
    moved = runs.withColumns({"row": F.col("row") + rows, "start": F.col("start") + cols, "end": F.col("end") + cols})
    return clipped(moved, height, width)


def united(runs: DataFrame, by: list[str]) -> DataFrame:
    """The union of all runs of the same keys: those of a row that overlap or touch are one."""
    order = Window.partitionBy(*by, "row").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("__before") >= F.col("start"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = runs.withColumn("__before", before).withColumn("__island", island)
    return marked.groupBy(*by, "row", "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def crossed(a: DataFrame, b: DataFrame, on: list[str], tasks: int | None = None) -> DataFrame:
    """The intersection of masks of the same image (on): a and b have one more key each, which the result has both. Rows of images are dealt to so many tasks and merged, if these are given."""
    if tasks:
        a, b = (x.repartition(tasks, *on, "row").hint("merge") for x in (a, b))
    left, right = a.alias("l"), b.alias("r")
    same = reduce(and_, (F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*on, "row"])) & (F.col("l.start") < F.col("r.end")) & (F.col("r.start") < F.col("l.end"))
    own = [F.col(f"l.{c}") for c in a.columns if c not in (*on, "row", "start", "end")]
    other = [F.col(f"r.{c}") for c in b.columns if c not in (*on, "row", "start", "end")]
    span = F.greatest("l.start", "r.start").alias("start"), F.least("l.end", "r.end").alias("end")
    return left.join(right, same).select(*[F.col(f"l.{c}") for c in on], *own, *other, F.col("l.row"), *span)


def counted(runs: DataFrame, by: list[str], name: str = "cells") -> DataFrame:
    return runs.groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias(name))


def mask_ious(a: DataFrame, b: DataFrame, on: list[str], a_key: str, b_key: str, tasks: int | None = None) -> DataFrame:
    """(on, a_key, b_key, shared, iou) of each pair of masks of an image that share a cell. The runs of each mask must not overlap (see united). tasks: see crossed."""
    shared = counted(crossed(a, b, on, tasks), [*on, a_key, b_key], "shared")
    both = shared.join(counted(a, [*on, a_key], "__a"), [*on, a_key]).join(counted(b, [*on, b_key], "__b"), [*on, b_key])
    return both.select(*on, a_key, b_key, "shared", (F.col("shared") / (F.col("__a") + F.col("__b") - F.col("shared"))).alias("iou"))


def regions(runs: DataFrame, by: list[str]) -> DataFrame:
    """runs with first_row and first_col of their 8-connected region: where its first run, by row and column, starts. Runs of a row must be apart."""
    marked = written(runs.select(*by, "row", "start", "end", F.monotonically_increasing_id().alias("__id")), "runs")
    below = marked.select(*[F.col(c).alias(f"__{c}") for c in by], (F.col("row") - 1).alias("__row"), F.col("start").alias("__start"), F.col("end").alias("__end"), F.col("__id").alias("b"))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by), F.col("row") == F.col("__row"))
    links = marked.join(below, same & (F.col("start") <= F.col("__end")) & (F.col("__start") <= F.col("end"))).select(F.col("__id").alias("a"), "b")
    labelled = marked.join(connected(links), F.col("__id") == F.col("node"), "left").withColumn("__region", F.coalesce("root", "__id"))
    first = labelled.groupBy("__region").agg(F.min(F.struct("row", "start")).alias("__first"))
    return labelled.join(first, "__region").select(*by, F.col("__first.row").alias("first_row"), F.col("__first.start").alias("first_col"), "row", "start", "end")


def corners(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points (x, y) of whole numbers, by angle: the lower and the upper chain of the points in order."""
    own = np.unique(points, axis=0)
    if len(own) < 3:
        return own
    chains = []
    for line in (own, own[::-1]):
        kept: list[np.ndarray] = []
        for p in line:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) <= (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]):
                kept.pop()
            kept.append(p)
        chains += kept[:-1]
    return np.array(chains)


def least_rectangle(hull: np.ndarray) -> tuple[float, float, float, list[list[float]]]:
    """(longer side, shorter side, direction of the longer one in degrees from x towards y, corners) of the smallest rectangle around a hull.

    It lies along an edge of the hull. Each edge's direction is turned by right angles into the first quadrant; of rectangles of equal area the one
    of the least direction is taken.
    """
    if len(hull) == 1:
        return 0.0, 0.0, 0.0, [hull[0].astype(float).tolist()] * 4
    d = np.roll(hull, -1, axis=0) - hull
    dx, dy = d[:, 0], d[:, 1]
    turn = [(dx > 0) & (dy >= 0), (dx <= 0) & (dy > 0), (dx < 0) & (dy <= 0)]
    u = np.stack([np.select(turn, [dx, dy, -dx], -dy), np.select(turn, [dy, -dx, -dy], dx)], axis=1)
    along, across = hull @ u.T, hull @ np.stack([-u[:, 1], u[:, 0]])
    a, b, norm = np.ptp(along, axis=0), np.ptp(across, axis=0), (u * u).sum(1)
    angle = np.degrees(np.arctan2(u[:, 1], u[:, 0]))
    k = np.lexsort((np.round(angle, 6), np.round(a * b / norm, 6)))[0]
    sides, root = (a[k] / np.sqrt(norm[k]), b[k] / np.sqrt(norm[k])), np.sqrt(norm[k])
    unit, other = u[k] / root, np.array([-u[k][1], u[k][0]]) / root
    places = [(along[:, k].min(), across[:, k].min()), (along[:, k].max(), across[:, k].min()), (along[:, k].max(), across[:, k].max()), (along[:, k].min(), across[:, k].max())]
    box = [(s / root * unit + t / root * other).tolist() for s, t in places]
    return float(max(sides)), float(min(sides)), float(angle[k] + (90 if sides[0] < sides[1] else 0)), box


def measured(runs: DataFrame, by: list[str], res_m: float) -> DataFrame:
    """(by, cells, centroid_row, centroid_col, length_m, width_m, area_m2, angle_deg, corners) of each mask.

    Length and width are the sides of the smallest rectangle around the centres of the cells and one cell more; area counts cells. angle_deg is the
    direction of the longer side from the columns towards the rows, corners those of the rectangle as (row, col). The hull is taken of the ends of
    the rows, first by blocks of rows and then of those hulls, so a mask may have any number of rows.
    """
    n, wide = F.col("end") - F.col("start"), (F.col("start") + F.col("end") - 1) / 2
    sums = runs.groupBy(*by).agg(F.sum(n).alias("cells"), (F.sum(n * F.col("row")) / F.sum(n)).alias("centroid_row"), (F.sum(n * wide) / F.sum(n)).alias("centroid_col"))
    ends = runs.groupBy(*by, "row").agg(F.min("start").alias("a"), (F.max("end") - 1).alias("b"))
    point = lambda c: F.struct(F.col(c).cast("long").alias("x"), F.col("row").cast("long").alias("y"))
    blocks = ends.groupBy(*by, F.floor(F.col("row") / BLOCK_ROWS).alias("__block")).agg(F.flatten(F.collect_list(F.array(point("a"), point("b")))).alias("p"))
    kind = "array<struct<x: long, y: long>>"

    @F.pandas_udf(kind)
    def hull(several: pd.Series) -> pd.Series:
        return pd.Series([[{"x": int(x), "y": int(y)} for x, y in corners(np.array([(p["x"], p["y"]) for p in own], np.int64))] for own in several])

    @F.pandas_udf("long_px double, short_px double, angle_deg double, corners array<struct<row: double, col: double>>")
    def rectangle(several: pd.Series) -> pd.DataFrame:
        rows = []
        for own in several:
            *sides, box = least_rectangle(corners(np.array([(p["x"], p["y"]) for p in own], np.int64)))
            rows.append((*sides, [{"row": y, "col": x} for x, y in box]))
        return pd.DataFrame(rows, columns=["long_px", "short_px", "angle_deg", "corners"])

    hulls = blocks.select(*by, hull("p").alias("p")).groupBy(*by).agg(F.flatten(F.collect_list("p")).alias("p")).select(*by, rectangle("p").alias("r"))
    same = reduce(and_, (F.col(f"m.{c}").eqNullSafe(F.col(f"h.{c}")) for c in by))
    both = sums.alias("m").join(hulls.alias("h"), same)
    sizes = [((F.col(f"h.r.{c}_px") + 1) * res_m).alias(name) for c, name in (("long", "length_m"), ("short", "width_m"))]
    return both.select(*[F.col(f"m.{c}") for c in by], "cells", "centroid_row", "centroid_col", *sizes, (F.col("cells") * res_m * res_m).alias("area_m2"), F.col("h.r.angle_deg").alias("angle_deg"), F.col("h.r.corners").alias("corners"))


def placed(measures: DataFrame, pings: DataFrame, by: list[str], line: str, nadir_col: float, res_m: float) -> DataFrame:
    """measures with side, ground_range_m, orientation_deg (of the longer side from true north, 0 to below 180), depth_m, lat, lon and footprint.

    pings (line, row, heading_deg, sensor_depth_m, altitude_m, lat, lon) has a row for each row of an image; the one nearest the centre counts, and for
    each corner its own one (both at the ends of the line at most). What a missing heading, depth, altitude or position leaves open is null. The footprint's
    corners are clockwise. The measures are stored, as they are read for the centres and for the corners.
    """
    measures = written(measures, "measures")
    ends = pings.groupBy(line).agg(F.min("row").alias("__lo"), F.max("row").alias("__hi"))
    nav = pings.select(F.col(line).alias("__line"), F.col("row").cast("long").alias("__at"), "heading_deg", "sensor_depth_m", "altitude_m", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    held = lambda row: F.greatest(F.col("__lo"), F.least(F.col("__hi"), F.rint(row).cast("long")))

    def position(off_m: Column) -> tuple[Column, Column]:
        return geo.moved(F.col("__lat"), F.col("__lon"), F.col("heading_deg") + F.when(off_m >= 0, 90).otherwise(-90), F.abs(off_m))

    here = measures.join(ends, line).withColumn("__near", held(F.col("centroid_row")))
    near = here.join(nav, (F.col(line) == F.col("__line")) & (F.col("__near") == F.col("__at")))
    off = F.col("centroid_col") - nadir_col
    lat, lon = position(F.rint("centroid_col") * res_m - nadir_col * res_m)
    rated = near.select(
        *measures.columns, F.when(off >= 0, "starboard").otherwise("port").alias("side"), (F.abs(off) * res_m).alias("ground_range_m"), F.pmod(F.col("heading_deg") + 90 - F.col("angle_deg"), F.lit(180.0)).alias("orientation_deg"),
        (F.col("sensor_depth_m") + F.col("altitude_m")).alias("depth_m"), lat.alias("lat"), lon.alias("lon"),
    )
    each = measures.select(*by, F.posexplode("corners").alias("k", "c")).join(ends, line).withColumn("__near", held(F.col("c.row")))
    c_lat, c_lon = position(F.greatest(F.rint("c.col"), F.lit(0.0)) * res_m - nadir_col * res_m)
    found = each.join(nav, (F.col(line) == F.col("__line")) & (F.col("__near") == F.col("__at"))).select(*by, c_lat.alias("lat"), c_lon.alias("lon"))
    mid = found.groupBy(*by).agg(F.avg("lat").alias("__y"), F.avg("lon").alias("__x"))
    turn = -F.atan2(F.col("lat") - F.col("__y"), (F.col("lon") - F.col("__x")) * F.cos(F.radians("__y")))
    ring = found.join(mid, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(turn.alias("t"), "lat", "lon"))).alias("f"))
    whole = F.when(F.forall("f", lambda p: p["lat"].isNotNull()), F.transform("f", lambda p: F.array(p["lat"], p["lon"])))
    return rated.join(ring.select(*by, whole.alias("footprint")), by, "left")


def heat_in_masks(heat: DataFrame, runs: DataFrame, by: list[str], keys: list[str], row: str, col: str, value: str, tau: float) -> DataFrame:
    """(keys, mean_share, max_share): mean and largest heat of a mask's cells over 2 tau, held in 0 to 1. keys begin with those of the image (by).

    heat (by, row, col, value) has a row for each cell. Masks without a cell in it are absent.
    """
    cell = heat.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(row).alias("__r"), F.col(col).alias("__c"), F.col(value).alias("__v"))
    same = reduce(and_, (F.col(c) == F.col(f"__{c}") for c in by), F.col("row") == F.col("__r"))
    both = runs.join(cell, same & (F.col("__c") >= F.col("start")) & (F.col("__c") < F.col("end")))
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / (2 * tau)))
    return both.groupBy(*keys).agg(share(F.avg("__v")).alias("mean_share"), share(F.max("__v")).alias("max_share"))
