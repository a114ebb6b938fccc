"""Detectors on tiles of images: any function from a grey array to boxes, by name; a tile that fails twice is passed over and told of."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingframe.functions import geo
from pingframe.operators.merging import merged_boxes
from pingframe.operators.raster import tiles_of
from pingframe.sources.geotiff import position

#: A box is (cls, score, x1, y1, x2, y2, pixels), ends exclusive, in pixels of the array.
Box = tuple[str, float, int, int, int, int, int]
Detector = Callable[[np.ndarray], list[Box]]

FOUND = "tile_row long, tile_col long, cls string, score double, x1 long, y1 long, x2 long, y2 long, pixels long, skipped boolean, error string"


def _background(grey: np.ndarray, window: int) -> np.ndarray:
    """A running median of means of 4 x 4 pixels, with replicated edges, drawn out to full size by lines between block centres."""
    h, w = (max(n // 4, 1) for n in grey.shape)
    rows, cols = (np.minimum(np.arange(n) * k // n, k - 1) for n, k in zip(grey.shape, (h, w), strict=True))
    sums, counts = np.zeros((h, w)), np.zeros((h, w))
    np.add.at(sums, (rows[:, None], cols[None]), grey)
    np.add.at(counts, (rows[:, None], cols[None]), 1.0)
    padded = np.pad(sums / counts, window // 2, mode="edge")
    seen = np.lib.stride_tricks.sliding_window_view(padded, (window, window))
    small = np.stack([np.median(line.reshape(w, -1), axis=1) for line in seen])
    at = lambda n, k: (np.arange(n) + 0.5) * k / n - 0.5
    wide = np.stack([np.interp(at(grey.shape[1], w), np.arange(w), line) for line in small])
    return np.stack([np.interp(at(grey.shape[0], h), np.arange(h), line) for line in wide.T], axis=1)


def regions(marked: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The 8-connected regions of true cells as (rows, columns), in order of their first cell."""
    left, out = marked.copy(), []
    height, width = marked.shape
    for start in zip(*np.nonzero(marked), strict=True):
        if not left[start]:
            continue
        left[start] = False
        todo, own = [start], []
        while todo:
            r, c = todo.pop()
            own.append((r, c))
            for y in range(max(r - 1, 0), min(r + 2, height)):
                for x in range(max(c - 1, 0), min(c + 2, width)):
                    if left[y, x]:
                        left[y, x] = False
                        todo.append((y, x))
        cells = np.array(own)
        out.append((cells[:, 0], cells[:, 1]))
    return out


def bright_targets(grey: np.ndarray, least_contrast: float = 100, least_pixels: int = 12, most_share: float = 0.05, window: int = 31, cls: str = "debris_other") -> list[Box]:
    """Regions at least so much brighter than a wide median background, neither specks nor fields; the score grows with the contrast up to 0.6."""
    if not grey.size:
        return []
    contrast = grey - _background(grey, window | 1)
    out = []
    for r, c in regions(contrast >= least_contrast):
        if least_pixels <= len(r) <= most_share * grey.size:
            score = round(float(np.clip(0.2 + contrast[r, c].mean() / 400, 0, 0.6)), 4)
            out.append((cls, score, int(c.min()), int(r.min()), int(c.max()) + 1, int(r.max()) + 1, len(r)))
    return out


_known: dict[str, Detector] = {"bright": bright_targets}


def register(name: str, detector: Detector) -> None:
    """Make a detector known by name. It is sent to the tasks, so it must be picklable."""
    _known[name] = detector


def detector(name: str = "auto") -> Detector:
    """A detector by name; `auto` is the one registered last."""
    if name == "auto":
        return list(_known.values())[-1]
    if name not in _known:
        raise ValueError(f"unknown detector: {name}; there are auto, {', '.join(_known)}")
    return _known[name]


def _starts(n: Column, size: int, step: int) -> Column:
    last = F.greatest(n - size, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.ceil(last / step)), lambda k: F.least(k * step, last).cast("long")))


def tiled(rows: DataFrame, by: list[str], at: str, value: str, size: int = 640, overlap: float = 0.25) -> DataFrame:
    """rows (by, at, value: an array of equal length in an image) by tile: tile_row, tile_col, tile (its number, row by row) and part,
    the row's values in the tile. Images are numbered from 0 without gaps.

    A row is copied to each tile that it lies in, about (1 / (1 - overlap)) squared times in all; tiles are at most size x size.
    """
    step = max(1, round(size * (1 - overlap)))
    extent = rows.groupBy(*by).agg((F.max(at) + 1).alias("__h"), F.max(F.size(value)).alias("__w"))
    cut = rows.join(extent, by).withColumn("tile_row", F.explode(tiles_of(F.col(at), F.col("__h"), size, overlap)))
    cut = cut.withColumn("tile_col", F.explode(_starts(F.col("__w"), size, step)))
    across = F.ceil(F.greatest(F.col("__w") - size, F.lit(0)) / step) + 1
    number = F.ceil(F.col("tile_row") / step) * across + F.ceil(F.col("tile_col") / step)
    part = F.slice(value, F.col("tile_col").cast("int") + 1, size)
    return cut.withColumn("tile", number.cast("long")).withColumn("part", part).drop("__h", "__w", value)


def detected(tiles: DataFrame, by: list[str], at: str, find: Detector, attempts: int = 2) -> DataFrame:
    """(by, tile_row, tile_col, cls, score, x1, y1, x2, y2, pixels, skipped, error): the boxes of all tiles of tiled(), in the image's pixels.

    A tile on which the detector fails `attempts` times gives one row that is skipped, with the error, so that one bad tile does not end
    the run; a lost task is tried again by Spark. A tile without a box gives no row. One call holds one tile.
    """

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        first = tile.iloc[0]
        top, left = int(first["tile_row"]), int(first["tile_col"])
        grey = np.stack(tile.sort_values(at)["part"].to_numpy()).astype(np.float64)
        error, boxes = None, []
        for _ in range(attempts):
            try:
                boxes, error = list(find(grey)), None
                break
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        if error:
            rows = [(top, left, None, None, left, top, left + grey.shape[1], top + grey.shape[0], None, True, error)]
        else:
            rows = [(top, left, c, s, x1 + left, y1 + top, x2 + left, y2 + top, n, False, None) for c, s, x1, y1, x2, y2, n in boxes]
        out = pd.DataFrame(rows, columns=names).astype(object)
        for c in by:
            out[c] = first[c]
        return out[[*by, *names]]

    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.select(*by).schema.fields)
    return tiles.select(*by, at, "tile_row", "tile_col", "part").groupBy(*by, "tile_row", "tile_col").applyInPandas(run, f"{kinds}, {FOUND}")


def stretched_rows(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """rows with `value` as whole levels 0 to 255 between the 1 and 99.5 percentiles of its image's finite values; others are 0.

    The percentiles come from counts of distinct values, which combine before the shuffle.
    """
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    counts = rows.select(*by, F.explode(value).alias("__x")).where(finite(F.col("__x"))).groupBy(*by, "__x").agg(F.count("*").alias("__k"))
    cut = counts.groupBy(*by).agg(*[F.percentile("__x", F.lit(p), F.col("__k")).alias(n) for n, p in (("__lo", 0.01), ("__hi", 0.995))])
    part = lambda x: (x - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-9)) * 255
    level = F.transform(value, lambda x: F.when(finite(x), F.floor(F.least(F.greatest(part(x), F.lit(0.0)), F.lit(255.0))).cast("double")).otherwise(0.0))
    return rows.join(cut, by, "left").withColumn(value, level).drop("__lo", "__hi")


def mosaic_detections(rows: DataFrame, find: Detector, size: int = 640, overlap: float = 0.25, least: float = 0.25) -> DataFrame:
    """(path, cls, score, x1, y1, x2, y2, members, lat, lon, length_m, width_m, footprint) of mosaics (path, row, v, epsg, transform).

    Rows are stretched, cut into tiles and searched; boxes that overlap are united within a mosaic, and those under `least` go. A position
    is that of the box's centre and footprint its corners, both by the mosaic's own transform; lengths are of the box, on the ground.
    """
    grey = stretched_rows(rows.select("path", "row", "v"), ["path"], "v")
    found = detected(tiled(grey, ["path"], "row", "v", size, overlap), ["path"], "row", find)
    boxes = merged_boxes(found.where("not skipped"), ["path"]).where(F.col("score") >= least)
    about = rows.groupBy("path").agg(F.max("epsg").alias("epsg"), F.max("transform").alias("t"), (F.max("row") + 1).alias("h"))
    out = boxes.join(about, "path")
    at = lambda r, c: position(r, c, F.col("epsg"), F.col("t"))
    lat, lon = at((F.col("y1") + F.col("y2") - 1) / 2, (F.col("x1") + F.col("x2") - 1) / 2)
    corners = [at(F.col(y) - 0.5, F.col(x) - 0.5) for y, x in (("y1", "x1"), ("y1", "x2"), ("y2", "x2"), ("y2", "x1"))]
    ring = F.array(*[F.struct(F.round(a, 6).alias("lat"), F.round(b, 6).alias("lon")) for a, b in corners])
    t = lambda k: F.get("t", F.lit(k))
    degree = F.when(F.col("epsg").between(4000, 4999), 111_320.0 * F.cos(F.radians(t(3) + t(5) * F.col("h") / 2))).otherwise(1.0)
    pixel = F.sqrt(F.abs(t(1) * t(5))) * degree
    sides = [(F.col(f"{k}2") - F.col(f"{k}1")) * pixel for k in "xy"]
    own = ["path", "cls", "score", "x1", "y1", "x2", "y2", "members"]
    return out.select(*own, F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), F.greatest(*sides).alias("length_m"), F.least(*sides).alias("width_m"), ring.alias("footprint"))


def tile_exports(rows: DataFrame, by: list[str], nadir: int, step_m: float, size: int = 640, overlap: float = 0.25, most_masked: float = 0.8) -> DataFrame:
    """(by, name, tile, pixels: an array of rows, about: JSON) of the tiles of an image of rows (by, row, ping, v, masked, lat, lon, heading_deg).

    about holds a tile's place, its first and last ping and its four corners (clockwise from the upper left; null where its first or last
    row has no position). Tiles of which over most_masked of the rows are masked are left out. One group holds one tile.
    """
    cut = tiled(rows, by, "row", "v", size, overlap)
    fix = F.struct("ping", "lat", "lon", "heading_deg")
    one = cut.groupBy(*by, "tile", "tile_row", "tile_col").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row", "part"))), lambda x: x["part"]).alias("pixels"), F.min_by(fix, "row").alias("a"), F.max_by(fix, "row").alias("z"),
        F.avg(F.coalesce(F.col("masked"), F.lit(False)).cast("double")).alias("masked"),
    )
    right = F.col("tile_col") + F.size(F.get("pixels", F.lit(0))) - 1

    def corner(end: str, col: Column) -> Column:
        off = (col - nadir + 0.5) * step_m
        lat, lon = geo.moved(F.col(f"{end}.lat"), F.col(f"{end}.lon"), F.col(f"{end}.heading_deg") + F.when(off >= 0, 90).otherwise(-90), F.abs(off))
        return F.array(F.round(lat, 7), F.round(lon, 7))

    placed = F.col("a.lat").isNotNull() & F.col("a.lon").isNotNull() & F.col("z.lat").isNotNull() & F.col("z.lon").isNotNull()
    corners = F.when(placed, F.array(corner("a", F.col("tile_col")), corner("a", right), corner("z", right), corner("z", F.col("tile_col"))))
    place = F.struct(F.col("tile").alias("index"), F.col("tile_row").alias("row"), F.col("tile_col").alias("col"), F.lit(size).alias("size"))
    about = F.struct(*by, place.alias("tile"), F.col("a.ping").alias("ping_start"), F.col("z.ping").alias("ping_end"), F.lit(nadir).alias("nadir_col"), F.lit(step_m).alias("ground_res_m"), corners.alias("corners_latlon"))
    name = F.concat_ws("_", *[F.col(c).cast("string") for c in by], F.format_string("t%04d", "tile"))
    return one.where(F.col("masked") <= most_masked).select(*by, name.alias("name"), "tile", "pixels", F.to_json(about).alias("about"))


__all__ = ["bright_targets", "detected", "detector", "mosaic_detections", "regions", "register", "stretched_rows", "tile_exports", "tiled"]
