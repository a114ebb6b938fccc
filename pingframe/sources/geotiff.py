"""GeoTIFF mosaics as rows of pixels: uncompressed strips of the first band."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingframe.functions.geo import from_utm
from pingframe.functions.shapes import affine
from pingframe.sources.pages import Pages, listed

#: Fixed values of the format: tag numbers, bytes and letters of the field types, sample types by (format, bits), geographic keys.
WIDTH, HEIGHT, BITS, PACKING, STRIPS, BANDS, STRIP_ROWS, PLANAR, SAMPLE = 256, 257, 258, 259, 273, 277, 278, 284, 339
SCALE, TIE, MATRIX, KEYS = 33550, 33922, 34264, 34735
FIELD = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
PIXEL = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
MODEL_KEY, GEOGRAPHIC_KEY, PROJECTED_KEY = 1024, 2048, 3072

HEAD = "path string, error string, width long, height long, epsg int, transform array<double>, first long, rows long, at long, kind string, step long"
ROWS = "path string, row long, v array<double>, epsg int, transform array<double>"


class BadMosaic(ValueError):
    """The file is no mosaic that can be read; the text is the reason's code."""


def _tags(raw: Pages) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first image. Classic files and those with 64-bit offsets."""
    order = {b"II": "<", b"MM": ">"}.get(raw.take(0, 2))
    if order is None or raw.size < 16:
        raise BadMosaic("CORRUPT_HEADER")
    version = raw.unpack(f"{order}H", 2)[0]
    if version not in (42, 43):
        raise BadMosaic("CORRUPT_HEADER")
    big = version == 43
    at = raw.unpack(f"{order}Q", 8)[0] if big else raw.unpack(f"{order}I", 4)[0]
    wide, number, room = (8, "Q", 20) if big else (4, "I", 12)
    if at + 8 > raw.size:
        raise BadMosaic("CORRUPT_HEADER")
    n = raw.unpack(f"{order}{'Q' if big else 'H'}", at)[0]
    at += 8 if big else 2
    if at + n * room > raw.size:
        raise BadMosaic("CORRUPT_HEADER")
    out = {}
    for k in range(n):
        tag, kind, count = raw.unpack(f"{order}HH{number}", at + room * k)
        if kind not in FIELD:
            continue
        size, letter = FIELD[kind]
        place = at + room * k + room - wide
        where = place if size * count <= wide else raw.unpack(f"{order}{number}", place)[0]
        if where + size * count > raw.size:
            raise BadMosaic("CORRUPT_HEADER")
        out[tag] = raw.unpack(f"{order}{count}{letter}", where)
    return order, out


def _transform(tags: dict[int, tuple]) -> list[float]:
    """Six numbers: x = t0 + column * t1 + row * t2, y = t3 + column * t4 + row * t5, from a pixel's upper left corner."""
    if len(m := tags.get(MATRIX, ())) >= 8:
        found = [m[3], m[0], m[1], m[7], m[4], m[5]]
    elif len(s := tags.get(SCALE, ())) >= 2 and len(t := tags.get(TIE, ())) >= 6:
        found = [t[3] - t[0] * s[0], s[0], 0.0, t[4] + t[1] * s[1], 0.0, -s[1]]
    else:
        raise BadMosaic("CORRUPT_HEADER")
    if found == [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]:
        raise BadMosaic("CORRUPT_HEADER")
    return [float(x) for x in found]


def _epsg(tags: dict[int, tuple]) -> int | None:
    keys = tags.get(KEYS, ())
    held = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = held.get(PROJECTED_KEY if held.get(MODEL_KEY) == 1 else GEOGRAPHIC_KEY)
    return code if code and code < 32767 else None


def _strips(raw: Pages, epsg: int | None) -> list[tuple]:
    order, tags = _tags(raw)
    transform = _transform(tags)
    code = _epsg(tags) or epsg
    if code is None:
        raise BadMosaic("CRS_REQUIRED")
    bands, planar = tags.get(BANDS, (1,))[0], tags.get(PLANAR, (1,))[0]
    kind = PIXEL.get((tags.get(SAMPLE, (1,))[0], tags.get(BITS, (1,))[0]))
    if tags.get(PACKING, (1,))[0] != 1 or kind is None or STRIPS not in tags:
        raise BadMosaic("UNSUPPORTED_FORMAT")
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    deep = min(tags.get(STRIP_ROWS, (height,))[0], height)
    step = bands if planar == 1 else 1
    places = tags[STRIPS][: -(-height // deep)]
    size = np.dtype(kind).itemsize * step
    out = []
    for k, at in enumerate(places):
        rows = min(deep, height - k * deep)
        if at + rows * width * size > raw.size:
            raise BadMosaic("CORRUPT_HEADER")
        out.append((width, height, code, transform, k * deep, rows, at, f"{order}{kind}", step))
    return out


def strips(spark: SparkSession, path: str, epsg: int | None = None) -> DataFrame:
    """A row for each strip of each file under path, or one with its error.

    CORRUPT_HEADER: no TIFF, cut off, or without a geotransform (an identity is none). CRS_REQUIRED: neither the file nor epsg names a
    system. UNSUPPORTED_FORMAT: compressed, tiled, or of other samples than whole numbers and floats. epsg serves files without one.
    """
    names = [x.split()[0] for x in HEAD.split(", ")]

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in files:
            for path in f["path"]:
                with Pages(path) as raw:
                    try:
                        rows = [(path, None, *s) for s in _strips(raw, epsg)]
                    except BadMosaic as e:
                        rows = [(path, str(e), *[None] * 9)]
                yield pd.DataFrame(rows, columns=names).astype(object)

    return listed(spark, path).mapInPandas(run, HEAD)


def read(spark: SparkSession, path: str, epsg: int | None = None) -> DataFrame:
    """(path, row, v, epsg, transform): the first band of all mosaics under path, a row of pixels each; files with an error give none.

    Strips are dealt to all tasks, and each row is read by itself, so no file is held whole.
    """
    names = [x.split()[0] for x in ROWS.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            for s in f.itertuples():
                wide = int(s.width) * int(s.step) * np.dtype(s.kind).itemsize
                with Pages(s.path) as raw:
                    for k in range(int(s.rows)):
                        v = np.frombuffer(raw.take(int(s.at) + k * wide, wide), s.kind)[:: int(s.step)].astype(np.float64)
                        yield pd.DataFrame([(s.path, int(s.first) + k, v, int(s.epsg), s.transform)], columns=names)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return strips(spark, path, epsg).where("error is null").repartition(tasks, "path", "first").mapInPandas(run, ROWS)


def position(row: Column, col: Column, epsg: Column, transform: Column) -> tuple[Column, Column]:
    """(lat, lon) of a pixel's centre: geographic codes (4xxx) as they are, UTM on WGS84 by its zone, null in other systems."""
    x, y = affine(row, col, tuple(F.get(transform, F.lit(k)) for k in range(6)))
    north, south, geographic = epsg.between(32601, 32660), epsg.between(32701, 32760), epsg.between(4000, 4999)
    lat, lon = from_utm(x, F.when(south, y - 10_000_000).otherwise(y), epsg % 100)
    return F.when(geographic, y).when(north | south, lat), F.when(geographic, x).when(north | south, lon)
