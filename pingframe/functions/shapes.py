"""Boxes, crops, tiles and polygons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1); 0 if they do not meet."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def clipped(lo: Column, hi: Column, size: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), lo), F.least(size, hi)


def crop(x0: Column, x1: Column, y0: Column, y1: Column, width: Column, height: Column, least: int = 256, margin: float = 1.25) -> tuple[Column, Column, Column]:
    """(left, top, side) of a square around a box: a quarter larger than its longer side, at least `least`, moved into the image."""
    side = F.least(F.greatest(F.lit(least), F.ceil(margin * (x1 - x0)), F.ceil(margin * (y1 - y0))), width, height).cast("long")
    at = lambda lo, hi, size: F.greatest(F.lit(0), F.least(F.floor((lo + hi) / 2 - side / 2), size - side)).cast("long")
    return at(x0, x1, width), at(y0, y1, height), side


def tms_row(z: Column, y: Column) -> Column:
    """The row of an XYZ tile counted from the south; null outside zoom 0 to 24 or the grid."""
    rows = F.pow(F.lit(2.0), z).cast("long")
    return F.when(z.between(0, 24) & (y >= 0) & (y < rows), rows - 1 - y)


def affine(row: Column, col: Column, transform: tuple[float, ...]) -> tuple[Column, Column]:
    """The position of a pixel's centre under a six-number geotransform."""
    x0, dx, rx, y0, ry, dy = transform
    c, r = col + 0.5, row + 0.5
    return x0 + c * dx + r * rx, y0 + c * ry + r * dy


def polygon_area(points: Column) -> Column:
    nxt = F.concat(F.slice(points, 2, 1_000_000), F.slice(points, 1, 1))
    return F.abs(F.aggregate(F.zip_with(points, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, x: s + x)) / 2


def explanation(parts: dict[str, Column], flags: Column) -> Column:
    """`name 0.00` for each part that is there, then the flags."""
    texts = [F.when(v.isNotNull(), F.format_string(f"{k} %.2f", v)) for k, v in parts.items()]
    return F.concat_ws("; ", *texts, F.when(F.size(flags) > 0, F.concat(F.lit("flags "), F.array_join(flags, ", "))))
