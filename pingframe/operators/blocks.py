"""Filters over rows of an image or line in blocks: a task gets the rows of one block and those around it, and filters them at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block.
BLOCK_ROWS = 2_048
#: Numbers that a running median sorts at once.
SORTED = 4_000_000

#: From a block's values, with `halo` rows more at both ends, and the rows of the whole line: an array of the block's rows for each result.
Filter = Callable[[np.ndarray, int], tuple[np.ndarray, ...]]


def filtered(rows: DataFrame, by: list[str], at: str, value: str, f: Filter, halo: int, results: dict[str, str], edge: str = "edge", size: int | None = None) -> DataFrame:
    """rows with the results (name: type) of f, which is called once a block.

    at: places 0, 1, 2 .. of the rows of each line (by), none missing; value: a number or an array of equal length. Beyond the ends of a line rows go on as
    np.pad does by `edge`: edge, reflect (without the last row) or symmetric (with it). Each row goes to its own block and to those that it is less than
    `halo` rows off, so a line of any length takes blocks of bounded size. Nulls are NaN to f, and NaN results are null. Empty tables give none.
    """
    size = size or BLOCK_ROWS
    ends = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.max(at).alias("__last"))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by), F.lit(True))
    place = F.col(at).cast("long")
    blocks = F.sequence(F.floor(F.greatest(place - halo, F.lit(0)) / size), F.floor(F.least(place + halo, F.col("__last")) / size))
    sent = rows.join(ends, same).drop(*[f"__{c}" for c in by]).withColumn("__block", F.explode(blocks))
    wide = dict(rows.dtypes)[value].startswith("array")
    names = rows.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        block, last, places = int(pdf["__block"].iloc[0]), int(pdf["__last"].iloc[0]), pdf[at].to_numpy().astype(np.int64)
        if len(places) != places[-1] - places[0] + 1:
            raise ValueError(f"rows are missing or repeated between {places[0]} and {places[-1]}")
        x = np.stack([np.asarray(v, np.float64) for v in pdf[value]]) if wide else pdf[value].to_numpy(np.float64)
        first, end = block * size, min((block + 1) * size, last + 1)
        above, below = halo - (first - int(places[0])), halo - (int(places[-1]) + 1 - end)
        x = np.pad(x, [(above, below)] + [(0, 0)] * (x.ndim - 1), mode=edge if len(x) > 1 else "edge")
        out = pdf.loc[(places >= first) & (places < end), names].copy()
        for name, found in zip(results, f(x, last + 1), strict=True):
            out[name] = list(found) if found.ndim > 1 else pd.Series(found, index=out.index).where(np.isfinite(found), None)
        return out

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), *(f"`{c}` {t}" for c, t in results.items())])
    return sent.groupBy(*by, "__block").applyInPandas(run, schema)


def numbered_rows(rows: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """rows with their place in each line, from 0."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("long"))


def median_filtered(rows: DataFrame, by: list[str], at: str, value: str, window: int, out: str) -> DataFrame:
    """rows with a running median of a centred odd window with replicated edges; a line that is shorter takes the largest odd one that fits."""
    half = window // 2

    def f(x: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        reach = min(half, (n - 1) // 2)
        seen = np.lib.stride_tricks.sliding_window_view(x[half - reach : len(x) - (half - reach)], 2 * reach + 1)
        step = max(1, SORTED // (2 * reach + 1))
        return (np.concatenate([np.median(seen[k : k + step], axis=1) for k in range(0, len(seen), step)]),)

    return filtered(rows, by, at, value, f, half, {out: "double"})


def _along(x: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sums of as many neighbours as there are weights; the axis gets shorter by all but one."""
    n = x.shape[axis] - len(weights) + 1
    return sum(w * np.take(x, range(k, k + n), axis=axis) for k, w in enumerate(weights))


def gauss(sigma: float, radius: int) -> np.ndarray:
    w = np.exp(-((np.arange(-radius, radius + 1) / sigma) ** 2) / 2)
    return w / w.sum()


def blurred(rows: DataFrame, by: list[str], at: str, value: str, sigma: float, out: str, radius: int | None = None) -> DataFrame:
    """rows (value: an array) blurred by a Gauss curve cut off at `radius` (four sigma), along rows and then along columns; mirrored at borders without the last cell."""
    radius = round(4 * sigma) if radius is None else radius
    weights = gauss(sigma, radius)

    def f(x: np.ndarray, _: int) -> tuple[np.ndarray, ...]:
        mode = "reflect" if x.shape[1] > 1 else "edge"
        return (_along(_along(np.pad(x, [(0, 0), (radius, radius)], mode=mode), weights, 1), weights, 0),)

    return filtered(rows, by, at, value, f, radius, {out: "array<double>"}, "reflect")


def local_moments(rows: DataFrame, by: list[str], at: str, value: str, windows: dict[str, int]) -> DataFrame:
    """rows (value: an array) with mean and variance over a square of each odd window: columns <name>_mean and <name>_var; mirrored at borders."""
    halo = max(windows.values()) // 2

    def f(x: np.ndarray, _: int) -> tuple[np.ndarray, ...]:
        padded, out = np.pad(x, [(0, 0), (halo, halo)], mode="symmetric"), []
        for w in windows.values():
            cut = halo - w // 2
            own = padded[cut : len(padded) - cut or None, cut : padded.shape[1] - cut or None]
            even = np.full(w, 1 / w)
            mean, square = (_along(_along(y, even, 1), even, 0) for y in (own, own * own))
            out += [mean, np.maximum(square - mean * mean, 0)]
        return tuple(out)

    return filtered(rows, by, at, value, f, halo, {f"{n}_{what}": "array<double>" for n in windows for what in ("mean", "var")}, "symmetric")


def channels(rows: DataFrame, by: list[str], at: str, value: str, lee: int = 5, texture: int = 7) -> DataFrame:
    """rows (value: an array of grey levels 0 to 255) with `channels`: arrays of the grey level, Lee's filter and twice the local deviation, as whole numbers 0 to 255.

    The noise of Lee's filter is the mean local variance of an image (by); an image without any is its local mean.
    """
    moments = local_moments(rows, by, at, value, {"__lee": lee, "__texture": texture})
    total = F.aggregate("__lee_var", F.lit(0.0), lambda s, x: s + x)
    noise = moments.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg((F.sum(total) / F.sum(F.size("__lee_var"))).alias("__noise"))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by), F.lit(True))
    both = moments.join(noise, same)
    byte = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(x))).cast("int")
    smooth = F.transform(F.arrays_zip(F.col(value).alias("x"), F.col("__lee_mean").alias("m"), F.col("__lee_var").alias("v")), lambda c: byte(c["m"] + F.coalesce(F.try_divide(c["v"], c["v"] + F.col("__noise")), F.lit(0.0)) * (c["x"] - c["m"])))
    stack = F.array(F.transform(value, byte), smooth, F.transform("__texture_var", lambda v: byte(2 * F.sqrt(v))))
    return both.select(*[F.col(c) for c in rows.columns], stack.alias("channels"))
