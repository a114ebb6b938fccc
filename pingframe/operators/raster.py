"""Sample arrays of pings: geometry, gain, despeckling, texture and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pingframe.operators.blocks import median_filtered, numbered_rows
from pingframe.operators.ranking import percentiles
from pingframe.operators.series import backwards, edge_mean, interpolated
from pingframe.plans.tables import written


def ground_samples(samples: Column, slant_m: Column, height_m: Column, step_m: float, n: int) -> Column:
    """samples (evenly spread over the slant range, nadir first) at n ground ranges g = k * step_m, linear between samples; 0 beyond the range."""
    count = F.size(samples)

    def at(k: Column) -> Column:
        g = k * F.lit(step_m)
        i = F.sqrt(g * g + height_m * height_m) / slant_m * count
        lo = F.floor(i).cast("int")
        a, b = F.get(samples, lo), F.coalesce(F.get(samples, lo + 1), F.get(samples, lo))
        return F.when(i <= count - 1, a + (b - a) * (i - lo)).otherwise(F.lit(0.0))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def port_order(samples: DataFrame, side: str, sample: str, value: str, n: int, bins: int = 256, margin: float = 0.2) -> DataFrame:
    """(same, turned, order): whether the port samples are stored as the starboard ones are, or the other way round.

    Mean log1p values of each side in up to `bins` bins of the range are correlated, as they are and turned. order is `nadir_first`,
    `nadir_last`, or null if the two differ by less than margin.
    """
    count = min(bins, n)
    b = F.floor(F.col(sample) * count / n).cast("int")
    log = lambda name: F.avg(F.when(F.col(side) == name, F.log1p(value)))
    profile = samples.groupBy(b.alias("b")).agg(log("port").alias("p"), log("starboard").alias("s"))
    turned = profile.select((count - 1 - F.col("b")).alias("b"), F.col("s").alias("r"))
    both = profile.join(turned, "b").agg(F.corr("p", "s").alias("same"), F.corr("p", "r").alias("turned"))
    order = F.when(F.abs(F.col("same") - F.col("turned")) < margin, None).when(F.col("same") > F.col("turned"), "nadir_first").otherwise("nadir_last")
    return both.withColumn("order", order)


def row_image(port: Column, starboard: Column) -> Column:
    """One raster row: the reversed port side, then starboard."""
    return F.concat(F.reverse(port), starboard)


def near_nadir(n: int, step_m: float, altitude_m: Column, share: float = 0.3) -> Column:
    """For each of n ground ranges whether it is under share * altitude."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k * F.lit(step_m) < share * altitude_m)


def mean_std(values: Column) -> tuple[Column, Column]:
    """Mean and population standard deviation of an array."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    square = F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x) / n
    return mean, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))


def dropouts(pings: DataFrame, at: str = "ping", flat: float = 0.05, dark: float = 1.0) -> DataFrame:
    """(at, mean, std, dropout): a ping drops out if it is flat against the median positive deviation, dark, or the same as the one before.

    Pings of a line are numbered without gaps, so the one before is found by an equi-join on number + 1 (by a hash of its samples); the
    median is one number of the whole line, narrowed before anything is sorted, joined back by broadcast.
    """
    mean, std = mean_std(F.concat(F.transform("port", lambda x: x.cast("double")), F.transform("starboard", lambda x: x.cast("double"))))
    rows = pings.select(at, mean.alias("mean"), std.alias("std"), F.xxhash64("port", "starboard").alias("h"))
    middle = percentiles(rows.where("std > 0"), "std", {"middle": 0.5})
    before = rows.select((F.col(at) + 1).alias(at), F.col("h").alias("h_before"))
    out = rows.join(before, at, "left").join(F.broadcast(middle))
    same = F.coalesce(F.col("h") == F.col("h_before"), F.lit(False))
    low = F.coalesce(F.col("std") < flat * F.col("middle"), F.lit(False))
    return out.select(at, "mean", "std", (low | (F.col("mean") < dark) | same).alias("dropout"))


def repaired(pings: DataFrame, dropout: str, by: list[str], at: str = "ping", most_gap: int = 3) -> DataFrame:
    """pings (by, at, port, starboard, dropout) with `inpainted` and `masked`: short gaps filled, long ones and those at an end masked.

    A gap of at most most_gap pings between two good ones takes their linear mean, rounded; its neighbours come from windows over the
    line's order, which carry one array each side.
    """
    w = Window.partitionBy(*by).orderBy(at)
    good = F.when(~F.col(dropout), F.struct(F.col(at).alias("at"), "port", "starboard"))
    rows = pings.withColumn("__lo", F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("__hi", F.last(good, ignorenulls=True).over(backwards(by, at).rowsBetween(Window.unboundedPreceding, -1)))
    gap = F.col("__hi.at") - F.col("__lo.at") - 1
    fill = F.col(dropout) & F.coalesce(gap <= most_gap, F.lit(False))
    share = (F.col(at) - F.col("__lo.at")) / (gap + 1)

    def side(c: str) -> Column:
        mixed = F.zip_with(F.col(f"__lo.{c}"), F.col(f"__hi.{c}"), lambda a, b: F.bround(a * (1 - share) + b * share, 0).cast("long"))
        return F.when(F.col("inpainted"), mixed).otherwise(F.col(c)).alias(c)

    marked = rows.withColumn("inpainted", fill).withColumn("masked", F.col(dropout) & ~fill)
    others = [c for c in pings.columns if c not in ("port", "starboard")]
    return marked.select(*others, side("port"), side("starboard"), "inpainted", "masked")


def flattened(samples: DataFrame, by: list[str], at: str, value: str, window: int = 200) -> DataFrame:
    """samples with `flat`: each column (`by`) divided by its running mean along `at`, values over the column's 99th percentile capped in the
    mean, so that a bright object does not darken what is around it. The mean is at least a thousandth of the median mean.

    The window reaches window // 2 rows back and the rest ahead, with replicated edges. Percentiles come from counts of distinct values.
    """
    counts = samples.groupBy(*by, value).agg(F.count("*").alias("__k"))
    caps = counts.groupBy(*by).agg(F.percentile(value, F.lit(0.99), F.col("__k")).alias("__cap"))
    capped = samples.join(caps, by).withColumn("__c", F.least(F.col(value).cast("double"), "__cap"))
    mean = capped.withColumn("__mean", edge_mean(F.col("__c"), by, at, window // 2, window - window // 2 - 1))
    stored = written(mean.select(*samples.columns, "__mean"), "flat")
    floor = percentiles(stored, "__mean", {"__mid": 0.5})
    low = F.greatest(F.coalesce("__mid", F.lit(0.0)) * 1e-3, F.lit(1e-6))
    return stored.join(F.broadcast(floor)).withColumn("flat", F.col(value) / F.greatest("__mean", low)).drop("__mean", "__mid")


def stretched(samples: DataFrame, side: str, value: str, at: str) -> DataFrame:
    """samples with level: value over its side's median of positive values, log1p, between the shared 1 and 99.5 percentiles, as 0..255.

    Medians and percentiles come from the counts of distinct values of a side.
    """
    counts = samples.groupBy(side, value).agg(F.count("*").alias("__k"))
    middle = counts.where(F.col(value) > 0).groupBy(side).agg(F.percentile(value, F.lit(0.5), F.col("__k")).alias("__m"))
    gain = F.log1p(F.col(value) / F.col("__m"))
    gained = counts.join(middle, side).withColumn("__g", gain)
    cut = gained.agg(F.percentile("__g", F.lit(0.01), F.col("__k")).alias("__lo"), F.percentile("__g", F.lit(0.995), F.col("__k")).alias("__hi"))
    level = F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("__g") - F.col("__lo"), F.col("__hi") - F.col("__lo")))) * 255, 0)
    both = samples.join(middle, side).withColumn("__g", gain).join(F.broadcast(cut))
    return both.withColumn("level", F.coalesce(level, F.lit(0.0)).cast("int")).drop("__m", "__g", "__lo", "__hi")


def first_returns(samples: DataFrame, ping: str, sample: str, value: str, n: int, times: float = 3.0, blank: float = 0.005, rise: float = 0.3) -> DataFrame:
    """(ping, first_return): the first sample from which on the mean of both sides, smoothed along the ping, stays over the threshold.

    The search is the first half after the blanked share. Noise is the lower of its 5th percentile and the median of the leading
    samples, at least 1; the threshold is the higher of times * noise and a rise from there towards the search's median. Four fifths
    of the next max(5, n / 100) samples must be over it too. A ping is an array of its own row, so nothing meets but its samples; a
    ping without a return gives null.
    """
    profile = samples.groupBy(ping, sample).agg(F.avg(F.col(value).cast("double")).alias("m"))
    rows = profile.groupBy(ping).agg(F.array_sort(F.collect_list(F.struct(F.col(sample).alias("i"), "m"))).alias("a")).select(ping, F.transform("a", lambda x: x["m"]).alias("p"))
    width, start, stop = max(3, n // 200), int(n * blank), max(int(n * blank) + 1, n // 2)
    run = min(max(5, n // 100), stop - start)
    before = width // 2
    at = lambda a, i: F.get(a, F.greatest(F.lit(0), F.least(i, F.lit(n - 1))))
    smooth = F.transform(F.sequence(F.lit(start), F.lit(stop - 1)), lambda i: sum((at(F.col("p"), i + (k - before)) for k in range(width)), F.lit(0.0)) / width)
    rows = rows.withColumn("s", smooth).withColumn("lead", F.slice("p", 1, max(start, 4)))
    rows = rows.withColumn("noise", F.greatest(F.least(_of_array("s", 0.05), _of_array("lead", 0.5)), F.lit(1.0)))
    level = F.greatest(times * F.col("noise"), F.col("noise") + rise * (_of_array("s", 0.5) - F.col("noise")))
    rows = rows.withColumn("level", level).withColumn("over", F.transform("s", lambda x: (x > F.col("level")).cast("int")))
    places = F.sequence(F.lit(0), F.lit(stop - start - run))
    holds = lambda i: (F.get("over", i) == 1) & (F.aggregate(F.slice("over", i + 1, run), F.lit(0), lambda s, x: s + x) >= 0.8 * run)
    return rows.select(ping, (F.get(F.filter(places, holds), F.lit(0)) + start).cast("double").alias("first_return"))


def _of_array(name: str, share: float) -> Column:
    """A linear percentile of an array column."""
    a, at = F.array_sort(F.col(name)), share * (F.size(name) - 1)
    low = F.floor(at).cast("int")
    return F.get(a, low) + (F.coalesce(F.get(a, low + 1), F.get(a, low)) - F.get(a, low)) * (at - low)


def bottom_track(firsts: DataFrame, by: list[str], ping: str, run: int = 5, window: int = 31, long: int = 1001) -> DataFrame:
    """firsts with `tracked`: gaps filled along the line, values over half off a long running median replaced, then a running median.

    Runs of pings without a near return jump far out, which a short median cannot remove. Medians have odd windows with replicated
    edges, and are taken by blocks of pings and those around them.
    """
    filled = numbered_rows(interpolated(firsts, "first_return", ping, by, "__first"), by, ping, "__at")
    trend = median_filtered(filled, by, "__at", "__first", long, "__trend")
    good = F.col("first_return").isNotNull() & (F.abs(F.col("__first") - F.col("__trend")) <= F.greatest(0.5 * F.col("__trend"), F.lit(float(run))))
    again = interpolated(trend.withColumn("__good", F.when(good, F.col("first_return"))), "__good", ping, by, "__whole")
    whole = again.withColumn("__whole", F.coalesce("__whole", "__first"))
    return median_filtered(whole, by, "__at", "__whole", window, "tracked").drop("__at", "__first", "__trend", "__good", "__whole")


def chosen_altitude(recorded: Column, tracked: Column, mode: str = "auto", tolerance: float = 0.25) -> tuple[Column, Column]:
    """(altitude, whether it is the tracked one). auto: the recorded one where it is within a share of the tracked one; true: the tracked
    one where there is one; false: ever the recorded one."""
    if mode not in ("auto", "true", "false"):
        raise ValueError(f"unknown mode: {mode}")
    agree = F.coalesce(F.abs(recorded - tracked) <= tolerance * F.greatest(tracked, F.lit(1e-6)), F.lit(False))
    use = {"auto": tracked.isNotNull() & ~agree, "true": tracked.isNotNull(), "false": F.lit(False)}[mode]
    return F.when(use, tracked).otherwise(recorded), use


def _box(values: DataFrame, row: str, col: str, what: Column, half: int, out: str) -> DataFrame:
    """values with the mean of `what` over a square of 2 half + 1 that is mirrored at the borders: one pass along rows, one along columns.

    A row or column of index -k is that of k - 1: cells near a border are sent to their mirror places too, so each pass is a grouped
    sum of (2 half + 1) copies at most, which combine before the shuffle.
    """

    def spread(df: DataFrame, axis: str, other: str, value: str) -> DataFrame:
        size = df.agg(F.max(axis).alias("__last"))
        at = F.col(axis)
        places = F.flatten(F.transform(F.array(at, -at - 1, 2 * F.col("__last") + 1 - at), lambda p: F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda d: p + d)))
        real = F.filter(places, lambda p: (p >= 0) & (p <= F.col("__last")))
        sent = df.join(F.broadcast(size)).select(other, F.explode(real).alias(axis), F.col(value).alias("__v"))
        return sent.groupBy(axis, other).agg((F.sum("__v") / (2 * half + 1)).alias(value))

    one = spread(values.select(row, col, what.alias(out)), col, row, out)
    return spread(one, row, col, out)


def lee_filtered(image: DataFrame, row: str, col: str, value: str, half: int = 2) -> DataFrame:
    """(row, col, value, mean, variance, filtered): Lee's filter; the noise is the mean local variance of the image."""
    x = F.col(value).cast("double")
    mean = _box(image, row, col, x, half, "mean")
    square = _box(image, row, col, x * x, half, "square")
    both = image.join(mean, [row, col]).join(square, [row, col]).withColumn("variance", F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    noise = both.agg(F.avg("variance").alias("noise"))
    weight = F.coalesce(F.try_divide(F.col("variance"), F.col("variance") + F.col("noise")), F.lit(0.0))
    return both.join(F.broadcast(noise)).select(row, col, value, "mean", "variance", (F.col("mean") + weight * (x - F.col("mean"))).alias("filtered"))


def tiles_of(at: Column, n: Column, size: int, overlap: float) -> Column:
    """The starts of the tiles that hold the row or column `at` of a raster of n, by the rule of tile_starts()."""
    step, last = max(1, round(size * (1 - overlap))), F.greatest(n - size, F.lit(0)).cast("long")
    near = F.transform(F.sequence(F.lit(0), F.lit(-(-size // step))), lambda k: (F.floor(at / step) - k) * step)
    regular = F.filter(near, lambda s: (s >= 0) & (s < last) & (s > at - size) & (s <= at))
    return F.concat(regular, F.when(at >= last, F.array(last)).otherwise(F.array().cast("array<long>")))


def tile_starts(n: int, size: int, overlap: float) -> list[int]:
    """Offsets every round(size * (1 - overlap)); the last tile ends at n. A raster no longer than a tile has one."""
    step = max(1, round(size * (1 - overlap)))
    last = max(0, n - size)
    return sorted({*range(0, last, step), last}) if n > size else [0]


def cooccurrence(image: DataFrame, row: str, col: str, level: str, levels: int = 8, top: int = 256) -> DataFrame:
    """contrast, homogeneity and energy of the symmetric horizontal grey-level co-occurrence of the image."""
    grey = F.floor(F.col(level) * levels / top)
    pair = image.select(grey.alias("i"), F.lead(grey).over(Window.partitionBy(row).orderBy(col)).alias("j")).where("j is not null")
    counts = pair.unionAll(pair.select(F.col("j").alias("i"), F.col("i").alias("j"))).groupBy("i", "j").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    p, d = F.col("n") / F.col("total"), F.col("i") - F.col("j")
    return counts.join(F.broadcast(total)).agg(F.sum(p * d * d).alias("contrast"), F.sum(p / (1 + F.abs(d))).alias("homogeneity"), F.sqrt(F.sum(p * p)).alias("energy"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


#: Numbers of a bank's vectors that are held against the probes in one pass: 50 MB of doubles.
BANK_BLOCK = 6_400_000


def bank_distance(probes: DataFrame, bank: DataFrame, block: int = BANK_BLOCK) -> DataFrame:
    """probes (id, v) with the distance to the nearest vector of the bank; null if the bank is empty.

    The bank's numbers are counted, and blocks of about so many go to all tasks one after the other; a block's distances are stored
    before the next.
    """
    n = -(-(bank.agg(F.sum(F.size("v"))).first()[0] or 0) // block)
    parts = [written(_nearest_of(probes, bank.where(F.pmod(F.xxhash64("v"), F.lit(n)) == k) if n > 1 else bank), "bank") for k in range(n)]
    if not parts:
        return probes.select("id", F.lit(None).cast("double").alias("distance"))
    return parts[0] if n == 1 else reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.min("distance").alias("distance"))


def _nearest_of(probes: DataFrame, bank: DataFrame) -> DataFrame:
    known = np.array([r["v"] for r in bank.select("v").collect()], dtype=np.float64)
    norm = (known**2).sum(axis=1) if len(known) else None

    @F.pandas_udf("double")
    def nearest(vs: pd.Series) -> pd.Series:
        if norm is None:
            return pd.Series([None] * len(vs), dtype="float64")
        return pd.Series(_distances(np.stack(vs.to_numpy()).astype(np.float64), known, norm))

    return probes.select("id", nearest("v").alias("distance"))


#: Vectors of a bank that a tile of 512 probes is held against at a time, so a worker holds 16 MB a table of distances.
BANK_TILE = 4_096


def _distances(x: np.ndarray, known: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The distance of each row of x to the nearest of known, whose squared lengths are norm."""
    best = np.empty(len(x))
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        least, near = np.full(len(part), np.inf), np.zeros(len(part), np.int64)
        for start in range(0, len(known), BANK_TILE):
            square = part @ known[start : start + BANK_TILE].T
            square *= -2
            square += norm[start : start + BANK_TILE]
            k = square.argmin(axis=1)
            own = square[np.arange(len(part)), k]
            nearer = own < least
            least[nearer], near[nearer] = own[nearer], k[nearer] + start
        best[at : at + 512] = np.sqrt(((part - known[near]) ** 2).sum(axis=1))
    return best


def _farthest(x: np.ndarray, size: int) -> list[int]:
    """Places of a farthest-first walk over the rows of x from the first one on (ties: the first); it ends where all rows are chosen ones."""
    chosen, near = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < size and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return chosen


#: Picks that one task picks from.
PICKS = 50_000


def coreset(vectors: DataFrame, size: int, dims: int = 128, seed: int = 0) -> DataFrame:
    """(rank, id, v) of up to `size` of the vectors (id, v) that lie far from each other; rank 0 is a smallest id.

    Each batch of rows gives its farthest-first picks, and picks are picked from again until one task can walk over those left: no job a vector, and no
    more than a batch in memory. Where one batch holds all vectors this is the plain walk, which covers them within twice the least possible radius;
    every further level adds as much, so two levels cover within four times that radius. Vectors of more than `dims` numbers are compared by a
    seeded random projection to so many. Nulls are left out.
    """

    def picks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b = b.sort_values("id", kind="stable")
                x = np.stack(b["v"].to_numpy()).astype(np.float64)
                if x.shape[1] > dims:
                    x = x @ np.random.default_rng(seed).normal(size=(x.shape[1], dims)) / np.sqrt(dims)
                own = b.iloc[_farthest(x, size)]
                yield own.assign(rank=np.arange(len(own), dtype=np.int32))[["rank", "id", "v"]]

    kinds = dict(vectors.dtypes)
    schema = f"rank int, id {kinds['id']}, v {kinds['v']}"
    now = written(vectors.select("id", "v").where("id is not null and v is not null").mapInPandas(picks, schema), "picks")
    while (n := now.count()) > PICKS and n > 2 * size:
        now = written(now.select("id", "v").repartition(-(-n // PICKS)).mapInPandas(picks, schema), "picks")

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from picks(iter([pd.concat(held)] if (held := list(batches)) else []))

    return now.select("id", "v").coalesce(1).mapInPandas(last, schema)


def dark_run(dark: Column, most_gap: int = 3) -> Column:
    """(start, length) of the first run of true values of an array that begins within most_gap places; single false ones do not end it."""
    n = F.size(dark)
    start = F.get(F.filter(F.sequence(F.lit(0), F.lit(most_gap)), lambda i: F.coalesce(F.get(dark, i), F.lit(False))), F.lit(0))
    bright = lambda i: ~F.coalesce(F.get(dark, i), F.lit(False))
    end = F.get(F.filter(F.sequence(F.lit(0), n), lambda e: (e > start) & bright(e) & bright(e + 1)), F.lit(0))
    return F.when(start.isNotNull(), F.struct(start.alias("start"), (F.least(end, n) - start).alias("length"))).otherwise(F.struct(F.lit(0).alias("start"), F.lit(0).alias("length")))


#: A row counts as shadowed from a run of so many samples on.
LEAST_RUN = 2


def shadow_scores(boxes: DataFrame, image: DataFrame, nadir: int, step_m: float, ring: int = 6, most_m: float = 15.0, dark_share: float = 0.6, most_gap: int = 3) -> DataFrame:
    """(id, contrast, darkness, coverage, shadow_m, height_m, score) of each box (id, x1, y1, x2, y2, altitude_m; ends exclusive) on an image of
    rows (y, v: an array, 0 is no data).

    The background is the median of a ring of `ring` cells around the box without the side that the shadow lies on; the object is bright
    against it, and on each of its rows a run of samples under dark_share of it begins within most_gap cells of the far edge.
    score = sqrt(contrast * darkness) * min(1, coverage / 0.5). A height needs an altitude, three tenths of the rows shadowed, and shadows
    of which half at least end before their reach does. Boxes whose ring holds under 8 values, or whose rows are not there, score 0.

    A box meets its rows by an equi-join on their numbers, and only what its ring and its shadow need is kept of each.
    """
    starboard = (F.col("x1") + F.col("x2")) / 2 >= nadir
    wide = F.size("v")
    rows = boxes.withColumn("y", F.explode(F.sequence(F.greatest(F.col("y1") - ring, F.lit(0)), F.col("y2") + ring - 1))).join(image, "y")
    own = (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))
    cut = lambda a, lo, hi: F.slice(a, F.greatest(lo, F.lit(0)).cast("int") + 1, F.greatest(F.lit(0), F.least(hi, wide) - F.greatest(lo, F.lit(0))).cast("int"))
    near = cut(F.col("v"), F.col("x1") - ring, F.col("x1"))
    far = cut(F.col("v"), F.col("x2"), F.col("x2") + ring)
    middle = F.when(own, F.array().cast("array<double>")).otherwise(cut(F.col("v"), F.col("x1"), F.col("x2")))
    around = F.filter(F.concat(F.when(starboard, near).otherwise(far), middle), lambda x: x > 0)
    reach = max(1, round(most_m / step_m)) + most_gap
    behind = F.when(starboard, cut(F.col("v"), F.col("x2"), F.col("x2") + reach)).otherwise(F.reverse(cut(F.col("v"), F.col("x1") - reach, F.col("x1"))))
    inside = F.when(own, F.struct("y", cut(F.col("v"), F.col("x1"), F.col("x2")).alias("object"), behind.alias("behind")))
    each = rows.select("id", "x1", "x2", "altitude_m", around.alias("ring"), inside.alias("own"))
    met = each.groupBy("id", "x1", "x2", "altitude_m").agg(F.flatten(F.collect_list("ring")).alias("ring"), F.collect_list("own").alias("own"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    met = met.where((F.size("ring") >= 8) & (F.size("own") > 0)).withColumn("back", F.greatest(_of_array("ring", 0.5), F.lit(1.0)))
    shadows = F.transform("own", lambda o: F.struct(o["behind"].alias("behind"), dark_run(F.transform(o["behind"], lambda x: x < F.col("back") * dark_share), most_gap).alias("run")))
    met = met.withColumn("contrast", _unit((mean(F.flatten(F.transform("own", lambda o: o["object"]))) - F.col("back")) / F.col("back"))).withColumn("s", shadows)
    met = met.withColumn("long", F.filter("s", lambda x: x["run"]["length"] >= LEAST_RUN))
    seen = F.flatten(F.transform("long", lambda x: F.slice(x["behind"], x["run"]["start"] + 1, x["run"]["length"])))
    met = met.withColumn("coverage", F.size("long") / F.size("s")).withColumn("lengths", F.transform("long", lambda x: x["run"]["length"].cast("double")))
    some = F.size("long") > 0
    met = met.withColumn("darkness", F.when(some, _unit((F.col("back") - mean(seen)) / F.col("back"))).otherwise(0.0))
    met = met.withColumn("shadow_m", F.when(some, _of_array("lengths", 0.5) * step_m))
    far_m = F.greatest(F.when(starboard, F.col("x2") - nadir).otherwise(nadir - F.col("x1")), F.lit(0)) * step_m
    cut_off = F.size(F.filter("long", lambda x: x["run"]["start"] + x["run"]["length"] >= F.size(x["behind"])))
    usable = (F.col("coverage") >= 0.3) & (cut_off <= F.size("long") / 2) & (F.col("altitude_m") > 0)
    height = F.when(usable, F.col("shadow_m") * F.col("altitude_m") / (far_m + F.col("shadow_m")))
    score = F.when(some, F.sqrt(F.col("contrast") * F.col("darkness")) * F.least(F.lit(1.0), F.col("coverage") / 0.5)).otherwise(0.0)
    out = met.select("id", "contrast", "darkness", F.when(some, F.col("coverage")).otherwise(0.0).alias("coverage"), "shadow_m", height.alias("height_m"), score.alias("score"))
    return boxes.select("id").join(out, "id", "left").na.fill(0.0, ["contrast", "darkness", "coverage", "score"])


def _unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
