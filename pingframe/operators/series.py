"""Ordered columns of a line: means with replicated edges, interpolation, runs, gates and resampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from pingframe.functions.geo import EARTH_M, haversine
from pingframe.plans.tables import written


def edge_mean(value: Column, by: list[str], order: str, before: int, after: int) -> Column:
    """Mean over `before` rows before to `after` rows after; beyond the ends the first and last value go on."""
    every = Window.partitionBy(*by).orderBy(order)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = F.row_number().over(every) - 1, F.count("*").over(whole)
    inside = F.sum(value).over(every.rowsBetween(-before, after))
    left = F.greatest(F.lit(0), F.lit(before) - i) * F.first(value).over(whole)
    right = F.greatest(F.lit(0), i + after - (n - 1)) * F.last(value).over(whole)
    return (inside + left + right) / (before + after + 1)


def smoothed_heading(rows: DataFrame, heading: str, by: list[str], order: str, window: int = 25) -> DataFrame:
    """heading_smooth: circular mean over a centred odd window with replicated edges; missing headings weigh nothing, and a window
    without any gives null."""
    half = window // 2
    ok = F.when(F.col(heading).isNull(), 0.0).otherwise(1.0)
    part = lambda f: edge_mean(F.when(F.col(heading).isNull(), 0.0).otherwise(f(F.radians(heading))), by, order, half, half)
    s, c, w = part(F.sin), part(F.cos), edge_mean(ok, by, order, half, half)
    return rows.withColumn("heading_smooth", F.when(w > 1e-12, F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0))))


def turned(angle: Column, before: Column) -> Column:
    """Absolute difference of two directions, 0 to 180."""
    return F.abs(F.pmod(angle - before + 180, F.lit(360.0)) - 180)


def backwards(by: list[str], at: str) -> WindowSpec:
    """A line from its end: what lies ahead comes before a row there and is carried on; a frame that ends at the last row starts anew for each."""
    return Window.partitionBy(*by).orderBy(F.desc(at))


def _known(value: Column, at: str, by: list[str]) -> tuple[Column, Column]:
    """The known point at or before, and at or after, each row; a point has x, y and the known points before (p) and after (q) it."""
    w = Window.partitionBy(*by).orderBy(at)
    k = F.when(value.isNotNull(), F.struct(F.col(at).cast("double").alias("x"), value.alias("y")))
    p = F.last(k, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    q = F.last(k, ignorenulls=True).over(backwards(by, at).rowsBetween(Window.unboundedPreceding, -1))
    return k, F.struct(p.alias("p"), q.alias("q"))


def interpolated(rows: DataFrame, value: str, at: str, by: list[str], out: str, extrapolate: bool = False) -> DataFrame:
    """rows with `out`: value, with gaps filled linearly over `at`. Beyond the known ends the end value goes on, or, with extrapolate,
    the line through the two known points nearest the end. A line without known values stays null."""
    k, around = _known(F.col(value), at, by)
    marked = rows.withColumn("__k", k).withColumn("__r", around)
    full = F.when(F.col("__k").isNotNull(), F.struct(F.col("__k.x").alias("x"), F.col("__k.y").alias("y"), F.col("__r.p").alias("p"), F.col("__r.q").alias("q")))
    marked = marked.withColumn("__f", full)
    w = Window.partitionBy(*by).orderBy(at)
    marked = marked.withColumn("__lo", F.last("__f", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("__hi", F.last("__f", ignorenulls=True).over(backwards(by, at).rowsBetween(Window.unboundedPreceding, 0)))
    x = F.col(at).cast("double")

    def line(a: str, b: str) -> Column:
        step = F.try_divide(F.col(f"{b}.y") - F.col(f"{a}.y"), F.col(f"{b}.x") - F.col(f"{a}.x"))
        return F.col(f"{a}.y") + step * (x - F.col(f"{a}.x"))

    beyond_lo = F.coalesce(line("__lo", "__lo.p"), F.col("__lo.y")) if extrapolate else F.col("__lo.y")
    beyond_hi = F.coalesce(line("__hi", "__hi.q"), F.col("__hi.y")) if extrapolate else F.col("__hi.y")
    filled = F.when(F.col("__lo").isNull(), beyond_hi).when(F.col("__hi").isNull(), beyond_lo).otherwise(line("__lo", "__hi"))
    return marked.withColumn(out, F.coalesce(F.col(value), filled)).drop("__k", "__r", "__f", "__lo", "__hi")


@F.pandas_udf(StructType([StructField("s", DoubleType()), StructField("c", DoubleType())]))
def sine_cosine(degrees: pd.Series) -> pd.DataFrame:
    """Sine and cosine by the C library, null of null. The JVM's own differ in the last digit at 183 and 297 degrees (of whole ones), and
    where two directions cancel out that digit decides between 0 and 360."""
    turns = degrees.map(math.radians, na_action="ignore")
    return pd.DataFrame({"s": turns.map(math.sin, na_action="ignore"), "c": turns.map(math.cos, na_action="ignore")}, dtype="float64")


def interpolated_angle(rows: DataFrame, value: str, at: str, by: list[str], out: str) -> DataFrame:
    """Directions interpolated by their sines and cosines, ends held. One a rounding error below north is next to 360, not 0."""
    parts = rows.withColumn("__sc", sine_cosine(F.col(value).cast("double"))).withColumn("__s", F.col("__sc.s")).withColumn("__c", F.col("__sc.c")).drop("__sc")
    parts = interpolated(interpolated(parts, "__s", at, by, "__si"), "__c", at, by, "__ci")
    turn = F.degrees(F.atan2("__si", "__ci"))
    angle = F.coalesce(F.col(value), turn - 360 * F.floor(turn / 360))
    return parts.withColumn(out, angle).drop("__s", "__c", "__si", "__ci")


def runs(rows: DataFrame, flag: Column, by: list[str], at: str) -> DataFrame:
    """(by, start, end, n): inclusive runs of consecutive rows whose flag holds."""
    w = Window.partitionBy(*by).orderBy(at)
    numbered = rows.select(*by, F.col(at).alias("__at"), F.coalesce(flag, F.lit(False)).alias("__f"), F.row_number().over(w).alias("__i"))
    islands = numbered.where("__f").withColumn("__g", F.col("__i") - F.row_number().over(Window.partitionBy(*by).orderBy("__at")))
    return islands.groupBy(*by, "__g").agg(F.min("__at").alias("start"), F.max("__at").alias("end"), F.count("*").alias("n")).drop("__g")


def travelled(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """rows with step_m and travelled_m along the track. The first step of a line, like one with a missing end, is haversine() of null: half the
    earth's circumference, as least() passes over null in SQL too."""
    w = Window.partitionBy(*by).orderBy(at)
    step = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return rows.withColumn("step_m", F.coalesce(step, F.lit(0.0))).withColumn("travelled_m", F.sum("step_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))


#: nearest_by_distance() gives the numbers of a line in blocks of PLACES, and the blocks to tasks of about TASK_PLACES rows.
PLACES, TASK_PLACES = 512, 4_000_000


def nearest_by_distance(rows: DataFrame, by: list[str], at: str, spacing_m: float) -> DataFrame:
    """(by, k, at): for each k the row nearest to k * spacing metres along the track (ties: the later row).

    A row is nearest between the midpoints to its neighbours, so it names its own k; nothing is joined. Long steps give far more rows than they come
    from, so tasks are dealt by what they give. A task gives the same block of k for one line after the other: stored, these columns repeat and take about a
    twentieth of the bytes that one line's running numbers take.
    """
    w = Window.partitionBy(*by).orderBy(at)
    d = travelled(rows, by, at).select(*by, at, "travelled_m")
    lo = (F.lag("travelled_m").over(w) + F.col("travelled_m")) / 2
    hi = (F.lead("travelled_m").over(w) + F.col("travelled_m")) / 2
    first = F.coalesce(F.ceil(lo / spacing_m), F.lit(0))
    last = F.coalesce(F.ceil(hi / spacing_m) - 1, F.floor(F.col("travelled_m") / spacing_m))
    spans = written(d.select(*by, at, first.alias("__a"), last.alias("__b")).where("__a <= __b"), "spans")
    places, most = spans.agg(F.coalesce(F.sum(F.col("__b") - F.col("__a") + 1), F.lit(0)), F.coalesce(F.max("__b"), F.lit(0))).first()
    tasks = max(1, -(-places // TASK_PLACES))
    groups = -(-8 * tasks // (most // PLACES + 1))  # of lines: about eight pieces a task, each as many lines as that allows
    cut = spans.select("*", F.explode(F.sequence(F.floor(F.col("__a") / PLACES), F.floor(F.col("__b") / PLACES))).alias("__block"))
    dealt = cut.repartition(tasks, "__block", F.pmod(F.xxhash64(*by), F.lit(groups))).sortWithinPartitions("__block", *by, "__a")
    from_k, to_k = F.greatest("__a", F.col("__block") * PLACES), F.least("__b", F.col("__block") * PLACES + PLACES - 1)
    return dealt.select(*by, F.explode(F.sequence(from_k, to_k)).alias("k"), at)


def chunks(lengths: DataFrame, n: str, size: int = 2000, overlap: int = 200) -> DataFrame:
    """lengths with chunk, start, stop: windows of `size` rows that share `overlap`; the last one ends at n."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0)), F.lit(step))
    some = lengths.where(F.col(n) > 0).select("*", F.posexplode(starts).alias("chunk", "start"))
    some = some.where((F.col("start") == 0) | (F.col("start") - step + size < F.col(n)))
    return some.withColumn("stop", F.least(F.col("start") + size, F.col(n)))


def chunk_of(at: Column, size: int = 2000, overlap: int = 200) -> Column:
    """The numbers of the chunks that hold a row (before the last one is cut): two at most if the overlap is under half a chunk."""
    step = size - overlap
    return F.sequence(F.greatest(F.lit(0), F.ceil((at - size + 1) / step)), F.floor(at / step))


def speed_gate(rows: DataFrame, by: list[str], at: str, seconds: str, most_mps: float = 6.0, noise_m: float = 5.0, anywhere: bool = False) -> DataFrame:
    """(by, at, accepted): fixes that are missing, zero or out of range go (with `anywhere` only those that are missing); then, outwards
    from the fix nearest the median position (ties: the first), a fix stays if its distance to the last one that stayed is at most
    most_mps * time + noise_m.

    What stays depends on what stayed before, so the fixes of a line (one boat's track) meet in one call.
    """
    fine = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    if not anywhere:
        fine &= ~((F.col("lat") == 0) & (F.col("lon") == 0)) & (F.abs("lat") <= 90) & (F.abs("lon") <= 180)
    good = rows.where(fine).select(*by, F.col(at).alias("at"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col(seconds).cast("double").alias("t"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in good.select(*by, "at").schema.fields)

    def walk(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("at", kind="stable")
        places = np.radians(b[["lat", "lon"]].to_numpy())
        seconds = b["t"].to_numpy()
        middle = _middle(b[["lat", "lon"]].to_numpy())
        later = middle + _reached(places[middle:], seconds[middle:], most_mps, noise_m)
        earlier = middle - _reached(places[middle::-1], seconds[middle::-1], most_mps, noise_m)
        return b[[*by, "at"]].iloc[np.union1d(earlier, later)]

    stayed = good.groupBy(*by).applyInPandas(walk, kinds).withColumnRenamed("at", at).withColumn("accepted", F.lit(True))
    return rows.select(*by, at).join(stayed, [*by, at], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def _reached(places: np.ndarray, seconds: np.ndarray, most_mps: float, noise_m: float) -> np.ndarray:
    """Numbers of the fixes that a boat at the first one can have been at, each from the one reached before.

    The steps between neighbours are rated at once, and stretches without a step that is too long are taken whole. Behind such a step the next fix in
    reach is looked for in stretches that double.
    """

    def within(one: int, others: slice) -> np.ndarray:
        return _metres(*places[one], *places[others].T) <= most_mps * np.abs(seconds[others] - seconds[one]) + noise_m

    step = _metres(*places[:-1].T, *places[1:].T) <= most_mps * np.abs(np.diff(seconds)) + noise_m
    breaks = np.append(np.flatnonzero(~step), len(places) - 1)
    stretches, here = [], 0
    while here < len(places):
        stop = int(breaks[np.searchsorted(breaks, here)])
        stretches.append(np.arange(here, stop + 1))
        here, width = stop + 2, 8
        while here < len(places) and not (near := within(stop, slice(here, here + width))).any():
            here, width = here + width, 2 * width
        if here < len(places):
            here += int(near.argmax())
    return np.concatenate(stretches)


def _middle(degrees: np.ndarray) -> int:
    """The number of the fix nearest the median position, the first of those that are equally near.

    On a straight track two fixes often lie equally far to both sides, so those within a millimetre of the least distance are compared by the
    formula of haversine() in its own order of steps, which SQL has too: their last digits decide.
    """
    lat0, lon0 = np.median(degrees, axis=0).tolist()
    metres = _metres(np.radians(lat0), np.radians(lon0), *np.radians(degrees).T)
    near = np.flatnonzero(metres <= metres.min() + 1e-3).tolist()

    def exactly(i: int) -> float:
        lat, lon = degrees[i].tolist()
        a = math.pow(math.sin(math.radians(lat - lat0) / 2), 2) + math.cos(math.radians(lat0)) * math.cos(math.radians(lat)) * math.pow(math.sin(math.radians(lon - lon0) / 2), 2)
        return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(a)))

    return min(near, key=lambda i: (exactly(i), i))


def _metres(lat0: np.ndarray, lon0: np.ndarray, lat1: np.ndarray, lon1: np.ndarray) -> np.ndarray:
    """Great-circle distance of positions in radians."""
    h = np.sin((lat1 - lat0) / 2) ** 2 + np.cos(lat0) * np.cos(lat1) * np.sin((lon1 - lon0) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def points_of_ranges(ranges: DataFrame, points: DataFrame, by: list[str], at: str, bucket: int = 64) -> DataFrame:
    """ranges (by, start, end) with points: the `at` of the points of their line inside (both ends count), in order; where that is under
    two, the nearest point before and the nearest after are added.

    Points meet ranges by an equi-join on buckets of `bucket` numbers. The nearest ones come from a window over ranges and points in one
    order, so no point is searched for.
    """
    own = points.select(*by, F.col(at).cast("long").alias("at"), F.floor(F.col(at) / bucket).alias("bucket"))
    cut = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    met = cut.join(own, [*by, "bucket"]).where((F.col("at") >= F.col("start")) & (F.col("at") <= F.col("end")))
    inside = met.groupBy(*by, "start", "end").agg(F.array_sort(F.collect_list("at")).alias("points"))
    found = ranges.join(inside, [*by, "start", "end"], "left").withColumn("points", F.coalesce("points", F.array().cast("array<long>")))
    few = found.where(F.size("points") < 2)
    none = F.lit(None).cast("long")
    both = few.select(*by, "start", "end", "points", F.col("start").alias("x"), none.alias("at")).unionByName(own.select(*by, none.alias("start"), none.alias("end"), F.lit(None).cast("array<long>").alias("points"), F.col("at").alias("x"), "at"))
    w = Window.partitionBy(*by)
    before = F.max("at").over(w.orderBy("x").rangeBetween(Window.unboundedPreceding, -1))
    asked = both.withColumn("before", before).where("start is not null").drop("at").withColumn("x", F.col("end")).withColumn("at", none)
    again = asked.unionByName(own.select(*by, none.alias("start"), none.alias("end"), F.lit(None).cast("array<long>").alias("points"), F.col("at").alias("x"), none.alias("before"), "at"))
    after = F.min("at").over(w.orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, -1))
    near = again.withColumn("after", after).where("start is not null")
    wide = F.concat(F.array_compact(F.array("before")), "points", F.array_compact(F.array("after")))
    return found.where(F.size("points") >= 2).unionByName(near.select(*by, "start", "end", wide.alias("points")))


def decimated(rows: DataFrame, by: list[str], at: str, points: int = 100) -> DataFrame:
    """Every max(1, n // points)-th row of each group (a chunk of a line) in the order of `at`, from the first on."""
    w = Window.partitionBy(*by)
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / points))
    kept = rows.withColumn("__i", F.row_number().over(w.orderBy(at)) - 1).withColumn("__step", step)
    return kept.where(F.col("__i") % F.col("__step") == 0).drop("__i", "__step")


def savitzky_golay(rows: DataFrame, value: str, at: str, by: list[str], window: int, order: int) -> DataFrame:
    """(by, at, smooth): least-squares polynomials over a centred odd window; the first and last rows take the polynomial of the first
    and last whole window. A line shorter than the window uses the largest odd window that fits; below order + 1 rows it stays.

    A line's rows meet in one call: the ends need the first and last window whole.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(at, kind="stable")
        y = batch[value].to_numpy(dtype=np.float64)
        w = min(window, len(y) - (len(y) + 1) % 2)
        if w > order:
            half, x = w // 2, np.arange(w) - w // 2
            fit = np.linalg.pinv(np.vander(x, order + 1, increasing=True))
            out = np.convolve(y, fit[0][::-1], mode="valid")
            ends = lambda part, xs: np.vander(xs, order + 1, increasing=True) @ (fit @ part)
            y = np.concatenate([ends(y[:w], x[:half]), out, ends(y[-w:], x[half + 1 :])])
        return batch[[*by, at]].assign(smooth=y)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by, at).schema.fields)
    return rows.select(*by, at, value).groupBy(*by).applyInPandas(run, f"{kinds}, smooth double")
