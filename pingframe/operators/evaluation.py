"""Evaluation of scored detections: calibration, ranking, matching, splits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush, heapreplace
from itertools import product, zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pingframe.operators.graph import connected
from pingframe.operators.ranking import placed
from pingframe.operators.series import interpolated
from pingframe.plans.tables import written


def calibration_bins(rows: DataFrame, by: list[str], score: str, label: str, bins: int = 10) -> DataFrame:
    """(by, bin, n, mean_score, mean_label) of equal-width bins; a score of 1 is in the last."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")
    return rows.groupBy(*by, b).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("mean_label"))


def calibration_error(rows: DataFrame, by: list[str], score: str, label: str, bins: int = 10) -> DataFrame:
    """(by, ece): the mean over rows of |mean label - mean score| of their bin."""
    per = calibration_bins(rows, by, score, label, bins)
    gap = F.abs(F.col("mean_label") - F.col("mean_score")) * F.col("n")
    return per.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def auroc(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """(by, auroc): the share of (positive, negative) pairs in order, ties half; null with one label only.

    Scores are counted first, so windows see distinct scores and not rows; those of a group are walked in bins of the score, each of which starts where the
    counts below it end.
    """
    per = rows.groupBy(*by, score).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("n")).withColumn("__bin", F.floor(F.col(score) * BINS))
    totals = per.groupBy(*by, "__bin").agg(F.sum("n").alias("__n"))
    under = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"__of_{c}") for c in [*by, "__bin"]], F.coalesce(F.sum("__n").over(under), F.lit(0)).alias("__start"))
    same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"__of_{c}")), [*by, "__bin"], F.lit(True))
    inside = Window.partitionBy(*by, "__bin").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.col("p") * (F.col("__start") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("n") / 2)
    return per.join(starts, same).withColumn("pairs", pairs).groupBy(*by).agg(F.try_divide(F.sum("pairs"), F.sum("p") * F.sum("n")).alias("auroc"))


#: Ranks are made in so many bins of the score; a group's bins are ranked by themselves and start where the counts above them end.
BINS = 1024


def _ranked(rows: DataFrame, by: list[str], score: str, label: str, tie: str) -> DataFrame:
    """(by, bin, y, k, hits, truths): k is the rank by falling score (ties by `tie`), hits the positives up to there, truths those of all.

    The counts of a group's bins, BINS rows for scores of 0 to 1, give each bin its first rank; so a group is ranked by many tasks.
    """
    slim = rows.select(*by, F.col(score).alias("s"), F.col(label).alias("y"), F.col(tie).alias("t"), F.floor(F.col(score) * BINS).alias("bin"))
    per = slim.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum("y").alias("h"))
    group = Window.partitionBy(*by)
    above = group.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(c).alias(f"of_{c}") for c in [*by, "bin"]]
    starts = per.select(*named, F.coalesce(F.sum("n").over(above), F.lit(0)).alias("k0"), F.coalesce(F.sum("h").over(above), F.lit(0)).alias("h0"), F.sum("h").over(group).alias("truths"))
    same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"of_{c}")), [*by, "bin"], F.lit(True))
    w = Window.partitionBy(*by, "bin").orderBy(F.desc("s"), "t")
    hits = F.col("h0") + F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return slim.join(starts, same).select(*by, "bin", "y", (F.col("k0") + F.row_number().over(w)).alias("k"), hits.alias("hits"), "truths")


def average_precision(rows: DataFrame, by: list[str], score: str, label: str, tie: str) -> DataFrame:
    """(by, ap): mean over positives of the precision at their rank, not interpolated; null without positives."""
    at = F.sum(F.when(F.col("y") == 1, F.col("hits") / F.col("k")))
    return _ranked(rows, by, score, label, tie).groupBy(*by).agg(F.try_divide(at, F.sum("y").cast("double")).alias("ap"))


def average_precision_101(rows: DataFrame, by: list[str], score: str, label: str, tie: str, truths: str | None = None) -> DataFrame:
    """(by, ap): mean over recalls 0, 0.01 .. 1 of the best precision at that recall or more.

    truths: a column of `by` groups' numbers of positives (default: those among the rows). A hit of rank k gives the precision envelope
    over the recall points up to its own, which it counts by arithmetic; no grid is joined. The envelope comes from a bin's own hits and
    the best of the bins below it.
    """
    given = rows if truths is None else rows.withColumn("__truths", F.col(truths))
    keys = by if truths is None else [*by, "__truths"]
    ranked = _ranked(given, keys, score, label, tie).withColumn("precision", F.col("hits") / F.col("k")).where("y = 1")
    if truths is not None:
        ranked = ranked.withColumn("truths", F.col("__truths"))
    tops = ranked.groupBy(*keys, "bin").agg(F.max("precision").alias("top"))
    later = F.max("top").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(*[F.col(c).alias(f"of_{c}") for c in [*keys, "bin"]], later.alias("later"))
    same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"of_{c}")), [*keys, "bin"], F.lit(True))
    own = F.max("precision").over(Window.partitionBy(*keys, "bin").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
    hit = ranked.join(tops, same).withColumn("best", F.greatest(own, "later"))
    points = lambda h: F.floor(h * 100 / F.col("truths") + F.lit(1e-9)) + 1
    share = F.when(F.col("hits") == 1, points(F.col("hits"))).otherwise(points(F.col("hits")) - points(F.col("hits") - 1))
    return hit.groupBy(*by).agg((F.sum(F.col("best") * share) / 101).alias("ap"))


#: Isotonic fits pool the violators of so many neighbouring rows by themselves, and then the blocks that are left.
RANGE = 100_000


def _pooled(sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first index, sum, count) of the blocks that stay when neighbours whose means do not rise are pooled, on a stack."""
    at: list[int] = []
    s: list[float] = []
    c: list[int] = []
    for i, (x, n) in enumerate(zip(sums.tolist(), counts.tolist(), strict=True)):
        first = i
        while s and s[-1] * n >= x * c[-1]:
            x, n, first = x + s.pop(), n + c.pop(), at.pop()
        at.append(first)
        s.append(x)
        c.append(n)
    return np.array(at, dtype=np.int64), np.array(s), np.array(c, dtype=np.int64)


def isotonic(rows: DataFrame, by: list[str], x: str, y: str, tie: str, size: int | None = None) -> DataFrame:
    """(by, x, y, tie, fitted): the rising step function nearest to y in squares, by pooling adjacent violators in the order of x.

    Ties in x stay apart, in the order of `tie`. Ranges of RANGE rows in order are pooled by themselves; then a group's blocks, which
    are far fewer than its rows, are pooled once more, and each range takes the blocks that reach into it.
    """
    size = size or RANGE
    slim = rows.select(*by, x, y, tie)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields)
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.select(*by).schema.fields)
    ordered = placed(slim, [*map(F.col, by), F.col(x), F.col(tie)], "place").withColumn("part", F.floor((F.col("place") - 1) / size))

    def inside(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("place")
        at, s, c = _pooled(b[y].to_numpy(dtype=np.float64), np.ones(len(b), dtype=np.int64))
        return b[by].iloc[at].assign(start=b["place"].to_numpy()[at], s=s, c=c)

    def between(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("start")
        at, s, c = _pooled(b["s"].to_numpy(), b["c"].to_numpy())
        start = b["start"].to_numpy()[at]
        return b[by].iloc[at].assign(start=start, stop=start + c - 1, fitted=s / c)

    def fitted(b: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("start")
        of = np.searchsorted(blocks["start"].to_numpy(), b["place"].to_numpy(), side="right") - 1
        return b.assign(fitted=blocks["fitted"].to_numpy()[of])[[*by, x, y, tie, "fitted"]]

    parts = ordered.groupBy(*by, "part").applyInPandas(inside, f"{keys}, start long, s double, c long")
    whole = parts.groupBy(*by).applyInPandas(between, f"{keys}, start long, stop long, fitted double")
    reach = whole.withColumn("part", F.explode(F.sequence(F.floor((F.col("start") - 1) / size), F.floor((F.col("stop") - 1) / size))))
    return ordered.groupBy(*by, "part").cogroup(reach.groupBy(*by, "part")).applyInPandas(fitted, f"{kinds}, fitted double")


def out_of_fold(rows: DataFrame, fold: str, folds: int, x: str, y: str, tie: str) -> DataFrame:
    """rows with `calibrated`: the isotonic fit of all other folds' rows at x, linear between fitted points and held at the ends."""
    numbers = F.array(*map(F.lit, range(folds)))
    train = rows.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.col(tie).alias("t"), F.explode(F.filter(numbers, lambda k: k != F.col(fold))).alias("f"))
    points = isotonic(train, ["f"], "x", "y", "t").groupBy("f", "x").agg(F.avg("fitted").alias("v"))
    asked = rows.select(F.col(fold).alias("f"), F.col(x).alias("x")).distinct().join(points, ["f", "x"], "left_anti").withColumn("v", F.lit(None).cast("double"))
    line = interpolated(points.unionByName(asked), "v", "x", ["f"], "calibrated").select(F.col("f").alias("__f"), F.col("x").alias("__x"), "calibrated")
    return rows.join(line, (F.col(fold) == F.col("__f")) & (F.col(x) == F.col("__x")), "left").drop("__f", "__x")


def looked_up(value: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through the breakpoints, held at the ends and in [0, 1]; without breakpoints the value itself."""
    if not xs:
        return value
    out = F.when(value <= xs[0], F.lit(float(ys[0])))
    for x0, y0, x1, y1 in zip(xs, ys, xs[1:], ys[1:], strict=False):
        out = out.when(value <= x1, y0 + (y1 - y0) * (value - x0) / (x1 - x0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out.otherwise(F.lit(float(ys[-1])))))


def best_weights(rows: DataFrame, parts: list[str], label: str, tie: str, step: int = 20, base: tuple[float, ...] = (0.5, 0.3, 0.2)) -> DataFrame:
    """(w0, w1, w2, ap): the weights on a grid of 1/step that maximise average precision; ties go to the one nearest base.

    Each row meets every weight vector of the grid, which is fixed and small, and the vectors are ranked side by side.
    """
    grid = [(a, b, step - a - b) for a in range(step + 1) for b in range(step + 1 - a)]
    tried = rows.withColumn("w", F.explode(F.array(*[F.struct(*[F.lit(v / step).alias(f"w{i}") for i, v in enumerate(g)]) for g in grid])))
    score = sum((F.col(p) * F.col(f"w.w{i}") for i, p in enumerate(parts)), F.lit(0.0))
    scored = tried.select(label, tie, F.round(score, 9).alias("s"), "w.w0", "w.w1", "w.w2")
    ap = average_precision(scored, ["w0", "w1", "w2"], "s", label, tie)
    off = sum(((F.col(f"w{i}") - b) * (F.col(f"w{i}") - b) for i, b in enumerate(base)), F.lit(0.0))
    return ap.orderBy(F.round("ap", 9).desc(), F.round(off, 9), "w0", "w1").limit(1)


def greedy_matches(pairs: DataFrame, by: list[str], left: str, right: str, order: list[str], gain: str | None, falling: bool = True) -> DataFrame:
    """(by, left, right[, gain]): one-to-one matches; left items in `order` (its first column falling or not) each take the free right item
    of the largest gain, ties the later one; without a gain the first one.

    Only items that pairs connect can bar each other, so the components of the pairs are dealt to tasks, and a task walks its pairs in
    order with the items taken so far. Items are numbers.
    """
    links = pairs.select((F.col(left) * 2).alias("a"), (F.col(right) * 2 + 1).alias("b"))
    roots = connected(links).withColumnRenamed("node", "__node")
    ranked = [F.desc(order[0]) if falling else F.asc(order[0]), *map(F.asc, order[1:]), F.asc(left), *([F.desc(gain), F.desc(right)] if gain else [F.asc(right)])]
    kept = list(dict.fromkeys([*by, left, right, *([gain] if gain else [])]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lefts: set = set()
        rights: set = set()
        for b in batches:
            take = []
            for i, (a, c) in enumerate(zip(b[left].tolist(), b[right].tolist(), strict=True)):
                if a not in lefts and c not in rights:
                    lefts.add(a)
                    rights.add(c)
                    take.append(i)
            yield b.iloc[take]

    slim = pairs.select(*dict.fromkeys([*kept, *order]))
    rooted = slim.join(roots, F.col(left) * 2 == F.col("__node")).repartition("root").sortWithinPartitions(*ranked).select(*kept)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rooted.schema.fields)
    return rooted.mapInPandas(run, kinds)


def poisson_weight(unit: Column, replicate: Column) -> Column:
    """A count that is Poisson(1), read from an MD5 of unit and replicate."""
    u = F.conv(F.substring(F.md5(F.concat(unit.cast("string"), F.lit(":"), replicate.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return sum(((u >= s).cast("int") for s in POISSON), F.lit(0))


#: The cumulative Poisson(1) probabilities of 0 to 5.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


def bootstrap_calibration(rows: DataFrame, unit: str, score: str, label: str, replicates: int = 200, bins: int = 10) -> DataFrame:
    """(low, middle, high): 2.5, 50 and 97.5 percentiles of the calibration error over resampled units.

    A unit's count in a replicate is Poisson(1), read from a hash of both: sums per unit and bin weigh themselves in all replicates, so
    rows are not copied, and reruns agree.
    """
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")
    per = rows.groupBy(F.col(unit).alias("unit"), b).agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.sum(F.col(label).cast("double")).alias("y"))
    drawn = per.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", poisson_weight(F.col("unit"), F.col("r"))).where("w > 0")
    cells = drawn.groupBy("r", "bin").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("n", "s", "y")])
    errors = cells.groupBy("r").agg((F.sum(F.abs(F.col("y") - F.col("s"))) / F.sum("n")).alias("e"))
    return errors.agg(*[F.percentile("e", F.lit(p)).alias(n) for n, p in (("low", 0.025), ("middle", 0.5), ("high", 0.975))])


def position_errors(rows: DataFrame, by: list[str], metres: Column, sigma_m: Column) -> DataFrame:
    """(by, n, matched, median_error, max_error, within): errors of the matched rows (metres not null), and the share within two sigma."""
    off = rows.select(*by, metres.alias("m"), sigma_m.alias("s"))
    inside = F.avg(F.when(F.col("m").isNotNull(), (F.col("m") <= 2 * F.col("s")).cast("double")))
    return off.groupBy(*by).agg(F.count("*").alias("n"), F.count("m").alias("matched"), F.median("m").alias("median_error"), F.max("m").alias("max_error"), inside.alias("within"))


def per_class(predictions: DataFrame, truths: DataFrame, least: float = 0.25) -> DataFrame:
    """(cls, n_truth, ap, precision, recall) of predictions (cls, id, score, hit: 1 where matched) against truths (cls, a row each).

    ap is taken over all predictions, 0 without any; precision and recall over those of at least `least`. A class of predictions only
    has no ap and no recall.
    """
    n = truths.groupBy("cls").agg(F.count("*").alias("n_truth"))
    known = predictions.join(n, "cls")
    ap = average_precision_101(known, ["cls"], "score", "hit", "id", "n_truth")
    sure = F.col("score") >= least
    counts = predictions.groupBy("cls").agg(F.count_if(sure).alias("kept"), F.count_if(sure & (F.col("hit") == 1)).alias("hits"))
    both = counts.join(n, "cls", "full").join(ap, "cls", "left")
    truth = F.coalesce("n_truth", F.lit(0))
    return both.select("cls", truth.alias("n_truth"), F.when(truth > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"), F.try_divide("hits", "kept").alias("precision"), F.try_divide(F.coalesce("hits", F.lit(0)), "n_truth").alias("recall"))


#: Bins of the score that a bootstrap walks, each for all replicates in one call.
WALKED = 64


def bootstrap_map(predictions: DataFrame, truths: DataFrame, unit: str, replicates: int = 100) -> DataFrame:
    """(low, middle, high): 2.5, 50 and 97.5 percentiles of the mean average precision over classes, of resampled units (images).

    A unit counts Poisson(1) times in a replicate; its predictions and truths count as often. No row is copied: a class's predictions are ranked in
    bins of the score, counts of units per bin give each replicate's first rank and hits of a bin, and a task walks a bin once for all replicates.
    """
    slim = predictions.select("cls", F.floor(F.col("score") * WALKED).alias("bin"), F.col(unit).alias("u"), F.col("score").cast("double").alias("s"), "id", F.col("hit").cast("long").alias("y"))
    slim = written(slim, "predictions")
    units = truths.select(F.col(unit).alias("u")).union(slim.select("u")).distinct()
    weights = units.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", poisson_weight(F.col("u"), F.col("r")))
    counted = weights.where("w > 0")
    n = truths.groupBy("cls", F.col(unit).alias("u")).agg(F.count("*").alias("n")).join(counted, "u").groupBy("r", "cls").agg(F.sum(F.col("n") * F.col("w")).alias("n_truth"))
    per = slim.groupBy("cls", "bin", "u").agg(F.count("*").alias("n"), F.sum("y").alias("h")).join(counted, "u").groupBy("cls", "bin", "r").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("n", "h")])
    above = Window.partitionBy("cls", "r").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("cls", "bin", "r", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}0") for c in ("n", "h")]).join(n, ["r", "cls"])
    starts = starts.groupBy("cls", "bin").agg(F.array_sort(F.collect_list(F.struct("r", "n0", "h0", "n_truth"))).alias("of"))
    own = slim.groupBy("cls", "bin", "u").agg(F.count("*")).select("cls", "bin", "u").join(weights.groupBy("u").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("weights")), "u")
    own = own.groupBy("cls", "bin").agg(F.collect_list(F.struct("u", "weights")).alias("units")).join(starts, ["cls", "bin"]).toDF("of_cls", "of_bin", "units", "of")

    def walked(rows: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or about.empty:
            return pd.DataFrame({"cls": [], "bin": [], "r": [], "top": [], "best": [], "share": []})
        rows = rows.sort_values(["s", "id"], ascending=[False, True], kind="stable")
        kinds = pd.Index([x["u"] for x in about["units"].iloc[0]])
        times = np.array([list(x["weights"]) for x in about["units"].iloc[0]], dtype=np.int64)[kinds.get_indexer(rows["u"])]
        y = rows["y"].to_numpy()
        out = []
        for x in about["of"].iloc[0]:
            w = times[:, x["r"] - 1]
            hits = x["h0"] + np.cumsum(w * y)
            met = (w > 0) & (y == 1)
            if met.any():
                best = np.maximum.accumulate((hits[met] / (x["n0"] + np.cumsum(w))[met])[::-1])[::-1]
                after = hits[met]
                points = np.where(after > 0, np.floor(after * 100 / x["n_truth"] + 1e-9) + 1, 0)
                before = np.append(x["h0"], after[:-1])
                share = points - np.where(before > 0, np.floor(before * 100 / x["n_truth"] + 1e-9) + 1, 0)
                some = np.flatnonzero(share > 0)
                out += [(x["r"], best[0], best[k], share[k]) for k in some] or [(x["r"], best[0], 0.0, 0.0)]
        return pd.DataFrame(out, columns=["r", "top", "best", "share"]).assign(cls=rows["cls"].iloc[0], bin=rows["bin"].iloc[0])[["cls", "bin", "r", "top", "best", "share"]]

    steps = slim.groupBy("cls", "bin").cogroup(own.groupBy("of_cls", "of_bin")).applyInPandas(walked, "cls string, bin long, r int, top double, best double, share double")
    later = Window.partitionBy("cls", "r").orderBy("bin").rangeBetween(Window.unboundedPreceding, -1)
    ap = steps.withColumn("later", F.max("top").over(later)).groupBy("r", "cls").agg((F.sum(F.greatest("best", "later") * F.col("share")) / 101).alias("ap"))
    means = n.join(ap, ["r", "cls"], "left").groupBy("r").agg(F.avg(F.coalesce("ap", F.lit(0.0))).alias("m"))
    return means.agg(*[F.percentile("m", F.lit(p)).alias(k) for k, p in (("low", 0.025), ("middle", 0.5), ("high", 0.975))])


#: Whole sites are assigned by trying all ways up to so many sites, and greedily beyond; a table of more sites than MOST_SITES is refused.
TRIED_SITES, MOST_SITES = 9, 100_000


def splits(sites: list[tuple[str, int]], shares: dict[str, float], positives: dict[str, int] | None = None, not_train: frozenset[str] = frozenset()) -> dict[str, str]:
    """Whole sites to splits, so that the squared deviation from the shares is least; no split stays empty.

    Up to TRIED_SITES sites all ways are tried, and one more is added to the deviation for val and test each where no site has a positive.
    With more, the largest sites open the splits in turn, and each further one goes where the shortfall is largest (ties: first
    named). Sites in not_train never go to train.
    """
    order = sorted(sites, key=lambda s: (-s[1], s[0]))
    names, total = list(shares), sum(n for _, n in order) or 1
    allowed = [[k for k in names if k != "train" or s not in not_train] for s, _ in order]
    if len(order) > TRIED_SITES:
        return _by_shortfall(order, shares, allowed)
    best: tuple[float, tuple[str, ...]] | None = None
    for way in product(*allowed):
        held, found = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
        for (site, n), k in zip(order, way, strict=True):
            held[k] += n
            found[k] += (positives or {}).get(site, 0)
        if all(held.values()):
            cost = sum((held[k] / total - shares[k]) ** 2 for k in names)
            cost += sum(positives is not None and found[k] == 0 for k in ("val", "test") if k in found)
            if best is None or cost < best[0] - 1e-12:
                best = cost, way
    if best is None:
        raise ValueError(f"{len(order)} sites do not fill {len(names)} splits")
    return dict(zip([s for s, _ in order], best[1], strict=True))


def _by_shortfall(order: list[tuple[str, int]], shares: dict[str, float], allowed: list[list[str]]) -> dict[str, str]:
    """Sites, largest first, to splits: as many as there are splits open these in turn, then a heap gives the one that lacks most.

    An entry of the heap is (held less share, place of the split, held); entries that a site may not take are put back.
    """
    names, total = list(shares), sum(n for _, n in order) or 1
    heap = [(-share, i, 0) for i, share in enumerate(shares.values())]
    heapify(heap)
    out = {}
    for (site, n), may, opened in zip_longest(order, allowed, names[: len(order)]):
        wanted = {opened} & set(may) or set(may)
        aside = []
        while names[heap[0][1]] not in wanted:
            aside.append(heappop(heap))
        _, i, held = heap[0]
        heapreplace(heap, ((held + n) / total - shares[names[i]], i, held + n))
        for entry in aside:
            heappush(heap, entry)
        out[site] = names[i]
    return out


def site_splits(items: DataFrame, site: str, shares: dict[str, float], positive: Column | None = None) -> DataFrame:
    """(site, n, split) of each site of items; sites that are null have no split. Over MOST_SITES sites are refused."""
    counts = items.groupBy(F.col(site).alias("site")).agg(F.count("*").alias("n"), F.count_if(positive if positive is not None else F.lit(False)).alias("positives"))
    rows = counts.where("site is not null").limit(MOST_SITES + 1).collect()
    if len(rows) > MOST_SITES:
        raise ValueError(f"over {MOST_SITES} sites")
    given = splits([(r["site"], r["n"]) for r in rows], shares, {r["site"]: r["positives"] for r in rows} if positive is not None else None) if rows else {}
    named = items.sparkSession.createDataFrame(list(given.items()), "site string, split string")
    return counts.select("site", "n").join(F.broadcast(named), "site", "left")
