"""Places in a whole order, and exact percentiles, without one task that sees all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pingframe.plans.tables import written


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with a gapless number from 1 in `order`, which must decide between any two rows.

    The rows are sorted by ranges and stored with the number of their range and their place in it; a range starts where the counts of
    the ranges before it end, and these counts are one row a range.
    """
    cut = rows.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    stored = written(cut, "placed")
    counts = stored.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__p", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__start"))
    return stored.join(starts, "__p").withColumn(name, F.col("__start") + F.col("__i")).select(*rows.columns, name)


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], near: float = 1e-3) -> DataFrame:
    """One row with the exact (linear) percentile of `value` for each name of shares; nulls where there are no values.

    Each is narrowed first: two approximate quantiles hold it between them, and only values in that band, 4 * near of all, are sorted.
    """
    known = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    n = known.count()
    out = None
    for name, share in shares.items():
        if not n:
            one = known.agg(F.max("v").alias(name))
        else:
            low, high = known.approxQuantile("v", [max(0.0, share - 2 * near), min(1.0, share + 2 * near)], near)
            band = known.where((F.col("v") >= low) & (F.col("v") <= high))
            below, inside = known.where(F.col("v") < low).count(), band.count()
            at = (share * (n - 1) - below) / max(1, inside - 1)
            one = band.agg(F.percentile("v", F.lit(min(1.0, max(0.0, at)))).alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out


def group_percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], near: float = 1e-3) -> DataFrame:
    """(by, name ..): the exact (linear) percentiles of `value` in each group; groups without values are absent.

    Two approximate quantiles of a group hold each percentile between them, and only the values in that band, 4 * near of the group, and the ones next to it are looked at: so no task
    orders all values of a group that holds most rows.
    """
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    names = [F.col(c).alias(f"__of_{c}") for c in by]
    same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"__of_{c}")), by, F.lit(True))
    out = None
    for name, share in shares.items():
        ends = F.percentile_approx("__v", F.array(F.lit(max(0.0, share - 2 * near)), F.lit(min(1.0, share + 2 * near))), F.lit(round(1 / near)))
        bounds = known.groupBy(*by).agg(F.count("*").alias("__n"), ends.alias("__e")).select(*names, "__n", F.get("__e", F.lit(0)).alias("__low"), F.get("__e", F.lit(1)).alias("__high"))
        both = known.join(bounds, same)
        under, over = F.col("__v") < F.col("__low"), F.col("__v") > F.col("__high")
        near_ones = F.max(F.when(under, F.col("__v"))).alias("__prev"), F.min(F.when(over, F.col("__v"))).alias("__next")
        below = both.groupBy(*by).agg(F.first("__n").alias("__n"), F.count_if(under).alias("__below"), *near_ones).select(*names, "__n", "__below", "__prev", "__next")
        place = F.row_number().over(Window.partitionBy(*by).orderBy("__v")) - 1
        band = both.where(~under & ~over).select(*by, "__v", place.alias("__k"))
        at = share * (F.col("__n") - 1) - F.col("__below")
        step = F.floor(at + F.lit(1e-12))
        found = band.join(below, same).groupBy(*by).agg(
            F.coalesce(F.max(F.when(F.col("__k") <= step, F.col("__v"))), F.first("__prev")).alias("__a"),
            F.coalesce(F.min(F.when(F.col("__k") > step, F.col("__v"))), F.first("__next")).alias("__b"), F.first(at - step).alias("__f"),
        )
        one = found.select(*by, (F.col("__a") + (F.coalesce("__b", "__a") - F.col("__a")) * F.greatest(F.col("__f"), F.lit(0.0))).alias(name))
        out = one if out is None else out.join(one.select(*names, name), same).drop(*[f"__of_{c}" for c in by])
    return out
