"""Helpers that several training-data operators use: batches, checksums, skew-proof numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows of an Arrow batch that carries texts: a batch, not a row count, has to fit into a Python worker beside its results.
TEXT_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches at TEXT_ROWS rows, if they are larger.

    Spark has no bound on a batch's bytes, and reads this setting when a result is asked for, after the operator has returned its plan: so it
    stays set for the session. A lower value of the caller's stays as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def crc32(column: Column) -> Column:
    """Unsigned CRC32 of a string's UTF-8 bytes (null: null)."""
    return F.crc32(column.cast("binary"))


def free(df: DataFrame) -> str:
    """A prefix that no column of df has, whatever its case: own columns beside a caller's take names that start with it."""
    out = "__"
    while any(c.lower().startswith(out) for c in df.columns):
        out += "_"
    return out


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, bins: Column) -> DataFrame:
    """df with a gapless number from 0 in each group, of rows ordered by bin and then `order`.

    bins: some hundreds of values of a hash. Each bin is numbered by itself and starts where the counts of the bins before it end, so a
    group that holds a third of all rows is still sorted by hundreds of tasks. Rows that tie in all of `order` are interchangeable.
    """
    own = free(df)
    binned = df.withColumn(f"{own}bin", bins)
    counts = binned.groupBy(*group, f"{own}bin").agg(F.count("*").alias(f"{own}n"))
    before = Window.partitionBy(*group).orderBy(f"{own}bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"{own}g{i}") for i, g in enumerate(group)], F.col(f"{own}bin").alias(f"{own}b"), F.coalesce(F.sum(f"{own}n").over(before), F.lit(0)).alias(f"{own}start"))
    same = F.col(f"{own}bin") == F.col(f"{own}b")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"{own}g{i}"))
    inside = Window.partitionBy(*group, f"{own}bin").orderBy(*order)
    out = binned.join(starts, same).withColumn(name, (F.col(f"{own}start") + F.row_number().over(inside) - 1).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], name)
