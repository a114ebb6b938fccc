"""Line dedup: repeated windows of three consecutive lines, found globally; later occurrences go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingframe.llm._shared import free
from pingframe.plans.tables import written

WINDOW = 3
#: Windows that occur more often than this are broadcast, so that their occurrences meet no shuffle; at most so many of them, of 60 bytes.
HOT, MOST_HOT = 1_000, 100_000


def repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, gone): the line numbers (from 0) that each document loses; documents that lose none are absent.

    A document is a doc_id and a text (th: the text's hash); rows equal in both are one. Windows are compared by two 64-bit hashes of
    their lines. The first occurrence is the one of the smallest doc_id (nulls last), then th, then line; every other one is later.
    The occurrences of a common window stay where they are and get its first one by broadcast; others meet it by a shuffle.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= window)
    hashes = F.transform(F.sequence(F.lit(0), F.size("lines") - window), lambda i: F.struct(
        F.xxhash64(*[F.get("lines", i + k) for k in range(window)]).alias("h1"),
        F.xxhash64(F.lit("second"), *[F.get("lines", i + k) for k in range(window)]).alias("h2")))
    seen = rows.select("doc_id", "th", F.posexplode(hashes).alias("at", "h")).select("doc_id", "th", "at", "h.h1", "h.h2")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "at")
    firsts = written(seen.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"), "firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > max(HOT, total // MOST_HOT)  # so at most MOST_HOT windows
    hot, cold = (firsts.where(x).select("h1", "h2", "first") for x in (often, ~often))
    met = seen.join(F.broadcast(hot), ["h1", "h2"]).unionByName(seen.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"]))
    later = met.where(~place.eqNullSafe(F.col("first")))
    covered = F.flatten(F.transform(F.collect_set("at"), lambda i: F.sequence(i, i + (window - 1))))
    return later.groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(covered)).alias("gone"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of docs, with text less its repeated lines, and n_lines, n_removed.

    Texts of fewer lines than a window have none and stay whole; a null text stays null with no lines; repeated rows all stay. Columns of docs
    named like the two results stay beside them.
    """
    p = free(docs)
    gone = repeated_lines(docs, window).select(F.col("doc_id").alias(f"{p}id"), F.col("th").alias(f"{p}th"), F.col("gone").alias(f"{p}gone"))
    marked = docs.withColumn(f"{p}hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    both = marked.join(gone, F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}hash") == F.col(f"{p}th")), "left")
    both = both.withColumn(f"{p}lines", F.split("text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size(f"{p}lines") - 1), F.col(f"{p}gone"))
    text = F.when(F.col(f"{p}gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(f"{p}lines", i)), "\n"))
    others = [F.col(f"`{c}`") if c != "text" else text.alias("text") for c in docs.columns]
    n = F.coalesce(F.size(f"{p}lines"), F.lit(0))
    return both.select(*others, F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.coalesce(F.size(f"{p}gone"), F.lit(0)).cast("long").alias("n_removed"))


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_lines, n_removed, clean_chars, clean_md5) of each row of docs; null texts have no characters and the md5 of none."""
    clean = without_repeats(docs.select("doc_id", "text"), window)
    text = F.coalesce("text", F.lit(""))
    return clean.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("clean_chars"), F.md5(text.cast("binary")).alias("clean_md5"))


#: DuckDB SQL of digest().
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT DISTINCT doc_id, t, lines FROM d),
w AS (SELECT doc_id, t, i, lines[i:i+2] AS win FROM u, unnest(range(1, len(lines) - 1)) AS x(i) WHERE len(lines) >= 3),
r AS (SELECT doc_id, t, i, win, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, md5(t), i) AS n FROM w),
g AS (SELECT doc_id, t, list_distinct(flatten(list([i, i+1, i+2]))) AS gone FROM r WHERE n > 1 GROUP BY doc_id, t),
c AS (SELECT d.doc_id, d.t, d.lines, g.gone, array_to_string(list_transform(list_filter(range(1, len(d.lines) + 1), lambda i: NOT list_contains(g.gone, i)), lambda i: d.lines[i]), chr(10)) AS kept
  FROM d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.t = g.t)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  CAST(length(CASE WHEN gone IS NULL THEN t ELSE kept END) AS BIGINT) AS clean_chars, md5(CASE WHEN gone IS NULL THEN t ELSE kept END) AS clean_md5 FROM c
"""
