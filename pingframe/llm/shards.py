"""Sharding by rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingframe.llm._shared import crc32, numbered
from pingframe.plans.tables import written

SPAN = float(2**52)


def _values(key: Column, weights: list[float], start: int = 0) -> list[Column]:
    """A struct (value, minus shard) for each shard of a positive weight: value is -weight / ln(u), u in (0, 1) a hash of key and shard."""
    name = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    out = []
    for n, w in enumerate(weights, start):
        if w:
            u = (F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{n}")).cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(SPAN)
            out.append(F.struct((F.lit(float(-w)) / F.log(u)).alias("value"), F.lit(-n).alias("shard")))
    return out


def _best(key: Column, weights: list[float]) -> Column:
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must not be negative, and one must be positive")
    rated = _values(key, weights)
    return F.array_max(F.array(*rated)) if len(rated) > 1 else rated[0]


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard with the largest -weight / ln(u), where u in (0, 1) is a hash of key and shard number.

    Each shard's value depends on key and that shard alone. So one more shard at the end takes rows only into itself, and a changed
    weight moves rows only from or to that shard. A null key is a key of its own. Equal values go to the smaller shard.
    """
    return (-_best(key, weights)["shard"]).cast("int")


def sharded(docs: DataFrame, shards: int = 24, weights: list[float] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs.

    The law is `key`: doc_id and the shard count decide. size: UTF-8 bytes of the text (null: none) plus 8; text_crc32 of a null text is
    that of the empty one. slot: gapless from 0 in each shard, in an order of hashes that reruns keep; rows equal in doc_id, size and
    CRC are interchangeable, and texts that share one doc_id are numbered in many bins. grown_shard: the shard with one more shard of the mean weight. Rows with the same or a null doc_id share a
    shard. Each shard's hash is taken once a row; the rows without their texts are stored and then numbered.
    """
    weights = weights or [1.0] * shards
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    best, more = _best(F.col("doc_id"), weights), _values(F.col("doc_id"), [sum(weights) / len(weights)], len(weights))[0]
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), crc32(text).alias("text_crc32"), best.alias("best"), more.alias("more"))
    grown = F.when(F.col("more") > F.col("best"), -F.col("more.shard")).otherwise(-F.col("best.shard"))
    rows = written(rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), (-F.col("best.shard")).cast("int").alias("shard"), grown.cast("int").alias("grown_shard")), "dealt")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    bins = F.substring(F.md5(F.concat_ws(":", F.lit("slot"), key, "text_crc32", "size").cast("binary")), 1, 3)
    out = numbered(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot", bins)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def dealt(docs: DataFrame, path: str, shards: int = 24, weights: list[float] | None = None) -> None:
    """Write docs to path, a folder shard=n for each shard; a row's other columns stay as they are."""
    placed = docs.withColumn("shard", shard_of(F.col("doc_id"), weights or [1.0] * shards))
    placed.write.partitionBy("shard").parquet(path)


#: DuckDB SQL of sharded() with 24 equal shards; its CRC is the bytewise one over a table made from the polynomial.
SQL = r"""
WITH RECURSIVE bit AS (SELECT n AS k, n AS c, 0 AS step FROM range(256) AS x(n)
  UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bit WHERE step < 8),
tab AS (SELECT list(c ORDER BY k) AS t FROM bit WHERE step = 8),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (SELECT d.*, hex(encode(text)) AS h FROM docs d),
crc AS (SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda a, b: xor(a >> 8, tab.t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM pairs, tab),
val AS (SELECT doc_id, n, -1.0 / ln((('0x' || substr(md5('k' || doc_id || ':' || n), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS v FROM docs, range(25) AS x(n)),
own AS (SELECT doc_id, CAST(arg_max(n, v) FILTER (WHERE n < 24) AS INTEGER) AS shard, CAST(arg_max(n, v) AS INTEGER) AS grown_shard FROM val GROUP BY doc_id)
SELECT doc_id, CAST(strlen(text) + 8 AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY substr(md5('slot:' || doc_id || ':' || text_crc32 || ':' || (strlen(text) + 8)), 1, 3), doc_id) - 1 AS BIGINT) AS slot, grown_shard
FROM crc JOIN own USING (doc_id)
"""
