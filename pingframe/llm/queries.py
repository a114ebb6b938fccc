"""The registered queries of the training-data operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pingframe.llm import language, leaks, licences, lines, mixing, neighbours, quality, ranked, secret, shards, simhash, tokens, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": lambda s, d: simhash.components(_table(s, d, "documents")),
    "op2_quality": lambda s, d: quality.classified(_table(s, d, "documents"), _table(s, d, "labels")),
    "op3_secrets": lambda s, d: secret.scanned(_table(s, d, "documents")),
    "op4_sharding": lambda s, d: shards.sharded(_table(s, d, "documents")),
    "op5_neighbours": lambda s, d: neighbours.searched(_table(s, d, "embeddings")),
    "op6_licences": lambda s, d: licences.scanned(_table(s, d, "documents")),
    "op7_decontamination": lambda s, d: leaks.reported(_table(s, d, "documents"), _table(s, d, "benchmark")),
    "op8_mixing": lambda s, d: mixing.mixed(_table(s, d, "documents")),
    "op9_language": lambda s, d: language.identified(_table(s, d, "documents")),
    "op10_line_dedup": lambda s, d: lines.digest(_table(s, d, "documents")),
    "op11_vector_codes": lambda s, d: vector_codes.compressed(_table(s, d, "embeddings")),
    "op12_ranked": lambda s, d: ranked.ranked(_table(s, d, "documents"), _table(s, d, "benchmark")),
    "op13_tokens": lambda s, d: tokens.reported(_table(s, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op4_sharding": shards.SQL,
    "op6_licences": licences.SQL,
    "op7_decontamination": leaks.SQL,
    "op10_line_dedup": lines.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_ranked": ranked.SQL,
}
