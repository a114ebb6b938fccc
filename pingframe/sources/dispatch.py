"""Which reader a file takes, and the settings of a run."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pingframe.operators.catalogue import FORMATS
from pingframe.sources import geotiff, sonar_log
from pingframe.sources.text import BadSource

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "xtf": lambda spark, path: sonar_log.positioned(sonar_log.read(spark, path)),
    "geotiff": lambda spark, path: geotiff.read(spark, path),
    "csv": lambda spark, path: spark.read.csv(path, header=True),
}


def register(kind: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """A reader for another format: a function (spark, path) -> DataFrame."""
    READERS[kind] = reader


def read(spark: SparkSession, path: str, allow_no_fix: bool = False) -> DataFrame:
    """The rows of a file by its extension. A log of which no ping has a position is refused unless allow_no_fix."""
    kind = FORMATS.get(path.rsplit(".", 1)[-1].lower())
    if kind not in READERS:
        raise BadSource("UNSUPPORTED_FORMAT", f"no reader for {path}")
    rows = READERS[kind](spark, path)
    if "lat" in rows.columns and not allow_no_fix and not rows.where("lat is not null").limit(1).count():
        raise BadSource("NO_NAVIGATION", f"no position in {path}")
    return rows


def settings(base: dict, prefix: str = "PINGFRAME_", env: dict[str, str] | None = None) -> dict:
    """base with the values that the environment overrides: PREFIX_A__B names base["a"]["b"], values are JSON where they parse."""
    out = json.loads(json.dumps(base))
    for key, text in sorted((os.environ if env is None else env).items()):
        if key.startswith(prefix):
            *path, last = key[len(prefix) :].lower().split("__")
            at = out
            for p in path:
                at = at.setdefault(p, {})
            try:
                at[last] = json.loads(text)
            except ValueError:
                at[last] = text
    return out


def digest(config: dict) -> str:
    """SHA-256 of a configuration's JSON with sorted keys: the same however its keys are ordered."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
