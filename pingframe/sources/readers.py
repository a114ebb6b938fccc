"""Logs and mosaics as data sources: spark.read.format("sonar_log") and ("mosaic"), and spark.readStream of a growing folder of logs.

    readers.register(spark)
    spark.read.format("sonar_log").schema("ping long, heading_deg double").load(folder)

A source decodes the columns of the schema that it is given and no others. Partitions are files of logs, read from the first packet to the last with two pages
in memory, and strips of mosaics; sonar_log.read() deals the spans of one file to many tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pingframe.sources import geotiff, sonar_log
from pingframe.sources.pages import Pages, store

#: Pings of an Arrow batch, and pixels of one of rows of mosaics.
PINGS, PIXELS = 500, 4_000_000


class Span(InputPartition):
    """A part of a file that one task reads."""

    def __init__(self, path: str, *place: object) -> None:
        self.path, self.place = path, place


def files(folder: str) -> list[tuple[int, str]]:
    """(time of change in nanoseconds, path) of all files that are not empty under a folder, or of one file, in this order. Names that start with a dot or
    an underscore are passed over."""
    system, name = store(folder)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((f.mtime_ns or 0, folder[: len(folder) - len(name)] + f.path if folder.endswith(name) else f.path) for f in found if f.is_file and f.size and f.base_name[0] not in "._")


def _channels(options: dict) -> tuple[int, int] | None:
    text = options.get("channels")
    return tuple(int(x) for x in text.split(",")) if text else None


class _Logs:
    """Reading of logs by batches of pings, which batch and stream readers share."""

    def __init__(self, schema: StructType, options: dict) -> None:
        known = sonar_log._names(sonar_log.PING)
        if unknown := [f.name for f in schema.fields if f.name not in known]:
            raise ValueError(f"logs have no columns {', '.join(unknown)}")
        self.kinds, self.options = to_arrow_schema(schema), options
        self.port_order, self.channels = options.get("port_order", "auto"), _channels(options)
        self.folder = options.get("path") or ""

    def rows(self, span: Span) -> Iterator[pa.RecordBatch]:
        with Pages(span.path) as raw:
            try:
                log = sonar_log.opened(raw, self.channels)
            except sonar_log.BadLog:
                return
            turned = False
            if "port" in self.kinds.names:
                first = [at for at, _ in islice(sonar_log.pings(log, {}), sonar_log.ORDER_PINGS)]
                turned = self.port_order == "far_first" or self.port_order == "auto" and sonar_log.farthest_first(log, first)
            packets, n = sonar_log.pings(log, {}), 0
            while found := list(islice(packets, PINGS)):
                table = sonar_log.table(log, span.path, n, found, turned, self.kinds.names)
                yield pa.RecordBatch.from_pandas(table, self.kinds, preserve_index=False)
                n += len(found)


class LogReader(_Logs, DataSourceReader):
    def partitions(self) -> list[Span]:
        return [Span(path) for _, path in files(self.folder)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class LogStreamReader(_Logs, DataSourceStreamReader):
    """New files of a folder, in the order of their last change. The offset is the change and path of the last file given, so a restart gives each file once; a file must
    be whole when it gets its name, and none may come with an earlier time."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = files(self.folder)
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        after, last = ((x["time"], x["path"]) for x in (start, end))
        return [Span(path) for time, path in files(self.folder) if after < (time, path) <= last]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        json.dumps(end)


class SonarLogs(DataSource):
    """Options: path, port_order (auto, far_first, nadir_first), channels (two numbers)."""

    @classmethod
    def name(cls) -> str:
        return "sonar_log"

    def schema(self) -> str:
        return sonar_log.PING

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> LogStreamReader:
        return LogStreamReader(schema, dict(self.options))


class MosaicReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.kinds, self.folder = to_arrow_schema(schema), options.get("path") or ""
        self.epsg = int(options["epsg"]) if options.get("epsg") else None

    def partitions(self) -> list[Span]:
        out = []
        for _, path in files(self.folder):
            with Pages(path) as raw:
                try:
                    out += [Span(path, *s) for s in geotiff._strips(raw, self.epsg)]
                except geotiff.BadMosaic:
                    continue
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        width, _, code, transform, first, rows, at, kind, step = partition.place
        wide = width * step * np.dtype(kind).itemsize
        several = max(1, PIXELS // max(1, width))
        with Pages(partition.path) as raw:
            for k in range(0, rows, several):
                n = min(several, rows - k)
                columns = {"path": [partition.path] * n, "row": list(range(first + k, first + k + n)), "epsg": [code] * n, "transform": [list(transform)] * n}
                if "v" in self.kinds.names:
                    pixels = np.frombuffer(raw.take(at + k * wide, n * wide), kind).reshape(n, -1)[:, ::step].astype(np.float64)
                    columns["v"] = list(pixels)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in self.kinds], schema=self.kinds)


class Mosaics(DataSource):
    """The first band of GeoTIFF mosaics, a row of pixels each. Options: path, epsg. Files that cannot be read give no rows: geotiff.strips() tells why."""

    @classmethod
    def name(cls) -> str:
        return "mosaic"

    def schema(self) -> str:
        return geotiff.ROWS

    def reader(self, schema: StructType) -> MosaicReader:
        return MosaicReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the sources known to a session."""
    for source in (SonarLogs, Mosaics):
        spark.dataSource.register(source)
