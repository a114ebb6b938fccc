"""Folders watched for files, and listeners to events."""

from __future__ import annotations

import logging
import zlib
from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingframe.operators import detectors
from pingframe.operators.catalogue import FORMATS
from pingframe.operators.raster import row_image
from pingframe.sources import geotiff, sonar_log
from pingframe.sources.text import BadSource
from pingframe.streaming.jobs import settled

STATE = "path string, length long, modificationTime timestamp, status string, error string, detections long"
CHUNK = 2000

Process = Callable[[SparkSession, str], int]
Listener = Callable[[DataFrame, int], None]


def processor(find: detectors.Detector, out: str, size: int = 640, overlap: float = 0.25) -> Process:
    """What is done with a file: its detections by `find`, as Parquet in a folder of `out`; gives their number.

    Mosaics are placed by their own transform. Logs are images of 2,000 pings each (port turned outwards), whose
    boxes are numbered by ping.
    """

    def process(spark: SparkSession, path: str) -> int:
        kind = FORMATS.get(path.rsplit(".", 1)[-1].lower())
        if kind == "geotiff":
            errors = [r["error"] for r in geotiff.strips(spark, path).where("error is not null").select("error").limit(1).collect()]
            found = detectors.mosaic_detections(geotiff.read(spark, path), find, size, overlap)
        elif kind == "xtf":
            errors = [r["error"] for r in sonar_log.profile(spark, path).where("error is not null").select("error").collect()]
            chunk = F.floor(F.col("ping") / CHUNK)
            rows = sonar_log.read(spark, path).select(chunk.alias("chunk"), (F.col("ping") - chunk * CHUNK).alias("row"), row_image(F.col("port"), F.col("starboard")).alias("v"))
            own = detectors.detected(detectors.tiled(rows, ["chunk"], "row", "v", size, overlap), ["chunk"], "row", find)
            found = own.withColumn("ping_start", F.col("y1") + F.col("chunk") * CHUNK).withColumn("ping_end", F.col("y2") - 1 + F.col("chunk") * CHUNK)
        else:
            raise BadSource("UNSUPPORTED_FORMAT", path)
        if errors:
            raise BadSource(errors[0], path)
        where = f"{out.rstrip('/')}/{path.rstrip('/').rsplit('/', 1)[-1]}-{zlib.crc32(path.encode()):08x}"
        found.write.mode("overwrite").parquet(where)
        return spark.read.schema(found.schema).parquet(where).count()

    return process


def _known(spark: SparkSession, state: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(state)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(STATE).parquet(state)
    return spark.createDataFrame([], STATE)


def scan(spark: SparkSession, folder: str, state: str, process: Process, stable_s: int = 10, now: datetime | None = None) -> list[tuple[str, str]]:
    """Process the files of a folder that are new or changed and have been still for stable_s seconds; gives (path, done or failed) of each.

    A state of a file is its path, length and time. What became of it is added to the table `state` before the next file is taken, so a
    restart repeats one file at most, and a failed one is not tried again until it changes. Files go one by one, each a Spark job of its
    own; their list is read as it is needed. Spark lists no empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    at = F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()
    todo = settled(files, at, stable_s).join(_known(spark, state), ["path", "length", "modificationTime"], "left_anti")
    out = []
    for f in todo.orderBy("modificationTime", "path").toLocalIterator():
        try:
            row = (*f, "done", None, process(spark, f["path"]))
        except BadSource as e:
            row = (*f, "failed", f"{e.code}: {e}", None)
        except Exception as e:  # the watcher goes on whatever one file does
            row = (*f, "failed", f"{type(e).__name__}: {e}", None)
        spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").parquet(state)
        out.append((f["path"], row[3]))
    return out


def listened(events: DataFrame, listeners: Iterable[Listener], checkpoint: str) -> None:
    """Give each batch of a stream's available events to all listeners (batch, number); one that fails is told of and does not stop the others.

    The checkpoint holds what has been given, so a restart goes on after it; the batch under way at a crash is given again, with its number.
    """
    told = list(listeners)

    def each(batch: DataFrame, number: int) -> None:
        for listener in told:
            try:
                listener(batch, number)
            except Exception:
                logging.getLogger(__name__).exception("a listener failed on batch %s", number)

    events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
