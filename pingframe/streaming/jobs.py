"""Job event streams: numbering, replay, folds and watched folders, in batch and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ENDS = ("done", "error")


def replayed(events: DataFrame, after: int) -> DataFrame:
    """The events after a sequence number, each number once, up to and with a job's first end."""
    fresh = events.where(F.col("seq") > after).dropDuplicates(["job_id", "seq"])
    over = F.max(F.col("type").isin(*ENDS)).over(Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return fresh.withColumn("over", F.coalesce(over, F.lit(False))).where("not over").drop("over")


def rising(events: DataFrame, arrival: str) -> DataFrame:
    """Events whose number is above all that arrived before in the job."""
    top = F.max("seq").over(Window.partitionBy("job_id").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("top", F.coalesce(top, F.lit(-1))).where("seq > top").drop("top")


def detections_now(events: DataFrame) -> DataFrame:
    """(job_id, detection_key, seq, value): what stands after all events: the last of each detection, unless it removes it.

    A maximum of structs by key, so a job with a third of all events still combines before the shuffle.
    """
    own = events.where(F.col("type").isin("detection", "detection_update", "detection_removed"))
    last = own.groupBy("job_id", "detection_key").agg(F.max(F.struct("seq", "type", "value")).alias("m"))
    return last.where("m.type <> 'detection_removed'").select("job_id", "detection_key", "m.seq", "m.value")


def stage_latency(events: DataFrame) -> DataFrame:
    """(job_id, first_detection_s, largest_gap_s): from a job's first event to its first detection, and the largest gap of progress."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    own = Window.partitionBy("job_id")
    marked = events.withColumn("t", seconds(F.col("ts"))).withColumn("t0", F.min("t").over(own))
    progress = marked.where("type = 'progress'").withColumn("gap", F.col("t") - F.lag("t").over(own.orderBy("seq")))
    gaps = progress.groupBy("job_id").agg(F.max("gap").alias("largest_gap_s"))
    first = marked.groupBy("job_id").agg(F.min(F.when(F.col("type") == "detection", F.col("t") - F.col("t0"))).alias("first_detection_s"))
    return first.join(gaps, "job_id", "left")


def sampled_progress(events: DataFrame, every_s: int = 1) -> DataFrame:
    """One progress event a job and time slot: the last of it."""
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (1_000_000 * every_s))
    p = events.where("type = 'progress'").withColumn("slot", slot)
    return p.groupBy("job_id", "slot").agg(F.max("seq").alias("seq"))


def read_events(spark: SparkSession, path: str, schema: str, json: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the event files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path) if json else reader.parquet(path)


def folded(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run the stream's available files through a stateful fold: numbers at or below a job's last are ignored, and each event of a
    detection gives a row (job_id, detection_key, seq, action, value). State is the last number and the standing detections of a job;
    it lives in the checkpoint, so a restart repeats nothing and misses nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, standing = state.get if state.exists else (-1, [])
        held = set(standing)
        rows = []
        for e in pd.concat(list(batches)).sort_values("seq").itertuples():
            if e.seq <= last:
                continue
            last = int(e.seq)
            if e.type in ("detection", "detection_update"):
                rows.append((key[0], e.detection_key, e.seq, "update" if e.detection_key in held else "insert", e.value))
                held.add(e.detection_key)
            elif e.type == "detection_removed" and e.detection_key in held:
                rows.append((key[0], e.detection_key, e.seq, "delete", e.value))
                held.discard(e.detection_key)
        state.update((last, sorted(int(k) for k in held)))
        yield pd.DataFrame(rows, columns=["job_id", "detection_key", "seq", "action", "value"])

    changes = stream.groupBy("job_id").applyInPandasWithState(step, "job_id long, detection_key long, seq long, action string, value double", "last long, standing array<long>", "append", "NoTimeout")
    changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def hourly_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by hour and type; an hour is given once the watermark has passed it."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour"), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "type", "n")


def settled(files: DataFrame, now: Column, stable_s: int) -> DataFrame:
    """Files (path, length, modificationTime) that have not changed for so many seconds, each state of a file once."""
    age = F.unix_timestamp(now) - F.unix_timestamp("modificationTime")
    return files.where(age >= stable_s).dropDuplicates(["path", "length", "modificationTime"])
