"""State of running jobs in a stream: numbers, sampled progress, ends and tracks, held in transformWithState so that a restart repeats and misses nothing.

The session needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass (see with_state).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pingframe.streaming.jobs import ENDS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENT = "job_id long, seq long, event_id long, ts timestamp, type string, stage string, written boolean"
SEGMENT = "job_id long, code string, ping_start long, ping_end long, points array<struct<ping: double, lat: double, lon: double>>"
#: Codes of warnings that are drawn along the track.
DRAWN = ("DROPOUT", "HIGH_MOTION")


@contextmanager
def with_state(spark: SparkSession) -> Iterator[SparkSession]:
    """The session with the state store that transformWithState needs, for the streams that are started inside."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield spark
    finally:
        spark.conf.set(PROVIDER, before)


class Numbered(StatefulProcessor):
    """Events of a job (job_id, event_id, ts, type, stage) with rising numbers from 1 and whether they are written to the job's row.

    Events of one batch are numbered by ts and event_id. Progress is written if its stage is new or the last write is at least every_s seconds ago; all other events are.
    The first of ENDS is a job's last event: what comes later is ignored for as long as the job's state is kept, keep_s seconds of event time.
    """

    def __init__(self, every_s: float, keep_s: int) -> None:
        self.every_s, self.keep_ms = every_s, keep_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._job = handle.getValueState("job", "seq long, stage string, write_us long, ended boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        seq, stage, at, ended = self._job.get() if self._job.exists() else (0, None, None, False)
        if ended:
            return
        own = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        kinds = own["type"].to_numpy()
        last = np.flatnonzero(np.isin(kinds, ENDS))[:1]
        if len(last):
            own, kinds, ended = own.iloc[: last[0] + 1], kinds[: last[0] + 1], True
        times = own["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        written = np.ones(len(own), dtype=bool)
        progress = np.flatnonzero(kinds == "progress")
        for k, name, now in zip(progress.tolist(), own["stage"].to_numpy()[progress].tolist(), times[progress].tolist(), strict=True):
            if stage != name or at is None or now - at >= self.every_s * 1e6:
                stage, at = name, now
            else:
                written[k] = False
        if ended:
            self._handle.registerTimer(int(times[-1]) // 1000 + self.keep_ms)
        self._job.update((seq + len(own), stage, at, ended))
        yield own.assign(job_id=key[0], seq=np.arange(seq + 1, seq + len(own) + 1), written=written)[[c.split()[0] for c in EVENT.split(", ")]]

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self._job.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in EVENT.split(", ")])

    def close(self) -> None:
        pass


def numbered(stream: DataFrame, every_s: float = 1.0, keep_s: int = 86_400, late: str = "1 hour") -> DataFrame:
    """The stream of events as Numbered gives it."""
    timed = stream.withWatermark("ts", late)
    return timed.groupBy("job_id").transformWithStateInPandas(Numbered(every_s, keep_s), EVENT, "Append", "EventTime")


class Tracks(StatefulProcessor):
    """Segments of a job's track for its warnings, rebuilt from the chunks that came: from rows (job_id, kind, code, ping_start, ping_end, points).

    A chunk has sampled points, whose ping numbers lie evenly from its first to its last ping. A warning gets the points inside its pings; if there are none, the one nearest
    to either end. It waits until a chunk reaches beyond its last ping, or until the job ends (kind `end`). Warnings of codes that are not drawn give nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._points = handle.getListState("points", "ping double, lat double, lon double")
        self._waiting = handle.getListState("waiting", "code string, ping_start long, ping_end long")
        self._reach = handle.getValueState("reach", "ping long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["ping_start", "ping_end"])
        chunks, ended = own[own["kind"] == "chunk"], bool((own["kind"] == "end").any())
        new = [p for c in chunks.itertuples() for p in _spread(int(c.ping_start), int(c.ping_end), c.points)]
        if new:
            self._points.appendList(new)
        reach = max([self._reach.get()[0] if self._reach.exists() else -1, *chunks["ping_end"].astype(int).tolist()])
        self._reach.update((reach,))
        drawn = own[(own["kind"] == "warning") & own["code"].isin(DRAWN)]
        waiting = [*self._waiting.get(), *((w.code, int(w.ping_start), int(w.ping_end)) for w in drawn.itertuples())]
        ready = [w for w in waiting if ended or w[2] < reach]
        out = []
        if ready:
            points = sorted(tuple(p) for p in self._points.get())
            out = [(key[0], *w, _inside(points, w[1], w[2])) for w in ready]
        left = [] if ended else [w for w in waiting if w[2] >= reach]
        self._waiting.put(left) if left else self._waiting.clear()
        yield pd.DataFrame(out, columns=["job_id", "code", "ping_start", "ping_end", "points"])

    def close(self) -> None:
        pass


def _spread(first: int, last: int, points: list) -> list[tuple[float, float, float]]:
    step = (last - first) / (len(points) - 1) if len(points) > 1 else 0.0
    return [(first + step * i, float(p["lat"]), float(p["lon"])) for i, p in enumerate(points)]


def _inside(points: list[tuple], first: int, last: int) -> list[dict]:
    own = [p for p in points if first <= p[0] <= last] or sorted(points, key=lambda p: (min(abs(p[0] - first), abs(p[0] - last)), p[0]))[:1]
    return [{"ping": p[0], "lat": p[1], "lon": p[2]} for p in own]


def tracks(stream: DataFrame) -> DataFrame:
    """The stream of segments as Tracks gives them."""
    return stream.groupBy("job_id").transformWithStateInPandas(Tracks(), SEGMENT, "Append", "None")


def stored(numbers: DataFrame, out: str, checkpoint: str) -> None:
    """Run the stream of numbered events to its end: each batch's events go to out/events, and only then its ends to out/ends.

    A batch that is run again after a failure takes the place of what it wrote, so an end is never there without the rows before it, and none comes twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            held.write.mode("overwrite").parquet(f"{out}/events/batch={number}")
            held.where(F.col("type").isin(*ENDS)).select("job_id", "seq", "ts", F.col("type").alias("status")).write.mode("overwrite").parquet(f"{out}/ends/batch={number}")
        finally:
            held.unpersist()

    numbers.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
