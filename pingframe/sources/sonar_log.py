"""XTF sonar logs as tables of pings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingframe.sources.pages import Pages, listed

#: Fixed values of the format: first byte, packet mark, kind of sonar packets, sides, sample types by format code or width.
FIRST_BYTE, MARK, SONAR, PORT, STARBOARD = 0x7B, 0xFACE, 0, 1, 2
BY_FORMAT, BY_WIDTH = {2: "<u4", 3: "<u2", 5: "<f4", 8: "u1"}, {1: "u1", 2: "<u2", 4: "<u4"}
KNOT = 1852 / 3600

PING = (
    "path string, ping long, time_utc timestamp, sensor_x double, sensor_y double, ship_x double, ship_y double, heading_deg double, altitude_m double, sensor_depth_m double, "
    "speed_mps double, roll_deg double, pitch_deg double, cable_out_m double, layback_m double, slant_range_m double, port array<double>, starboard array<double>"
)
SPAN = "path string, first long, at long, pings long, turned boolean"
PROFILE = "path string, error string, pings long, truncated boolean, port_samples long, starboard_samples long, sonar string"


class BadLog(ValueError):
    """The file is no readable log."""


@dataclass
class Log:
    """The header of a log: what its channels hold, and where packets begin."""

    raw: Pages
    sonar: str
    sides: dict[int, str]
    widths: list[int]
    kinds: list[str | None]
    first: int


def opened(raw: Pages, channels: tuple[int, int] | None = None) -> Log:
    """Port and starboard channels by type, or by the numbers given; two untyped channels are port and starboard, in this order."""
    if raw.size < 1024 or raw.take(0, 1)[0] != FIRST_BYTE:
        raise BadLog("CORRUPT_HEADER")
    sonar, bathy = raw.unpack("<HH", 166)
    types, widths, kinds = [], [], []
    for i in range(min(6, sonar + bathy)):
        at = 256 + 128 * i
        width = raw.unpack("<H", at + 6)[0] or 2
        kind = BY_FORMAT.get(raw.take(at + 74, 1)[0]) or BY_WIDTH.get(width)
        types.append(raw.take(at, 1)[0])
        widths.append(width)
        kinds.append(kind if kind and np.dtype(kind).itemsize == width else None)
    sides = {types.index(t): name for t, name in ((PORT, "port"), (STARBOARD, "starboard")) if t in types[:sonar]}
    if channels is not None:
        sides = {i: name for i, name in zip(channels, ("port", "starboard"), strict=True) if i < len(kinds)}
    if not sides and sonar >= 2:
        sides = {0: "port", 1: "starboard"}
    if not sides or any(kinds[i] is None for i in sides):
        raise BadLog("CORRUPT_HEADER")
    name = raw.take(18, 16).split(b"\0")[0].decode("latin-1").strip()
    return Log(raw, name, sides, widths, kinds, 1024 if sonar + bathy <= 6 else 2048)


def pings(log: Log, found: dict, start: int | None = None) -> Iterator[tuple[int, dict[str, tuple[int, int, str]]]]:
    """(offset, {side: (offset of samples, count, type)}) of each whole sonar packet; found["truncated"] tells of a broken tail.

    Reading starts at the first packet, or at the packet at `start`, and stops at the first malformed one; packets of other kinds are
    passed over.
    """
    at, raw = log.first if start is None else start, log.raw
    while at < raw.size:
        if at + 14 > raw.size:
            found["truncated"] = True
            return
        mark, kind, _, channels, _, size = raw.unpack("<HBBH4sI", at)
        if mark != MARK or size < 14 or at + size > raw.size:
            found["truncated"] = True
            return
        if kind == SONAR:
            inside, sides = at + 256, {}
            for i in range(channels):
                if inside + 64 > at + size:
                    found["truncated"] = True
                    return
                count = raw.unpack("<I", inside + 42)[0]
                width = log.widths[i] if i < len(log.widths) else 2
                if inside + 64 + count * width > at + size:
                    found["truncated"] = True
                    return
                if i in log.sides:
                    sides[log.sides[i]] = (inside, count, log.kinds[i])
                inside += 64 + count * width
            yield at, sides
        at += size


#: Where a packet has what, from its first byte on.
HEADER = np.dtype({
    "names": ["year", "month", "day", "hour", "minute", "second", "hundredths", "ship_y", "ship_x", "knots", "sensor_y", "sensor_x", "cable", "layback", "sensor_depth_m", "altitude", "pitch_deg", "roll_deg", "heading_deg", "cable_hundredths"],
    "formats": ["<u2", *["u1"] * 6, "<f8", "<f8", "<f4", "<f8", "<f8", "<u2", "<f4", "<f4", "<f4", "<f4", "<f4", "<f4", "u1"],
    "offsets": [14, 16, 17, 18, 19, 20, 21, 128, 136, 152, 160, 168, 182, 184, 192, 196, 204, 208, 212, 249], "itemsize": 256,
})
#: Pings of a log that its port order is told from, bins of their profiles, and how much the two correlations must differ.
ORDER_PINGS, ORDER_BINS, ORDER_MARGIN = 200, 256, 0.2


def samples(log: Log, sides: dict[str, tuple[int, int, str]], side: str, turned: bool) -> np.ndarray | None:
    """A side's samples, nadir first; turned: port samples are stored farthest first."""
    if side not in sides:
        return None
    inside, count, kind = sides[side]
    out = np.frombuffer(log.raw.take(inside + 64, count * np.dtype(kind).itemsize), kind).astype(np.float64)
    return out[::-1] if turned and side == "port" else out


def farthest_first(log: Log, places: list[int]) -> bool:
    """Whether port samples are stored farthest first, told from up to ORDER_PINGS of the packets at `places`, evenly spaced.

    Mean log1p levels of both sides over the range are correlated as they are stored and with the port side turned. Where the two differ by less than
    ORDER_MARGIN, or there is one side only, farthest first is taken, as most sonars store it.
    """
    some = places[:: -(-len(places) // ORDER_PINGS)]
    sums = {"port": np.zeros(ORDER_BINS), "starboard": np.zeros(ORDER_BINS)}
    bins = None
    for at in some:
        sides = next(pings(log, {}, at), (0, {}))[1]
        both = {side: samples(log, sides, side, False) for side in sums}
        if any(x is None or not len(x) for x in both.values()):
            return True
        bins = min(ORDER_BINS, bins or ORDER_BINS, *map(len, both.values()))
        for side, x in both.items():
            edges = np.arange(len(x)) * bins // len(x)
            sums[side] = sums[side][:bins] + np.bincount(edges, np.log1p(np.maximum(x, 0)), bins) / np.bincount(edges, minlength=bins)
    if not bins or bins < 2 or any(not np.ptp(x[:bins]) for x in sums.values()):
        return True
    port, starboard = (x[:bins] for x in sums.values())
    same, turned = np.corrcoef(port, starboard)[0, 1], np.corrcoef(port[::-1], starboard)[0, 1]
    return bool(same - turned < ORDER_MARGIN)


def table(log: Log, path: str, first: int, found: list[tuple[int, dict]], turned: bool, wanted: list[str]) -> pd.DataFrame:
    """The wanted columns of PING of packets, numbered from `first`; samples are read only if they are among them."""
    h = np.frombuffer(b"".join(log.raw.take(at, 256) for at, _ in found), HEADER)
    plain = {"sensor_x", "sensor_y", "ship_x", "ship_y", "heading_deg", "sensor_depth_m", "roll_deg", "pitch_deg"}
    out: dict = {}
    for c in wanted:
        if c in plain:
            out[c] = h[c].astype(np.float64)
        elif c == "path":
            out[c] = path
        elif c == "ping":
            out[c] = np.arange(first, first + len(found))
        elif c == "time_utc":
            parts = pd.DataFrame({k: h[k].astype(np.int64) for k in ("year", "month", "day", "hour", "minute")} | {"second": np.minimum(h["second"], 59).astype(np.int64)})
            out[c] = pd.to_datetime(parts, errors="coerce") + pd.to_timedelta(10 * h["hundredths"].astype(np.int64), unit="ms")
        elif c == "altitude_m":
            out[c] = np.where(h["altitude"] > 0, h["altitude"].astype(np.float64), np.nan)
        elif c == "speed_mps":
            out[c] = h["knots"].astype(np.float64) * KNOT
        elif c in ("cable_out_m", "layback_m"):
            x = h["cable"] + h["cable_hundredths"] / 100.0 if c == "cable_out_m" else h["layback"].astype(np.float64)
            out[c] = np.where(x != 0, x, np.nan)
        elif c == "slant_range_m":
            ranges = [[log.raw.unpack("<f", sides[side][0] + 4)[0] for side in ("port", "starboard") if side in sides] for _, sides in found]
            out[c] = [next((r for r in own if r > 0), None) for own in ranges]
        elif c in ("port", "starboard"):
            out[c] = [samples(log, sides, c, turned) for _, sides in found]
    return pd.DataFrame(out, columns=wanted, index=range(len(found)))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def read(spark: SparkSession, path: str, batch: int = 500, port_order: str = "auto", channels: tuple[int, int] | None = None) -> DataFrame:
    """The pings of all logs under path, numbered from 0 in each; samples of both sides nadir first.

    A first pass walks the packet headers of a file, a page at a time, and gives a row for every `batch` pings: where they begin. These
    spans are dealt to all tasks, and each is decoded by itself, so a file of any size is read in parallel and never held whole. Files
    that are no logs give no pings: profile() tells why. Altitudes not above 0, and cable lengths and laybacks of 0, are null.
    port_order: how port samples are stored: far_first, nadir_first, or auto, which tells it for each file (see farthest_first). channels: the numbers of the
    port and the starboard channel, for sonars of several frequencies.
    """
    if port_order not in ("auto", "far_first", "nadir_first"):
        raise ValueError(f"unknown port order: {port_order}")

    def spans(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in files:
            for path in f["path"]:
                with Pages(path) as raw:
                    try:
                        log = opened(raw, channels)
                    except BadLog:
                        continue
                    rows = spanned(log, path, batch, port_order)
                yield pd.DataFrame(rows, columns=_names(SPAN))

    def decoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            for s in f.itertuples():
                with Pages(s.path) as raw:
                    log = opened(raw, channels)
                    yield table(log, s.path, s.first, list(islice(pings(log, {}, s.at), s.pings)), s.turned, _names(PING))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed(spark, path).mapInPandas(spans, SPAN).repartition(tasks, "path", "first").mapInPandas(decoded, PING)


def spanned(log: Log, path: str, batch: int, port_order: str) -> list[tuple]:
    """Rows of SPAN of a log. Of the packets' places only as many are kept as there are spans."""
    starts, n = [], 0
    for n, (at, _) in enumerate(pings(log, {}), 1):
        if (n - 1) % batch == 0:
            starts.append(at)
    turned = port_order == "far_first" or port_order == "auto" and bool(starts) and farthest_first(log, starts if len(starts) >= ORDER_PINGS else [at for at, _ in islice(pings(log, {}), ORDER_PINGS)])
    return [(path, k * batch, at, min(batch, n - k * batch), turned) for k, at in enumerate(starts)]


def profile(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: error (CORRUPT_HEADER, NO_PINGS or null), pings, truncated, most samples a side, sonar."""

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in files:
            rows = []
            for path in f["path"]:
                with Pages(path) as raw:
                    try:
                        log, found, n, most = opened(raw), {}, 0, {"port": 0, "starboard": 0}
                        for _, sides in pings(log, found):
                            n += 1
                            for side, (_, count, _) in sides.items():
                                most[side] = max(most[side], count)
                        rows.append((path, None if n else "NO_PINGS", n, bool(found), most["port"], most["starboard"], log.sonar))
                    except BadLog as e:
                        rows.append((path, str(e), 0, False, 0, 0, None))
            yield pd.DataFrame(rows, columns=_names(PROFILE))

    return listed(spark, path).mapInPandas(run, PROFILE)


def positioned(pings_: DataFrame) -> DataFrame:
    """pings with lat, lon and nav_source: the sensor's fix where it is valid, else the ship's; (0, 0) and impossible ones are none."""
    fine = lambda x, y: (F.abs(x) <= 180) & (F.abs(y) <= 90) & ~((x == 0) & (y == 0)) & ~F.isnan(x) & ~F.isnan(y)
    sensor, ship = fine(F.col("sensor_x"), F.col("sensor_y")), fine(F.col("ship_x"), F.col("ship_y"))
    pick = lambda a, b: F.when(sensor, F.col(a)).when(ship, F.col(b))
    return pings_.withColumn("lat", pick("sensor_y", "ship_y")).withColumn("lon", pick("sensor_x", "ship_x")).withColumn("nav_source", F.when(sensor, "sensor").when(ship, "ship"))
