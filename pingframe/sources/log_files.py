"""Lines of pings written as XTF logs."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pingframe.sources import sonar_log
from pingframe.sources.pages import store

#: Fixed values of the format: bytes of the file header, of one channel in it, of a packet's header and of a channel's in a packet.
FILE_HEAD, CHANNEL, PACKET_HEAD, SIDE_HEAD = 1024, 128, 256, 64


def file_head(sonar: str, sides: int = 2) -> bytes:
    head = np.zeros(FILE_HEAD, np.uint8)
    head[0] = sonar_log.FIRST_BYTE
    head[18 : 18 + len(sonar[:15])] = np.frombuffer(sonar[:15].encode("latin-1"), np.uint8)
    head[164:170].view("<u2")[:] = [3, sides, 0]
    for i in range(sides):
        own = head[256 + CHANNEL * i : 256 + CHANNEL * (i + 1)]
        own[0], own[74] = (sonar_log.PORT, sonar_log.STARBOARD)[i], 3
        own[6:8].view("<u2")[0] = 2
    return head.tobytes()


def packets(rows: pd.DataFrame, farthest_first: bool) -> bytes:
    """Packets of pings with as many samples each; columns that rows lack are 0."""
    n, count = len(rows), len(rows["port"].iloc[0])
    size = PACKET_HEAD + 2 * (SIDE_HEAD + 2 * count)
    raw = np.zeros((n, size), np.uint8)
    head = np.zeros(n, sonar_log.HEADER)
    direct = {"sensor_x": "lon", "sensor_y": "lat", "heading_deg": "heading_deg", "altitude": "altitude_m", "sensor_depth_m": "sensor_depth_m", "roll_deg": "roll_deg", "pitch_deg": "pitch_deg", "layback": "layback_m"}
    for field, column in direct.items():
        if column in rows:
            head[field] = rows[column].fillna(0).to_numpy()
    if "speed_mps" in rows:
        head["knots"] = rows["speed_mps"].fillna(0).to_numpy() / sonar_log.KNOT
    if "cable_out_m" in rows:
        hundredths = np.rint(rows["cable_out_m"].fillna(0).to_numpy() * 100).astype(np.int64)
        head["cable"], head["cable_hundredths"] = hundredths // 100, hundredths % 100
    if "time_utc" in rows:
        time = pd.to_datetime(rows["time_utc"]).dt
        for field in ("year", "month", "day", "hour", "minute", "second"):
            head[field] = getattr(time, field).to_numpy()
        head["hundredths"] = time.microsecond.to_numpy() // 10_000
    raw[:, :PACKET_HEAD] = head.view(np.uint8).reshape(n, PACKET_HEAD)
    raw[:, 0:2] = np.frombuffer(np.uint16(sonar_log.MARK).astype("<u2").tobytes(), np.uint8)
    raw[:, 4] = 2
    raw[:, 10:14] = np.frombuffer(np.array([size], "<u4").tobytes(), np.uint8)
    for i, side in enumerate(("port", "starboard")):
        at = PACKET_HEAD + i * (SIDE_HEAD + 2 * count)
        levels = np.stack(rows[side].to_numpy())
        levels = levels[:, ::-1] if side == "port" and farthest_first else levels
        raw[:, at + 4 : at + 8] = np.asarray(rows["slant_range_m"] if "slant_range_m" in rows else np.zeros(n), "<f4").view(np.uint8).reshape(n, 4)
        raw[:, at + 42 : at + 46] = np.frombuffer(np.array([count], "<u4").tobytes(), np.uint8)
        raw[:, at + SIDE_HEAD : at + SIDE_HEAD + 2 * count] = np.ascontiguousarray(levels.astype("<u2")).view(np.uint8).reshape(n, 2 * count)
    return raw.tobytes()


def write(rows: DataFrame, folder: str, name: str, farthest_first: str | None = None, sonar: str = "pingframe") -> DataFrame:
    """Write rows (name, ping, port, starboard, and what else a packet has) as folder/<name>.xtf, a file for each name; gives (path, pings) when it runs.

    Samples are whole numbers up to 65,535, as many on all pings of a file, nadir first; farthest_first names a boolean column that tells how a file stores its port
    side (farthest first where there is none). The pings of one file meet in one task. A file gets its name when it is whole.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("ping")
        system, place = store(folder)
        system.create_dir(place, recursive=True)
        path = f"{place}/{own[name].iloc[0]}.xtf"
        with system.open_output_stream(part := f"{place}/.{uuid.uuid4().hex}") as out:
            out.write(file_head(sonar))
            out.write(packets(own, bool(own[farthest_first].iloc[0]) if farthest_first else True))
        system.move(part, path)
        return pd.DataFrame({"path": [path], "pings": [len(own)]})

    return rows.groupBy(name).applyInPandas(run, "path string, pings long")
