"""Watched folders and listeners."""

import os
from datetime import datetime, timedelta, timezone

from test_sources import log, mosaic

from pingframe.operators import detectors
from pingframe.streaming import jobs, watching


def test_a_state_of_a_file_is_processed_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    values = [[20] * 40 for _ in range(40)]
    for r in range(10, 14):
        values[r][20:24] = [220] * 4
    (folder / "a.tif").write_bytes(mosaic(values))
    (folder / "b.xtf").write_bytes(log(n=6))
    (folder / "c.tif").write_bytes(mosaic(values, epsg=None))
    (folder / "d.pdf").write_bytes(b"%PDF")
    process = watching.processor(detectors.bright_targets, out, 32)
    scan = lambda s=0: {p.rsplit("/", 1)[1]: what for p, what in watching.scan(spark, str(folder), state, process, 10, datetime.now(timezone.utc) + timedelta(seconds=s))}
    assert scan() == {}  # all too young
    assert scan(60) == {"a.tif": "done", "b.xtf": "done", "c.tif": "failed", "d.pdf": "failed"}
    assert scan(60) == {}
    kept = {r["path"].rsplit("/", 1)[1]: r for r in spark.read.parquet(state).collect()}
    assert kept["a.tif"]["detections"] == 1 and kept["c.tif"]["error"].startswith("CRS_REQUIRED") and kept["d.pdf"]["error"].startswith("UNSUPPORTED_FORMAT")
    made = [d for d in os.listdir(out) if d.startswith("a.tif-")]
    row = spark.read.parquet(f"{out}/{made[0]}").first()
    assert (row["x1"], row["y1"], row["x2"], row["y2"]) == (20, 10, 24, 14)
    (folder / "c.tif").write_bytes(mosaic(values) + b"\0")
    assert scan(60) == {"c.tif": "done"}


def test_listeners_hear_each_event_once(spark, tmp_path):
    events, seen = str(tmp_path / "events"), []

    def broken(batch, number):
        raise RuntimeError("no")

    def listener(batch, number):
        seen.extend(r["seq"] for r in batch.collect())

    for first in (0, 3):
        spark.createDataFrame([(k, "progress") for k in range(first, first + 3)], "seq long, type string").write.mode("append").parquet(events)
        watching.listened(jobs.read_events(spark, events, "seq long, type string"), [broken, listener], str(tmp_path / "checkpoint"))
    assert sorted(seen) == list(range(6))
