"""Job state in streams against plain folds, over several batches and a restart."""

import datetime as dt

import pytest

from pingframe.streaming import state

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
KINDS = "job_id long, event_id long, ts timestamp, type string, stage string"


@pytest.fixture
def session(spark):
    with state.with_state(spark) as own:
        yield own


def events():
    out, kinds = [], ["progress", "detection", "progress", "progress", "warning"]
    for job in (1, 2, 3):
        for k in range(60):
            kind = "done" if (job, k) in ((1, 40), (2, 59)) else kinds[(k * job) % 5]
            out.append((job, k, T0 + dt.timedelta(seconds=0.4 * k), kind, f"s{k * job // 25}"))
    return out


def fold(rows, every):
    out = []
    for job in (1, 2, 3):
        seq, stage, at = 0, None, None
        for _, k, ts, kind, s in sorted(r for r in rows if r[0] == job):
            seq += 1
            write = kind != "progress" or s != stage or (ts - at).total_seconds() >= every
            if kind == "progress" and write:
                stage, at = s, ts
            out.append((job, seq, k, kind, write))
            if kind == "done":
                break
    return sorted(out)


def test_numbers_progress_and_ends(session, tmp_path):
    rows = events()
    for n in range(3):
        session.createDataFrame(rows[n * 20 : n * 20 + 20] + rows[60 + n * 20 : 80 + n * 20] + rows[120 + n * 20 : 140 + n * 20], KINDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = session.readStream.schema(KINDS).parquet(f"{tmp_path}/in")
        state.stored(state.numbered(stream, 1.0), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((r["job_id"], r["seq"], r["event_id"], r["type"], r["written"]) for r in session.read.parquet(f"{tmp_path}/out/events").collect())
    assert got == fold(rows, 1.0) and any(not g[4] for g in got)
    assert sorted((r["job_id"], r["seq"], r["status"]) for r in session.read.parquet(f"{tmp_path}/out/ends").collect()) == [(1, 41, "done"), (2, 60, "done")]


def test_segments_are_rebuilt_from_chunks(session, tmp_path):
    kinds = "job_id long, kind string, code string, ping_start long, ping_end long, points array<struct<lat: double, lon: double>>"
    points = lambda a, n: [{"lat": 13 + (a + i) / 1e3, "lon": 80.0} for i in range(n)]
    batches = [
        [(1, "chunk", None, 0, 99, points(0, 4)), (1, "warning", "DROPOUT", 20, 70, None), (1, "warning", "HIGH_MOTION", 90, 120, None), (1, "warning", "OTHER", 0, 9, None)],
        [(1, "chunk", None, 100, 199, points(4, 4)), (2, "chunk", None, 5, 5, points(0, 1)), (2, "warning", "DROPOUT", 50, 60, None)],
        [(1, "warning", "DROPOUT", 141, 142, None), (1, "warning", "DROPOUT", 190, 300, None), (1, "end", None, None, None, None), (2, "end", None, None, None, None)],
    ]
    for n, rows in enumerate(batches):
        session.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = session.readStream.schema(kinds).parquet(f"{tmp_path}/in")
        state.tracks(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r["job_id"], r["ping_start"]): [round(p["ping"]) for p in r["points"]] for r in session.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, 20): [33, 66], (1, 90): [99, 100], (2, 50): [5], (1, 141): [133], (1, 190): [199]}


def test_the_state_of_an_ended_job_goes(session, tmp_path):
    """Long after its end a job's number is free again; until then later events are ignored."""
    rows = [[(1, 1, T0, "done", "s"), (1, 2, T0, "detection", "s")], [(1, 3, T0 + dt.timedelta(minutes=1), "detection", "s"), (2, 4, T0 + dt.timedelta(days=9), "detection", "s")], [(2, 5, T0 + dt.timedelta(days=9), "detection", "s")], [(1, 6, T0 + dt.timedelta(days=9), "detection", "s")]]
    for batch in rows:
        session.createDataFrame(batch, KINDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = session.readStream.schema(KINDS).parquet(f"{tmp_path}/in")
        state.stored(state.numbered(stream, 1.0, 3600), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r["job_id"], r["seq"], r["event_id"]) for r in session.read.parquet(f"{tmp_path}/out/events").collect()) == [(1, 1, 1), (1, 1, 6), (2, 1, 4), (2, 2, 5)]


def test_events_of_an_ended_job_are_not_read():
    """A job's rows are numbered in one piece up to its end; rows that come later are not touched."""
    import pandas as pd

    class Held:
        value = None
        timers: list = []
        getValueState = lambda self, *_: self
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, value: setattr(self, "value", value)
        registerTimer = lambda self, ms: self.timers.append(ms)

    held, job = Held(), state.Numbered(1.0, 60)
    job.init(held)
    t = pd.to_datetime([T0.replace(tzinfo=None)] * 4)
    rows = pd.DataFrame({"job_id": 1, "event_id": [4, 3, 2, 1], "ts": t, "type": ["detection", "done", "progress", "progress"], "stage": "s"})
    got = pd.concat(job.handleInputRows((1,), iter([rows]), None))
    assert got[["seq", "event_id", "written"]].values.tolist() == [[1, 1, True], [2, 2, False], [3, 3, True]]
    assert held.value[0] == 3 and held.value[3] and len(held.timers) == 1

    def unread():
        raise AssertionError("rows of an ended job were read")
        yield

    assert list(job.handleInputRows((1,), unread(), None)) == [] and held.value[0] == 3
