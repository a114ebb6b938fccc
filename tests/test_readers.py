"""Data sources over files that the tests write, in both port orders, in batch and as a growing folder."""

import os
import struct

import numpy as np
import pytest

from pingframe.sources import log_files, pages, readers, sonar_log
from test_sources import log


@pytest.fixture
def sources(spark):
    readers.register(spark)
    return spark


def lines(spark, count=3, pings=40, samples=32, far=True):
    rng = np.random.default_rng(1)
    fall = np.linspace(900, 30, samples)
    rows = [(f"L{k}", p, (fall + rng.integers(0, 40, samples)).astype(int).tolist(), (fall + rng.integers(0, 40, samples)).astype(int).tolist(), 12.34 + p, far) for k in range(count) for p in range(pings)]
    return spark.createDataFrame(rows, "line string, ping long, port array<long>, starboard array<long>, cable_out_m double, far boolean")


@pytest.mark.parametrize("far", [True, False])
def test_both_port_orders_give_the_nearest_first(sources, tmp_path, far):
    rows = lines(sources, far=far)
    assert {r["pings"] for r in log_files.write(rows, str(tmp_path), "line", "far").collect()} == {40}
    want = {(r["line"], r["ping"]): (r["port"], r["starboard"], r["cable_out_m"]) for r in rows.collect()}
    for got in (sonar_log.read(sources, str(tmp_path), batch=7), sources.read.format("sonar_log").load(str(tmp_path))):
        found = {(r["path"][-6:-4], r["ping"]): (r["port"], r["starboard"], pytest.approx(r["cable_out_m"])) for r in got.collect()}
        assert {k: (p, s) for k, (p, s, _) in found.items()} == {k: (p, s) for k, (p, s, _) in want.items()} and all(want[k][2] == c for k, (_, _, c) in found.items())
    forced = sonar_log.read(sources, str(tmp_path), port_order="nadir_first" if far else "far_first").where("ping = 3").collect()
    assert all(r["port"] == want[(r["path"][-6:-4], 3)][0][::-1] for r in forced)
    swapped = sources.read.format("sonar_log").option("channels", "1,0").option("port_order", "nadir_first").load(str(tmp_path)).where("ping = 3").collect()
    assert all(r["port"] == want[(r["path"][-6:-4], 3)][1] for r in swapped)


def test_flat_sides_are_taken_as_farthest_first(sources, tmp_path):
    rows = sources.createDataFrame([("a", p, [5, 5, 5, 6], [7, 7, 7, 7]) for p in range(3)], "line string, ping long, port array<long>, starboard array<long>")
    log_files.write(rows, str(tmp_path), "line").collect()
    assert [r["port"] for r in sonar_log.read(sources, str(tmp_path)).collect()] == [[5, 5, 5, 6]] * 3
    with pytest.raises(ValueError):
        sonar_log.read(sources, str(tmp_path), port_order="other")


def test_only_wanted_columns_are_decoded(sources, tmp_path, monkeypatch):
    (tmp_path / "a.xtf").write_bytes(log(n=6))
    (tmp_path / "b.xtf").write_bytes(log(bad=True))
    (tmp_path / "c.xtf").write_bytes(log(n=3, tail=10))
    (tmp_path / ".d.xtf").write_bytes(log(n=9))
    (tmp_path / "e.xtf").write_bytes(b"")
    got = sources.read.format("sonar_log").schema("ping long, heading_deg double, time_utc timestamp").load(str(tmp_path)).collect()
    assert sorted(r["ping"] for r in got) == [0, 0, 1, 1, 2, 3, 4, 5] and {r["heading_deg"] for r in got} == {90.0}
    taken = []
    real = pages.Pages.take
    monkeypatch.setattr(pages.Pages, "take", lambda self, at, n: taken.append(n) or real(self, at, n))
    with pages.Pages(str(tmp_path / "a.xtf")) as raw:
        own = sonar_log.opened(raw)
        taken.clear()
        sonar_log.table(own, "a", 0, list(sonar_log.pings(own, {})), True, ["ping", "heading_deg"])
        assert max(taken) == 256
    with pytest.raises(Exception, match="no columns other"):
        sources.read.format("sonar_log").schema("other long").load(str(tmp_path)).collect()


def test_mosaics(sources, tmp_path):
    from test_sources import mosaic

    values = np.arange(12 * 5).reshape(12, 5) % 200
    (tmp_path / "m.tif").write_bytes(mosaic(values.tolist()))
    (tmp_path / "bad.tif").write_bytes(struct.pack("<4sQQ", b"none", 0, 0))
    rows = sources.read.format("mosaic").load(str(tmp_path)).orderBy("row").collect()
    assert [r["v"] for r in rows] == values.tolist() and len({r["epsg"] for r in rows}) == 1
    assert sources.read.format("mosaic").schema("row long").load(str(tmp_path)).count() == 12


def test_a_growing_folder_is_read_once(sources, tmp_path):
    """Files that come between runs are given once, also after a restart from the checkpoint."""
    folder, out, state = (tmp_path / n for n in ("in", "out", "state"))
    folder.mkdir()

    def run():
        stream = sources.readStream.format("sonar_log").schema("path string, ping long").load(str(folder))
        stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["path"][-5:], r["ping"]) for r in sources.read.parquet(str(out)).collect())

    def put(name, n, time):
        (folder / name).write_bytes(log(n=n))
        os.utime(folder / name, ns=(time, time))

    put("a.xtf", 2, 10**18)
    put("b.xtf", 1, 10**18)
    want = [("a.xtf", 0), ("a.xtf", 1), ("b.xtf", 0)]
    assert run() == want and run() == want
    put("c.xtf", 2, 10**18 + 5)
    assert run() == want + [("c.xtf", 0), ("c.xtf", 1)] and run() == want + [("c.xtf", 0), ("c.xtf", 1)]
