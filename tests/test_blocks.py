"""Filters by blocks against the same filters over whole lines, and picks of picks against a plain walk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pingframe.operators import blocks, raster


def lines(spark, lengths, width=9, seed=1):
    rng = np.random.default_rng(seed)
    grids = {k: np.floor(rng.random((n, width)) * 256) for k, n in enumerate(lengths)}
    rows = [(k, r, g[r].tolist(), "kept") for k, g in grids.items() for r in range(len(g))]
    return grids, spark.createDataFrame(rows, "line long, row long, v array<double>, other string")


def gathered(df, name, grids):
    rows = df.orderBy("line", "row").collect()
    assert len(rows) == sum(map(len, grids.values())) and all(r["other"] == "kept" for r in rows)
    return {k: np.array([r[name] for r in rows if r["line"] == k]) for k in grids}


def soft(g, sigma, radius):
    w = blocks.gauss(sigma, radius)
    for axis in (1, 0):
        n = g.shape[axis]
        at = [np.abs(np.arange(n) + k) % max(2 * n - 2, 1) for k in range(-radius, radius + 1)]
        g = sum(x * np.take(g, np.where(i > n - 1, 2 * n - 2 - i, i), axis=axis) for x, i in zip(w, at))
    return g


def test_blur(spark, monkeypatch):
    """Lines shorter than the reach and much longer than a block."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)
    grids, df = lines(spark, [1, 3, 16, 17, 90])
    got = gathered(blocks.blurred(df, ["line"], "row", "v", 1.2, "soft"), "soft", grids)
    assert all(np.allclose(got[k], soft(g, 1.2, 5)) for k, g in grids.items())


def moment(g, w):
    x = np.lib.stride_tricks.sliding_window_view(np.pad(g, w // 2, mode="symmetric"), (w, w))
    return x.mean(axis=(2, 3)), x.var(axis=(2, 3))


def test_channels(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)
    grids, df = lines(spark, [4, 16, 50])
    grids[9] = np.full((6, 9), 77.0)
    df = df.unionByName(spark.createDataFrame([(9, r, [77.0] * 9, "kept") for r in range(6)], df.schema))
    got = gathered(blocks.channels(df, ["line"], "row", "v"), "channels", grids)
    for k, g in grids.items():
        (m, v), (_, t) = moment(g, 5), moment(g, 7)
        lee = m + np.where(v + v.mean() > 0, v / np.maximum(v + v.mean(), 1e-300), 0) * (g - m)
        raw, smooth, texture = got[k].transpose(1, 0, 2)
        assert (raw == g).all() and np.abs(smooth - lee).max() <= 0.5 + 1e-6 and np.abs(texture - np.minimum(2 * np.sqrt(t), 255)).max() <= 0.5 + 1e-6


@pytest.mark.parametrize("window", [1, 5, 31, 1001])
def test_running_medians(spark, monkeypatch, window):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)
    monkeypatch.setattr(blocks, "SORTED", 3000)
    rng = np.random.default_rng(window)
    own = {k: rng.random(n) for k, n in enumerate([1, 2, 7, 40, 300])}
    df = spark.createDataFrame([(k, r, float(x), "kept") for k, g in own.items() for r, x in enumerate(g)], "line long, row long, v double, other string")
    got = gathered(blocks.median_filtered(df, ["line"], "row", "v", window, "m"), "m", own)
    for k, x in own.items():
        half = min(window // 2, (len(x) - 1) // 2)
        padded = np.pad(x, half, mode="edge")
        assert np.allclose(got[k], [np.median(padded[i : i + 2 * half + 1]) for i in range(len(x))])


def test_gaps_are_refused_and_nothing_gives_nothing(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 2, 2.0)], "line long, row long, v double")
    with pytest.raises(Exception, match="rows are missing or repeated"):
        blocks.median_filtered(df, ["line"], "row", "v", 3, "m").collect()
    assert blocks.median_filtered(df.where("false"), ["line"], "row", "v", 3, "m").collect() == []
    empty = spark.createDataFrame([(1, r, None) for r in range(5)], "line long, row long, v double")
    assert [r["m"] for r in blocks.median_filtered(empty, ["line"], "row", "v", 3, "m").collect()] == [None] * 5


def radius(x, chosen):
    return np.sqrt(np.min([((x - c) ** 2).sum(axis=1) for c in chosen], axis=0).max())


def test_picks_of_picks_cover_all(spark, monkeypatch):
    """Within twice the radius of a plain walk (measured: under 1.3 times), one of each group, and the walk itself from one batch."""
    rng = np.random.default_rng(7)
    x = np.concatenate([c + 0.1 * rng.normal(size=(400, 6)) for c in np.eye(6) * 10])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0] * 6), (9000, None)], "id long, v array<double>").repartition(7)
    plain = x[raster._farthest(x, 24)]
    whole = raster.coreset(df.coalesce(1), 24).orderBy("rank").collect()
    assert [r["id"] for r in whole] == raster._farthest(x, 24)
    monkeypatch.setattr(raster, "PICKS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "90")
    try:
        got = raster.coreset(df, 24).orderBy("rank").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({r["id"] for r in got}) == 24 and [r["rank"] for r in got] == list(range(24))
    assert radius(x, np.array([r["v"] for r in got])) <= 2 * radius(x, plain)
    first = raster.coreset(df, 6).collect()
    assert {int(np.argmax(r["v"])) for r in first} == set(range(6))
    assert raster.coreset(df.where("false"), 3).collect() == []


def test_projection_keeps_groups_apart(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([c + 0.01 * rng.normal(size=(50, 300)) for c in np.eye(300)[:4] * 10])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    assert {int(np.argmax(r["v"])) for r in raster.coreset(df, 4, dims=16).collect()} == set(range(4))
