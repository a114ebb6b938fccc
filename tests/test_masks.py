"""Masks as runs against plain arrays of cells."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pingframe.operators import masks


def to_runs(spark, images):
    """images: key -> boolean array."""
    rows = [(k, int(r), int(c)) for k, m in images.items() for r, c in zip(*np.nonzero(m))]
    return masks.runs_of(spark.createDataFrame(rows, "key long, r long, c long"), ["key"], "r", "c")


def cells(runs, key):
    out = {}
    for r in runs.collect():
        assert r["start"] < r["end"]
        for c in range(r["start"], r["end"]):
            assert (r["row"], c) not in out.setdefault(r[key], set())
            out[r[key]].add((r["row"], c))
    return out


def even_odd(points, n):
    """Cells whose centre a ray to the left leaves an odd number of times."""
    out = set()
    for r in range(-5, n):
        for c in range(-5, n):
            odd = False
            for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
                if (y1 <= r + 0.5) != (y2 <= r + 0.5) and x1 + (r + 0.5 - y1) * (x2 - x1) / (y2 - y1) <= c + 0.5:
                    odd = not odd
            if odd:
                out.add((r, c))
    return out


def test_polygons_are_filled_by_the_even_odd_rule(spark):
    rng = np.random.default_rng(2)
    shapes = {k: [tuple(p) for p in rng.uniform(-3, 22, (int(rng.integers(3, 9)), 2)).round(2).tolist()] for k in range(30)}
    shapes |= {100: [(1.0, 1.0), (6.0, 1.0), (6.0, 4.0), (1.0, 4.0)], 101: [(0.0, 0.0), (0.0, 0.0)], 102: [], 103: [(2.0, 2.0)], 104: [(0.0, 0.2), (9.0, 0.3), (4.0, 0.4)], 105: None}
    df = spark.createDataFrame([(k, None if p is None else [{"x": x, "y": y} for x, y in p]) for k, p in shapes.items()], "key long, p array<struct<x: double, y: double>>")
    got = cells(masks.filled(df, ["key"], "p"), "key")
    assert got == {k: s for k, p in shapes.items() if p and (s := even_odd(p, 30))}
    assert got[100] == {(r, c) for r in range(1, 4) for c in range(1, 6)}
    held = cells(masks.filled(df, ["key"], "p", 10, 12), "key")
    assert held == {k: s for k, p in shapes.items() if p and (s := {x for x in even_odd(p, 30) if 0 <= x[0] < 10 and 0 <= x[1] < 12})}


def test_unions_intersections_and_overlaps(spark):
    rng = np.random.default_rng(3)
    images = {k: rng.random((12, 15)) < 0.35 for k in range(6)}
    runs = to_runs(spark, images)
    sets = {k: set(zip(*map(lambda a: a.tolist(), np.nonzero(m)))) for k, m in images.items()}
    assert cells(runs, "key") == sets
    one = masks.united(runs.withColumn("half", F.col("key") % 2), ["half"])
    assert cells(one, "half") == {h: set().union(*(s for k, s in sets.items() if k % 2 == h)) for h in (0, 1)}
    a, b = (runs.where(f"key % 2 = {h}").withColumnRenamed("key", n).withColumn("image", F.lit(1)) for h, n in ((0, "a"), (1, "b")))
    got = {(r["a"], r["b"]): (r["shared"], r["iou"]) for r in masks.mask_ious(a, b, ["image"], "a", "b").collect()}
    assert got == {(i, j): (n, pytest.approx(n / len(sets[i] | sets[j]))) for i in (0, 2, 4) for j in (1, 3, 5) if (n := len(sets[i] & sets[j]))}
    moved = masks.shifted(runs, F.lit(-4), F.lit(9), 10, 16)
    assert cells(moved, "key") == {k: t for k, s in sets.items() if (t := {(r - 4, c + 9) for r, c in s if 0 <= r - 4 < 10 and 0 <= c + 9 < 16})}
    assert masks.shifted(runs, F.lit(0), F.lit(40), 10, 16).count() == 0 and masks.united(runs.where("false"), ["key"]).count() == 0


def test_polygons_meet_in_no_shuffle_but_their_own(spark, monkeypatch):
    """Rings of equal keys are one mask, whatever is scanned at a time; polygons that lie together by key are filled without a shuffle."""
    monkeypatch.setattr(masks, "CROSSINGS", 20)
    rng = np.random.default_rng(6)
    rings = [(int(k), [tuple(p) for p in rng.uniform(-3, 18, (int(rng.integers(3, 8)), 2)).round(1).tolist()]) for k in rng.integers(0, 12, 40)]
    rings += [(50, [(1.0, 1.0), (4.0, 1.0), (4.0, 3.0), (1.0, 3.0)]), (50, [(4.0, 1.0), (7.0, 1.0), (7.0, 3.0), (4.0, 3.0)]), (51, [(0.0, 0.0), (float("nan"), 5.0), (5.0, float("inf"))])]
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in p]) for k, p in rings], "key long, p array<struct<x: double, y: double>>")
    want = {}
    for k, p in rings[:-1]:
        want[k] = want.get(k, set()) ^ even_odd(p, 30)
    runs = masks.filled(df.repartition(3, "key"), ["key"], "p")
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert cells(runs, "key") == {k: s for k, s in want.items() if s}
    assert sorted((r["row"], r["start"], r["end"]) for r in runs.where("key = 50").collect()) == [(1, 1, 7), (2, 1, 7)]
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_tasks_of_mask_queries_grow_with_events(spark, monkeypatch):
    """Partitions of the union hold so many events, whatever the session's number of partitions is."""
    from pingframe.plans import masks as plans

    monkeypatch.setattr(plans, "TASK_EVENTS", 100)
    plan = plans.set02b(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count(", 10)") >= 2
    plan = plans.scl17(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(image#\d+L, row#\d+L, 10\)", plan)) == 2 and not re.findall(r"hashpartitioning\(event_id#\d+L, row#\d+L", plan)


def flooded(cells_):
    left, out = set(cells_), []
    while left:
        todo = [left.pop()]
        own = set(todo)
        while todo:
            r, c = todo.pop()
            near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            own |= near
            todo += near
        out.append(own)
    return out


def test_regions_are_those_of_a_flood(spark):
    rng = np.random.default_rng(4)
    images = {k: rng.random((20, 20)) < p for k, p in enumerate((0.1, 0.3, 0.5, 0.0, 1.0))}
    own = {}
    for r in masks.regions(to_runs(spark, images), ["key"]).collect():
        own.setdefault((r["key"], r["first_row"], r["first_col"]), set()).update((r["row"], c) for c in range(r["start"], r["end"]))
    want = {(k, *min(s)): s for k, m in images.items() for s in flooded(zip(*map(lambda a: a.tolist(), np.nonzero(m))))}
    assert own == want


def turned_square(angle, length, width, centre=(60.0, 60.0), n=120):
    """Cells of a rectangle whose longer side points `angle` degrees from the columns to the rows."""
    r, c = np.mgrid[:n, :n]
    x, y, t = c - centre[1], r - centre[0], math.radians(angle)
    return (np.abs(x * math.cos(t) + y * math.sin(t)) <= length / 2) & (np.abs(y * math.cos(t) - x * math.sin(t)) <= width / 2)


def test_rectangles(spark, monkeypatch):
    """Sides, area and direction of turned rectangles, a single cell, lines, and the smallest over all directions by brute force."""
    monkeypatch.setattr(masks, "BLOCK_ROWS", 7)
    images = {a: turned_square(a, 61, 23) for a in (0, 12, 45, 78, 90, 150)}
    one, line, slope = (np.zeros((9, 9), bool) for _ in range(3))
    one[4, 5] = True
    line[2, 1:8] = True
    slope[range(7), range(7)] = True
    rng = np.random.default_rng(5)
    images |= {1000: one, 1001: line, 1002: slope} | {2000 + k: rng.random((15, 11)) < 0.2 for k in range(8)}
    got = {r["key"]: r for r in masks.measured(to_runs(spark, images), ["key"], 0.1).collect()}
    for a in (0, 12, 45, 78, 90, 150):
        r = got[a]
        assert r["length_m"] == pytest.approx(6.2, abs=0.15) and r["width_m"] == pytest.approx(2.4, abs=0.15) and r["area_m2"] == pytest.approx(0.01 * images[a].sum())
        assert abs((r["angle_deg"] - a + 90) % 180 - 90) < 2 and r["centroid_row"] == pytest.approx(60) and r["centroid_col"] == pytest.approx(60)
    assert (got[1000]["length_m"], got[1000]["width_m"], got[1000]["centroid_row"]) == (pytest.approx(0.1), pytest.approx(0.1), 4)
    assert (got[1001]["length_m"], got[1001]["width_m"], got[1001]["angle_deg"]) == (pytest.approx(0.7), pytest.approx(0.1), 0)
    assert (got[1002]["length_m"], got[1002]["width_m"], got[1002]["angle_deg"]) == (pytest.approx(0.1 * (6 * 2**0.5 + 1)), pytest.approx(0.1), 45)
    for k, m in images.items():
        if k < 2000:
            continue
        p = np.argwhere(m)[:, ::-1].astype(float)
        best = min(np.ptp(p @ [math.cos(t), math.sin(t)]) * np.ptp(p @ [-math.sin(t), math.cos(t)]) for t in np.radians(np.arange(0, 90, 0.02)))
        area = (got[k]["length_m"] * 10 - 1) * (got[k]["width_m"] * 10 - 1)
        assert area <= best + 1e-6 and area == pytest.approx(best, rel=2e-3)
        box = np.array([(c["col"], c["row"]) for c in got[k]["corners"]])
        edge = np.roll(box, -1, 0) - box
        turn = edge[None, :, 0] * (p[:, None, 1] - box[None, :, 1]) - edge[None, :, 1] * (p[:, None, 0] - box[None, :, 0])
        assert (turn >= -1e-6).all()


def test_directions_depths_and_footprints(spark):
    """The direction follows the heading; what is missing is null; the footprint is clockwise around the centre."""
    images = {0: turned_square(78, 61, 23), 1: turned_square(78, 61, 23, (60.0, 20.0)), 2: turned_square(0, 9, 5), 3: turned_square(0, 9, 5)}
    runs = to_runs(spark, images)
    pings = [(k, r, {0: 0.0, 1: 90.0, 2: None, 3: 350.0}[k], 10.0, None if k == 3 else 8.2, 13.0 + (k != 1) * r * 1e-6, 80.0 + (k == 1) * r * 1e-6) for k in images for r in range(120)]
    nav = spark.createDataFrame(pings, "key long, row long, heading_deg double, sensor_depth_m double, altitude_m double, lat double, lon double")
    got = {r["key"]: r for r in masks.placed(masks.measured(runs, ["key"], 0.1), nav, ["key"], "key", 30.0, 0.1).collect()}
    assert got[0]["orientation_deg"] == pytest.approx(12, abs=2) and got[1]["orientation_deg"] == pytest.approx(102, abs=2) and got[2]["orientation_deg"] is None
    assert got[3]["orientation_deg"] == pytest.approx(80) and got[0]["depth_m"] == pytest.approx(18.2) and got[3]["depth_m"] is None
    assert got[0]["side"] == "starboard" and got[0]["ground_range_m"] == pytest.approx(3.0) and got[1]["side"] == "port" and got[2]["lat"] is None and got[2]["footprint"] is None
    for k in (0, 1, 3):
        ring = np.array(got[k]["footprint"])
        x, y = (ring[:, 1] - got[k]["lon"]) * math.cos(math.radians(13)), ring[:, 0] - got[k]["lat"]
        assert ring.shape == (4, 2) and (x * np.roll(y, -1) - np.roll(x, -1) * y < 0).all()


def test_heat_in_masks(spark):
    rng = np.random.default_rng(6)
    heat = rng.random((10, 12)) * 4
    images = {k: rng.random((10, 12)) < 0.3 for k in range(3)}
    rows = spark.createDataFrame([(0, r, c, float(heat[r, c])) for r in range(10) for c in range(12)], "image long, r long, c long, h double")
    runs = to_runs(spark, images).withColumn("image", F.lit(0).cast("long"))
    got = {r["key"]: r for r in masks.heat_in_masks(rows, runs, ["image"], ["image", "key"], "r", "c", "h", 1.5).collect()}
    for k, m in images.items():
        assert got[k]["mean_share"] == pytest.approx(min(1, heat[m].mean() / 3)) and got[k]["max_share"] == pytest.approx(min(1, heat[m].max() / 3))
