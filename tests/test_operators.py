"""Hand-checked values, validation and streams."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pingframe.functions import geo, score
from pingframe.operators import catalogue, evaluation, filters, merging, ranking, raster, series, similarity, spatial
from pingframe.operators.graph import connected
from pingframe.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("bad", [dict(classes="boat"), dict(min_conf=-1), dict(max_conf=101), dict(min_conf=60, max_conf=50), dict(tier="high"), dict(review_status="open"), dict(flags="WET"), dict(bbox="1,2,3"), dict(bbox="5,1,4,2"), dict(sort="size")])
def test_invalid_queries(bad):
    with pytest.raises(filters.Refused):
        filters.Wanted.of(**bad)


def test_empty_lists_restrict_nothing():
    assert filters.Wanted.of(classes=" , ", tier="", bbox=None).held == {}


def test_url_parameters_are_held_in_their_domains():
    q = filters.Wanted.of_url("class=pipe,boat&min_conf=-5&max_conf=x&sort=-area&bbox=9,9&tier=none")
    assert q.held == {"class": ("pipe",), "min_conf": 0.0} and q.sort == "-area"
    assert filters.Wanted.of_url(q.url()) == q


def test_scope_and_page_bounds(spark):
    with pytest.raises(filters.Refused):
        filters.scoped(spark.range(1), "some")
    with pytest.raises(filters.Refused):
        filters.page(spark.range(1), filters.Wanted(), 0, 5001)


def test_day_bounds():
    low, high = filters.day_bounds("2024-01-01", "2024-01-01")
    assert (high - low).days == 1
    assert filters.day_bounds(None, "2024-01-01T00:00:00Z")[1].second == 1
    with pytest.raises(filters.Refused):
        filters.day_bounds("2024-01-02", "2024-01-01")
    assert filters.literal_pattern("50%_\\") == "%50\\%\\_\\\\%"


@pytest.mark.parametrize("n, want", [(300, [(0, 100), (80, 180), (160, 260), (240, 300)]), (100, [(0, 100)]), (0, [])])
def test_chunks(spark, n, want):
    rows = series.chunks(spark.createDataFrame([(n,)], "n int"), "n", 100, 20).orderBy("start").collect()
    assert [(r["start"], r["stop"]) for r in rows] == want


def test_tiles():
    assert raster.tile_starts(1500, 640, 0.25) == [0, 480, 860]
    assert raster.tile_starts(100, 640, 0.25) == [0]


@pytest.mark.parametrize("conf, anomaly, want", [(79.99, 0.97, "review"), (80, 0.1, "hazard"), (93, 1, "hazard"), (50, 0.8, "review"), (49.99, 0.51, "anomaly"), (44, 0.49, "hidden"), (30, 0.5, "anomaly"), (29.99, 1, "hidden")])
def test_tiers(spark, conf, anomaly, want):
    assert one(spark, score.tier(F.lit(float(conf)), F.lit(float(anomaly)))) == want


def test_fused(spark):
    parts = [(F.lit(1.0), 0.5), (F.lit(None).cast("double"), 0.3), (F.lit(0.5), 0.5)]
    assert one(spark, score.fused(parts, [F.lit(0.05), F.lit(None).cast("double")])) == pytest.approx(0.7)
    assert one(spark, score.fused([(F.lit(None).cast("double"), 1.0)], [])) == 0


@pytest.mark.parametrize("lon, lat, want", [(7.5, 46.9, 32632), (-58.4, -34.6, 32721), (179.9, 10.0, 32660), (-179.9, -10.0, 32701), (12.0, 84.5, None)])
def test_utm(spark, lon, lat, want):
    assert one(spark, geo.utm_epsg(F.lit(lat), F.lit(lon))) == want


def test_dms(spark):
    assert one(spark, geo.dms(F.lit(13.084120), "N", "S")) == "13° 05' 02.83\" N"
    assert one(spark, geo.dms(F.lit(10.999999), "E", "W")) == "11° 00' 00.00\" E"


def test_layback(spark):
    assert one(spark, F.round(geo.layback(F.lit(100.0), F.lit(20.0)), 2)) == 97.98
    assert one(spark, geo.layback(F.lit(0.0), F.lit(20.0))) is None
    assert one(spark, geo.layback(F.lit(10.0), F.lit(20.0))) == 0


def test_uncertainty(spark):
    none = F.lit(None).cast("double")
    assert one(spark, geo.uncertainty(none, none, none, none, F.lit(False), 0.0)) == 2.0
    want = round(math.sqrt(4 + (50 * math.sin(math.radians(2))) ** 2), 2)
    assert one(spark, geo.uncertainty(F.lit(50.0), none, none, none, F.lit(False), 0.0)) == want


def test_closed_ring(spark):
    square = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])
    ring = one(spark, geo.closed_ring(square))
    assert len(ring) == 5 and ring[0] == ring[-1]
    assert sum(p["lon"] * q["lat"] - q["lon"] * p["lat"] for p, q in zip(ring, ring[1:])) > 0


def test_runs(spark):
    rows = spark.createDataFrame([(0, i, bool(f)) for i, f in enumerate([1, 1, 0, 0, 1, 1, 1, 0])], "line int, ping int, f boolean")
    got = series.runs(rows, F.col("f"), ["line"], "ping").orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0, 1), (4, 6)]


def test_interpolation_ends(spark):
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])], "line int, ping int, v double")
    held = [r["o"] for r in series.interpolated(rows, "v", "ping", ["line"], "o").orderBy("ping").collect()]
    run_on = [r["o"] for r in series.interpolated(rows, "v", "ping", ["line"], "o", True).orderBy("ping").collect()]
    assert held == [1, 1, 2, 3, 3] and run_on == [0, 1, 2, 3, 4]


def test_heading_crosses_north(spark):
    rows = spark.createDataFrame([(0, i, h) for i, h in enumerate([359.0, 1.0, 359.0, 1.0, None])], "line int, ping int, h double")
    got = [r["heading_smooth"] for r in series.smoothed_heading(rows, "h", ["line"], "ping", 3).collect()]
    assert all(min(x, 360 - x) < 1.1 for x in got)


def test_clusters(spark):
    def found(offsets, files, classes="aaa", conf=(50.0, 40.0, 50.0)):
        rows = [(i, f"D{i + 1}", classes[i], conf[i], files[i], 13.0 + m / 111195.0, 80.0) for i, m in enumerate(offsets)]
        kinds = "event_id long, detection_id string, cls string, confidence double, source_file string, lat double, lon double"
        return spatial.clustered(spark.createDataFrame(rows, kinds)).orderBy("detection_id").collect()

    merged = found([0, 3.5, 6.5], "xyz", conf=(20.0, 70.0, 70.0))
    assert len(merged) == 1 and merged[0]["detection_id"] == "D2" and merged[0]["n_views"] == 3 and merged[0]["persistence"] == 0.875
    assert len(found([0, 6.5], "xy")) == 2
    assert len(found([0, 2], "xx")) == 2
    assert len(found([0, 2], "xy", "ab")) == 2


def test_connected(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and len(got) == 43
    assert connected(links.limit(0)).count() == 0


def test_isotonic(spark):
    rows = spark.createDataFrame([(0, x, y, i) for i, (x, y) in enumerate(zip((0.05, 0.3, 0.4, 0.75, 0.9), (0, 1, 1, 0, 1)))], "g int, x double, y int, i int")
    assert [r["fitted"] for r in evaluation.isotonic(rows, ["g"], "x", "y", "i").orderBy("x").collect()] == pytest.approx([0, 2 / 3, 2 / 3, 2 / 3, 1])


def test_ranking_metrics(spark):
    rows = spark.createDataFrame([(0, s, y, i) for i, (s, y) in enumerate([(0.2, 0), (0.6, 0), (0.5, 1), (0.9, 1), (0.1, 0)])], "g int, s double, y int, i int")
    assert evaluation.auroc(rows, ["g"], "s", "y").first()["auroc"] == pytest.approx(5 / 6)
    assert evaluation.auroc(rows.where("y = 1"), ["g"], "s", "y").first()["auroc"] is None
    three = spark.createDataFrame([(0, 0.95, 0, 1), (0, 0.6, 1, 2), (0, 0.5, 1, 3)], "g int, s double, y int, i int")
    assert evaluation.average_precision_101(three, ["g"], "s", "y", "i").first()["ap"] == pytest.approx(2 / 3)
    assert evaluation.average_precision(three, ["g"], "s", "y", "i").first()["ap"] == pytest.approx((1 / 2 + 2 / 3) / 2)


def test_greedy_takes_the_free_best(spark):
    pairs = spark.createDataFrame([(0, 1, 10, 0.9, 0.6), (0, 2, 10, 0.8, 0.9), (0, 2, 11, 0.8, 0.5), (0, 3, 11, 0.7, 0.9)], "g int, p int, t int, conf double, iou double")
    got = evaluation.greedy_matches(pairs, ["g"], "p", "t", ["conf", "p"], "iou").orderBy("p").collect()
    assert [(r["p"], r["t"]) for r in got] == [(1, 10), (2, 11)]


def test_splits_keep_sites_whole():
    got = evaluation.splits([("a", 60), ("b", 20), ("c", 15), ("d", 5)], {"train": 0.7, "val": 0.2, "test": 0.1})
    assert set(got) == set("abcd") and got["a"] == "train"


def test_correlated(spark):
    base = [math.sin(i) for i in range(32)]
    rows = spark.createDataFrame([(1, base), (2, [2 * x + 5 for x in base]), (3, base[::-1]), (4, [0.0] * 32)], "id long, v array<double>")
    assert [(r["a"], r["b"]) for r in similarity.correlated(rows, 0.97).collect()] == [(1, 2)]


def test_coreset(spark):
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(11)], "id long, v array<double>")
    assert [r["id"] for r in raster.coreset(rows, 3).orderBy("rank").collect()] == [0, 10, 5]


def test_next_id_and_slug(spark):
    ids = spark.createDataFrame([("SRV-002",), ("SRV-x",), ("SRV-041",)], "i string")
    assert catalogue.next_id(ids, "i", "SRV-").first()[0] == "SRV-042"
    assert one(spark, catalogue.slug(F.lit("  Bay / Line 7! "))) == "bay-line-7"
    assert one(spark, catalogue.slug(F.lit("!!"))) == "default"
    assert one(spark, catalogue.safe_name(F.lit("../../etc/pass wd"))) == "pass_wd"


def test_delete_is_refused_while_running(spark):
    tables = {"survey": spark.createDataFrame([(1, "running"), (2, "done")], "survey_key long, status string")}
    with pytest.raises(ValueError):
        catalogue.without_survey(tables, 1)
    assert catalogue.without_survey(tables, 2)["survey"].count() == 1


def test_replay_stops_at_the_end(spark):
    rows = spark.createDataFrame([(1, 1, "progress"), (1, 2, "done"), (1, 3, "progress"), (1, 2, "done")], "job_id long, seq long, type string")
    assert sorted(r["seq"] for r in jobs.replayed(rows, 0).collect()) == [1, 2]


def test_stream_fold_restarts_without_loss(spark, tmp_path):
    kinds = "job_id long, seq long, type string, detection_key long, value double"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([(1, 1, "detection", 5, 1.0), (1, 2, "detection", 6, 2.0), (2, 1, "progress", None, 0.0)], kinds).coalesce(1).write.parquet(src)
    jobs.folded(jobs.read_events(spark, src, kinds), out, ck)
    spark.createDataFrame([(1, 2, "detection", 6, 9.0), (1, 3, "detection_removed", 5, 0.0), (1, 4, "detection_update", 6, 3.0)], kinds).coalesce(1).write.mode("append").parquet(src)
    jobs.folded(jobs.read_events(spark, src, kinds), out, ck)
    got = sorted((r["seq"], r["action"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, "insert"), (2, "insert"), (3, "delete"), (4, "update")]


def test_savitzky_golay_keeps_parabolas(spark):
    rows = spark.createDataFrame([(0, i, 2.0 + 3.0 * i - 0.5 * i * i) for i in range(40)] + [(1, i, float(i * i)) for i in range(9)] + [(2, 0, 7.0)], "line int, ping int, v double")
    got = {(r["line"], r["ping"]): r["smooth"] for r in series.savitzky_golay(rows, "v", "ping", ["line"], 31, 2).collect()}
    assert all(got[(r["line"], r["ping"])] == pytest.approx(r["v"], abs=1e-6) for r in rows.collect())


def test_first_fit_and_confusion(spark):
    from pingframe.operators import matching

    pairs = spark.createDataFrame([(1, 2, 3, 0.6), (1, 2, 5, 0.9), (1, 4, 3, 0.9), (1, 4, 7, 0.1)], "survey_id long, truth long, prediction long, iou double")
    found = matching.first_fits(pairs, 0.5)
    assert [(r["truth"], r["prediction"]) for r in found.collect()] == [(2, 3)]
    boxes = spark.createDataFrame([(2, "a"), (4, "b"), (3, "a"), (5, "c")], "event_id long, cls string")
    got = {(r["truth_cls"], r["prediction_cls"]): r["n"] for r in matching.confusion(boxes, found).collect()}
    assert got == {("a", "a"): 1, ("b", "missed"): 1, ("background", "c"): 1}


def test_near_pairs_at_cell_borders(spark):
    import random

    random.seed(4)
    pts = [(i, 59.0999 + random.random() * 4e-4, -0.0002 + random.random() * 4e-4, "a") for i in range(120)]
    got = {(r["a"], r["b"]) for r in spatial.near_pairs(spark.createDataFrame(pts, "id long, lat double, lon double, cls string"), 5.0, ["cls"]).collect()}

    def metres(p, q):
        a = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(a)))

    assert got == {(p[0], q[0]) for p in pts for q in pts if p[0] < q[0] and metres(p, q) <= 5.0}


def test_box_overlaps_match_all_pairs(spark):
    import random

    from pingframe.operators import merging

    random.seed(5)
    boxes = []
    for i in range(150):
        p, x = random.randrange(0, 300), random.uniform(-40, 40)
        boxes.append((i, i % 2, p, p + random.randrange(0, 90), x, x + random.uniform(0.5, 30)))
    got = {(r["a"], r["b"]) for r in merging.overlaps(spark.createDataFrame(boxes, "event_id long, cls int, ping_start long, ping_end long, across_start double, across_end double"), ["cls"]).collect()}
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3] and a[4] < b[5] and b[4] < a[5]}
    assert got == want


def test_calibrator_lookup(spark):
    f = lambda v: one(spark, evaluation.looked_up(F.lit(v), [0.2, 0.6], [0.1, 0.9]))
    assert f(0.0) == 0.1 and f(0.4) == pytest.approx(0.5) and f(1.0) == 0.9
    assert one(spark, evaluation.looked_up(F.lit(0.3), [], [])) == 0.3


def test_a_dropped_box_drops_no_other(spark):
    """B outweighs C and A outweighs B; A and C are apart: A and C stay, as C's only rival is gone."""
    rows = [(1, 0, 0, 9, 0.0, 10.0, 50.0, 0, 100), (2, 1, 0, 9, 4.0, 14.0, 90.0, -60, 40), (3, 0, 0, 9, 8.0, 18.0, 40.0, -94, 12), (4, 0, 0, 9, 8.0, 18.0, 30.0, -94, 12)]
    kinds = "event_id long, chunk_id int, ping_start int, ping_end int, across_start double, across_end double, confidence double, chunk_start int, chunk_end int"
    boxes = spark.createDataFrame(rows, kinds).withColumn("survey_id", F.lit(1)).withColumn("cls", F.lit("pipe"))
    margins = {r["event_id"]: r["margin"] for r in merging.edge_margin(boxes).collect()}
    assert margins == {1: 4.5, 2: 35.5, 3: 7.5, 4: 7.5}
    assert sorted(r["event_id"] for r in merging.kept_across_chunks(boxes, 0.3).collect()) == [2]
    weak = boxes.withColumn("chunk_start", F.when(F.col("event_id") == 2, F.lit(2)).otherwise(F.col("chunk_start")))  # margin 2.5: now the last
    assert sorted(r["event_id"] for r in merging.kept_across_chunks(weak, 0.3).collect()) == [1, 3, 4]


def test_links_over_many_rounds(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(1000, 1001)], "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in connected(links, chunk=10).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[1001] == 1000 and len(got) == 63


def test_places_and_percentiles(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=5000)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double").repartition(5)
    got = {r["i"]: r["place"] for r in ranking.placed(rows, [F.col("v"), F.col("i")], "place").collect()}
    assert [got[i] for i in np.argsort(x)] == list(range(1, 5001))
    assert ranking.placed(rows.limit(0), [F.col("i")], "place").count() == 0
    exact = ranking.percentiles(rows, "v", {"a": 0.5, "b": 0.995, "c": 0.0}).first()
    assert [exact["a"], exact["b"], exact["c"]] == pytest.approx(list(np.percentile(x, [50, 99.5, 0])), abs=1e-12)
    assert ranking.percentiles(rows.limit(0), "v", {"a": 0.5}).first()["a"] is None


def test_isotonic_over_several_ranges(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.round(rng.uniform(size=120), 2)
    y = (rng.uniform(size=120) < x).astype(int)
    order = np.lexsort((np.arange(120), x))
    fit = y[order].astype(float)
    want = np.array([max(min(fit[j : k + 1].mean() for k in range(i, 120)) for j in range(i + 1)) for i in range(120)])
    rows = spark.createDataFrame([(g, float(a), int(b), i) for g in (0, 1) for i, (a, b) in enumerate(zip(x, y))], "g int, x double, y int, i int")
    got = evaluation.isotonic(rows, ["g"], "x", "y", "i", size=30).where("g = 1").toPandas().sort_values(["x", "i"])
    assert np.allclose(got["fitted"].to_numpy(), want)


def test_ranks_over_bins_equal_plain_ranks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    s, y = np.round(rng.uniform(size=500), 2), rng.integers(0, 2, 500)
    rows = spark.createDataFrame([(0, float(a), int(b), i) for i, (a, b) in enumerate(zip(s, y))], "g int, s double, y int, i int")
    hits = y[np.lexsort((np.arange(500), -s))]
    precision = np.cumsum(hits) / np.arange(1, 501)
    assert evaluation.average_precision(rows, ["g"], "s", "y", "i").first()["ap"] == pytest.approx(precision[hits == 1].mean())
    recall = np.cumsum(hits) / hits.sum()
    best = [precision[recall >= g / 100 - 1e-12].max(initial=0) for g in range(101)]
    assert evaluation.average_precision_101(rows, ["g"], "s", "y", "i").first()["ap"] == pytest.approx(np.mean(best))


def test_splits_try_all_ways():
    from itertools import product

    sites, shares = [("a", 50), ("b", 30), ("c", 9), ("d", 7), ("e", 4)], {"train": 0.7, "val": 0.2, "test": 0.1}
    got = evaluation.splits(sites, shares)
    cost = lambda way: sum((sum(n for (s, n), k in zip(sites, way) if k == name) / 100 - share) ** 2 for name, share in shares.items())
    assert cost([got[s] for s, _ in sites]) == pytest.approx(min(cost(w) for w in product(shares, repeat=5) if len(set(w)) == 3))
    assert evaluation.splits(sites, shares, {"e": 1, "d": 2}) | {} and {evaluation.splits(sites, shares, {"e": 1, "d": 2})[s] for s in "de"} == {"val", "test"}
    assert evaluation.splits(sites, shares, not_train=frozenset("a"))["a"] != "train"
    with pytest.raises(ValueError):
        evaluation.splits(sites[:2], shares)
    many = evaluation.splits([(f"s{i:02d}", 20 - i) for i in range(12)], shares)
    assert [many[f"s{i:02d}"] for i in range(3)] == ["train", "val", "test"] and len(many) == 12


def test_correlated_blocks_lose_no_pair(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(similarity, "BLOCK", 8)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((5, 64))
    x = np.concatenate([b + 0.12 * rng.standard_normal((20, 64)) for b in base])
    z = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    want = {(i, j) for i in range(100) for j in range(i + 1, 100) if z[i] @ z[j] / 64 >= 0.97}
    rows = spark.createDataFrame([(i, i % 2, [float(v) for v in r]) for i, r in enumerate(x)], "id long, split int, v array<double>")
    assert {(r["a"], r["b"]) for r in similarity.correlated(rows, 0.97).collect()} == want and len(want) > 100
    assert {(r["a"], r["b"]) for r in similarity.correlated(rows, 0.97, "split").collect()} == {(a, b) for a, b in want if a % 2 != b % 2}


def test_correlated_at_any_threshold_and_size(spark, monkeypatch):
    """Keys follow the threshold, so weaker pairs are found as well; copies meet in blocks, and each pair comes once for each row of its ids."""
    import numpy as np

    monkeypatch.setattr(similarity, "BLOCK", 8)
    monkeypatch.setattr(similarity, "PAIRS", 16)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((6, 24)).repeat(20, axis=0) + 0.7 * rng.standard_normal((120, 24)), np.tile(rng.standard_normal(24), (30, 1)), np.full((1, 24), np.nan)])
    z = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    ids = [*range(150), 999]
    want = sorted((a, b) for a in range(150) for b in range(a + 1, 150) if z[a] @ z[b] / 24 >= 0.6)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + [(None, [0.0, 1.0] * 12)], "id long, v array<double>")
    assert sorted((r["a"], r["b"]) for r in similarity.correlated(rows, 0.6).collect()) == want and len(want) > 600
    twice = rows.where("id >= 118").unionByName(rows.where("id = 120"))
    expected = sorted([p for p in want if p[0] >= 118] + [p for p in want if p[0] >= 118 and 120 in p])
    assert sorted((r["a"], r["b"]) for r in similarity.correlated(twice, 0.6).collect()) == expected
    for rows_, least in ((100, 0.97), (10_256, 0.97), (615_384, 0.97), (10**7, 0.97), (10**6, 0.5), (10**6, 1.0), (0, 0.97)):
        keys, signs = similarity.key_shape(rows_, least)
        same = min(0.99, 1 - math.acos(least) / math.pi)
        assert 1 <= keys <= similarity.KEYS and (1 - same**signs) ** keys <= 2e-7 and (least < 0.9 or rows_ / 2**signs <= similarity.LIST)


def test_bright_targets_and_regions():
    import numpy as np

    from pingframe.operators import detectors

    grey = np.full((80, 120), 20.0)
    grey[10:15, 30:36] = 240  # a target
    grey[60, 60] = 250  # a speck
    grey[40:44, 80:84] = grey[44:48, 84:88] = 200  # two that touch at a corner
    assert [(b[2:6], b[6]) for b in detectors.bright_targets(grey)] == [((30, 10, 36, 15), 30), ((80, 40, 88, 48), 32)]
    assert detectors.bright_targets(grey)[0][:2] == ("debris_other", 0.6)
    assert detectors.bright_targets(np.zeros((0, 5))) == [] and detectors.bright_targets(np.full((3, 3), 9.0)) == []
    assert len(detectors.regions(np.eye(4, dtype=bool))) == 1


def test_a_bad_tile_is_passed_over(spark):
    from pingframe.operators import detectors

    def find(grey):
        if grey.max() > 90:
            raise RuntimeError("too bright")
        return [("pipe", 0.5, 0, 0, 2, 1, 2)]

    rows = spark.createDataFrame([(k, r, [float(90 * k * (r > 3) + c) for c in range(6)]) for k in range(2) for r in range(6)], "line int, row long, v array<double>")
    got = detectors.detected(detectors.tiled(rows, ["line"], "row", "v", 4, 0.25), ["line"], "row", find).orderBy("line", "tile_row", "tile_col").collect()
    assert [(r["line"], r["tile_row"], r["tile_col"], r["skipped"]) for r in got] == [(0, 0, 0, False), (0, 0, 2, False), (0, 2, 0, False), (0, 2, 2, False), (1, 0, 0, False), (1, 0, 2, False), (1, 2, 0, True), (1, 2, 2, True)]
    assert got[3]["x1"] == 2 and got[3]["y1"] == 2 and got[6]["error"] == "RuntimeError: too bright"
    assert detectors.detected(detectors.tiled(rows.limit(0), ["line"], "row", "v", 4, 0.25), ["line"], "row", find).count() == 0
    detectors.register("own", find)
    assert detectors.detector() is find and detectors.detector("bright") is detectors.bright_targets
    with pytest.raises(ValueError):
        detectors.detector("none")
    del detectors._known["own"]


def test_tile_exports(spark):
    import json

    from pingframe.operators import detectors

    rows = spark.createDataFrame([("a", r, 100 + r, [float(c) for c in range(6)], r < 3, 13.0 + r * 1e-5 if r < 5 else None, 80.0, 0.0) for r in range(6)], "line string, row long, ping long, v array<double>, masked boolean, lat double, lon double, heading_deg double")
    got = detectors.tile_exports(rows, ["line"], 3, 1.0, 4, 0.25, 0.7).orderBy("tile").collect()
    assert [r["name"] for r in got] == ["a_t0002", "a_t0003"] and got[1]["pixels"][0] == [2, 3, 4, 5]  # the upper tiles are masked by three quarters
    about = json.loads(got[0]["about"])
    assert (about["ping_start"], about["ping_end"], about["tile"]) == (102, 105, {"index": 2, "row": 2, "col": 0, "size": 4}) and "corners_latlon" not in about
    placed = json.loads(detectors.tile_exports(rows.where("row < 5"), ["line"], 3, 1.0, 5, 0.0, 1.0).orderBy("tile").first()["about"])["corners_latlon"]
    assert placed[0][0] == 13.0 and placed[2][0] == 13.00004 and placed[0][1] < 80 < placed[1][1]


def test_speed_gate_against_a_plain_walk():
    """Tracks with jumps of any length, among them ones that last: what stays is what a walk of one fix at a time keeps."""
    import numpy as np

    from pingframe.operators.series import _metres, _reached

    rng = np.random.default_rng(4)
    for n in (1, 2, 50, 400):
        places = np.radians(np.cumsum(rng.normal(0, 2e-5, (n, 2)), axis=0) + [13, 80])
        for k in rng.integers(0, n, n // 6):
            places[k : k + int(rng.integers(1, 40))] += rng.normal(0, 1e-3)
        seconds = np.cumsum(rng.integers(0, 3, n)).astype(float)
        kept = [0]
        for i in range(1, n):
            if _metres(*places[kept[-1]], *places[i]) <= 6 * abs(seconds[i] - seconds[kept[-1]]) + 5:
                kept.append(i)
        assert _reached(places, seconds, 6.0, 5.0).tolist() == kept


def test_speed_gate_of_fixes_anywhere(spark):
    """Fixes out of range stay where the caller wants them; of two that are equally near the median the first is the anchor."""
    rows = spark.createDataFrame([(1, i, 1013.0 + i * 1e-5, 80.0, float(i)) for i in range(4)] + [(2, 0, 4014.2373, 80.0, 0.0), (2, 1, 4014.7373, 80.0, 1.0)], "line int, ping int, lat double, lon double, t double")
    assert series.speed_gate(rows, ["line"], "ping", "t").where("accepted").count() == 0
    got = series.speed_gate(rows, ["line"], "ping", "t", anywhere=True).where("accepted").orderBy("line", "ping").collect()
    assert [(r["line"], r["ping"]) for r in got if r["line"] == 1] == [(1, i) for i in range(4)] and sum(r["line"] == 2 for r in got) == 1


def test_speed_gate_starts_where_sql_starts():
    """The anchor of tracks of even numbers of fixes, of which two are equally near the median, is what the formula in plain steps gives."""
    import duckdb
    import numpy as np

    from pingframe.operators.series import _middle
    from pingframe.plans.navigation import HAV

    con, differs = duckdb.connect(), 0
    far = HAV.replace("{a}", "m.").replace("{b}", "g.")
    for start in (13.0, 1013.0, 4014.237, 5014.241):
        for n in range(2, 60, 2):
            places = np.array([[start + i * 1e-5, 80.0 + i % 3 * 1e-6] for i in range(n)])
            con.execute("CREATE OR REPLACE TABLE g AS SELECT * FROM (VALUES " + ", ".join(f"({i}, {float(a)!r}::DOUBLE, {float(b)!r}::DOUBLE)" for i, (a, b) in enumerate(places)) + ") AS x(ping, lat, lon)")
            want = con.execute(f"SELECT arg_min(ping, ({far}, ping)) FROM g, (SELECT median(lat) AS lat, median(lon) AS lon FROM g) m").fetchall()[0][0]
            differs += _middle(places) != want
    assert not differs


def test_directions_that_cancel_out(spark):
    """Halfway between two directions that mirror each other at north: what SQL's sine and cosine give, 0 or next to 360."""
    rows = [(i, at, v) for i in range(1, 90) for at, v in ((0, float(i)), (1, None), (2, float(360 - i)))]
    got = series.interpolated_angle(spark.createDataFrame(rows, "line int, at int, v double"), "v", "at", ["line"], "out").where("v is null").orderBy("line").collect()
    for r in got:
        a, b = (math.radians(x) for x in (r["line"], 360 - r["line"]))
        s, c = (f(a) + (f(b) - f(a)) / 2 for f in (math.sin, math.cos))
        turn = math.degrees(math.atan2(s, c))
        assert r["out"] == turn - 360 * math.floor(turn / 360)


def test_no_frame_starts_anew_for_each_row(spark):
    """What lies ahead of a row comes from a walk from the end: a frame that ends at the last row costs the square of a line or survey."""
    from pyspark.sql.window import Window

    from pingframe.plans import registry

    def anew(df):
        frames = re.findall(r"specifiedwindowframe\(\w+, ([^,]+), ([^)]+)", df._jdf.queryExecution().optimizedPlan().toString())
        return [f for f in frames if f[1].startswith("unboundedfollowing") and not f[0].startswith("unboundedpreceding")]

    assert anew(spark.range(3).select(F.min("id").over(Window.partitionBy().orderBy("id").rowsBetween(1, Window.unboundedFollowing))))
    for name in ("flt16_next_pending", "int01_extrapolated_lon", "jn13_events_on_track", "agg16_average_precision_101"):
        assert not anew(registry.QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_nearest_against_all_pairs(spark, monkeypatch):
    """Dense and empty places, a crowd far from who asks, equal places, high latitudes and the date line; the pairs that meet stay few."""
    import numpy as np

    from pingframe.operators.series import _metres

    rng = np.random.default_rng(8)
    crowd = np.concatenate([rng.normal([13, 80], 2e-4, (300, 2)), rng.normal([13.01, 80], 1e-6, (300, 2)), [[13.02, 80.0]] * 40, rng.normal([84, 179.9999], [1e-4, 1e-3], (60, 2))])
    asks = np.concatenate([rng.normal([13, 80], 3e-4, (60, 2)), rng.normal([13.01, 80.0003], 1e-6, (40, 2)), [[13.02, 80.0001]] * 3, rng.normal([84, -179.9999], [1e-4, 1e-3], (40, 2))])
    frame = lambda rows: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rows)] + [(9000, None, 1.0), (9001, 1.0, None)], "id long, lat double, lon double")
    got = {r["id"]: (r["nearest_id"], r["metres"]) for r in merging.nearest(frame(asks), frame(crowd), 50.0).collect()}
    for i, (a, b) in enumerate(np.radians(asks)):
        far = _metres(a, b, *np.radians(crowd).T)
        assert (i in got) == (far.min() <= 50)
        if i in got:
            assert got[i][1] == pytest.approx(far.min(), abs=1e-6) and far[got[i][0]] == pytest.approx(far.min(), abs=1e-6)
    assert all(got[i][0] == 600 for i in (100, 101, 102))
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(merging, "haversine", lambda *a: F.udf(lambda *v: (seen.add(1), float(_metres(*np.radians([v[0], v[1], v[2], v[3]]))))[1], "double")(*a))
    merging.nearest(frame(asks), frame(crowd), 50.0).collect()
    assert seen.value < 60 * len(asks)  # cells of 100 m gave over 120 pairs for each


def test_merged_boxes_meet_those_beside_them(spark):
    """1,500 boxes of one image, a few of them wide: each is held against a few others, and what comes out is what a walk over all kept gives."""
    import numpy as np

    rng = np.random.default_rng(12)
    at, size = rng.random((1500, 2)) * 300, rng.random((1500, 2)) * 4 + 1
    size[::300] *= 400
    boxes = [(1, "pipe", *map(float, (x, y, x + w, y + h)), float(s)) for (x, y), (w, h), s in zip(at, size, rng.random(1500).round(2), strict=True)]
    out = []
    for b in sorted(boxes, key=lambda b: (-b[6], b[2:6])):
        now = [*b[2:], 1]
        while (k := next((k for k, o in enumerate(out) if merging._meets(now, o, 0.5, 0.7)), None)) is not None:
            o = out.pop(k)
            now = [*(f(x, y) for f, x, y in zip((min, min, max, max, max), now, o)), now[5] + o[5]]
        out.append(now)
    df = spark.createDataFrame(boxes, "image int, cls string, x1 double, y1 double, x2 double, y2 double, score double")
    got = merging.merged_boxes(df, ["image"]).select("x1", "y1", "x2", "y2", "score", "members").collect()
    assert sorted(map(list, got)) == sorted(out)
    kept, met = merging.Kept(6.0, 6.0), 0
    for b in boxes:
        if b[4] - b[2] < 6:
            met += sum(1 for _ in kept.near(list(b[2:])))
            kept.add(list(b[2:]))
    assert met < 20 * len(boxes)  # a walk over all kept met over 700 for each


def test_bootstrap_copies_no_rows(spark):
    """One unit with a hit of the first rank: its precision is 1 wherever the unit is drawn, and no row is repeated for its count."""
    predictions = spark.createDataFrame([("a", 1, 1, 0.9, 1), ("a", 1, 2, 0.5, 0)], "cls string, unit int, id int, score double, hit int")
    out = evaluation.bootstrap_map(predictions, spark.createDataFrame([("a", 1)], "cls string, unit int"), "unit", 20)
    assert tuple(out.first()) == pytest.approx((1.0, 1.0, 1.0))
    assert "copy" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_without_overlap_makes_no_pairs(spark):
    """Boxes that touch across do not overlap, those of one last ping do; the others are only looked for."""
    from pingframe.operators import matching

    rows = [(1, 1, "x", 0, 70, 0.0, 1.0), (2, 1, "y", 70, 80, 0.5, 2.0), (3, 1, "x", 0, 70, 2.0, 3.0), (4, 2, "x", 70, 80, 0.0, 1.0), (5, 1, "x", 81, 90, 0.0, 40.0), (6, 1, None, 81, 90, 0.0, 40.0)]
    boxes = spark.createDataFrame(rows, "event_id long, survey_id int, cls string, ping_start long, ping_end long, across_start double, across_end double")
    out = matching.without_overlap(boxes, "cls = 'x'")
    assert sorted(r["event_id"] for r in out.collect()) == [3, 4, 5]
    assert "Inner" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_percentiles_of_groups(spark):
    """Groups of one value, of ties, with nulls, and a large one, against NumPy."""
    import numpy as np

    from pingframe.operators import ranking

    rng = np.random.default_rng(6)
    own = {"one": [3.5], "ties": [1.0] * 40 + [2.0] * 60, "large": rng.normal(size=5000).round(3).tolist(), None: rng.random(37).tolist()}
    df = spark.createDataFrame([(g, v) for g, vs in own.items() for v in [*vs, None]] + [("none", None)], "g string, v double").repartition(5)
    shares = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p99": 0.99, "top": 1.0}
    got = {r["g"]: r for r in ranking.group_percentiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(own)
    for g, vs in own.items():
        assert [got[g][n] for n in shares] == pytest.approx(np.percentile(vs, [100 * s for s in shares.values()]).tolist())


def test_auroc_over_bins_equals_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    rows = [(g, float(s), int(rng.random() < s)) for g in ("a", None) for s in rng.random(300).round(2)]
    got = {r["g"]: r["auroc"] for r in evaluation.auroc(spark.createDataFrame(rows, "g string, s double, y int"), ["g"], "s", "y").collect()}
    for g in ("a", None):
        up, down = ([s for h, s, y in rows if h == g and y == k] for k in (1, 0))
        assert got[g] == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down]))


def test_greedy_boxes_take_what_a_plain_walk_takes(spark):
    """Copies of boxes with ties of IoU, against all pairs walked one by one; pairs are made of distinct boxes only."""
    import random

    from pingframe.operators import matching, merging

    rng = random.Random(5)
    shapes = [(p, p + 9, x, x + 2.0) for p in (0, 5, 10, 60) for x in (-1.0, 0.0, 1.0, 15.5)]
    boxes = [(i, rng.randrange(2), *rng.choice(shapes), float(rng.randrange(6))) for i in range(400)]
    df = spark.createDataFrame(boxes, "event_id long, survey_id long, ping_start long, ping_end long, across_start double, across_end double, confidence double")

    def iou(a, b):
        p, x = min(a[3], b[3]) - max(a[2], b[2]) + 1, min(a[5], b[5]) - max(a[4], b[4])
        size = lambda r: (r[3] - r[2] + 1) * (r[5] - r[4])
        return p * x / (size(a) + size(b) - p * x) if p > 0 and x > 0 else -1.0

    def walked(lefts, rights, key, least):
        taken, out = set(), set()
        for a in lefts:
            able = [b for b in rights if b[1] == a[1] and b[0] not in taken and iou(a, b) >= least]
            if able:
                b = max(able, key=lambda b: key(a, b))
                taken.add(b[0])
                out.add((a[0], b[0]))
        return out

    odd, even = [b for b in boxes if b[0] % 2], [b for b in boxes if b[0] % 2 == 0]
    want = walked(sorted(odd, key=lambda a: (-a[6], a[0])), even, lambda a, b: (iou(a, b), b[0]), 0.0)
    assert {(r["prediction"], r["truth"]) for r in matching.truth_matches(df, ["survey_id"]).collect()} == want and len(want) > 100
    want = walked(even, odd, lambda a, b: -b[0], 0.2)
    assert {(r["truth"], r["prediction"]) for r in matching.truth_matches(df, ["survey_id"], 0.2, by_confidence=False).collect()} == want
    made = []
    before, matching.overlaps = matching.overlaps, lambda *a: made.append(merging.overlaps(*a)) or made[-1]
    try:
        matching.truth_matches(df, ["survey_id"]).collect()
    finally:
        matching.overlaps = before
    assert sum(m.count() for m in made) <= (2 * 2 * len(shapes)) ** 2 / 4  # all pairs are over 5,000
    assert merging.overlaps(df, ["survey_id"]).count() > 5_000


@pytest.mark.parametrize("lat", [13.0, -59.1, 89.9997])
def test_near_groups_are_those_of_all_near_pairs(spark, lat):
    """Sparse and dense places, and cells whose outermost points are not the nearest ones; links are fewer than near pairs."""
    import random

    rng = random.Random(8)
    wide = 1 / max(math.cos(math.radians(lat)), 1e-4)
    spot = lambda i, span: (i, lat + rng.random() * span, 20 + rng.random() * span * wide, "ab"[i % 2])
    pts = [spot(i, 2.9e-4) for i in range(120)] + [spot(i, 4e-5) for i in range(120, 240)] + [(240, None, 20.0, "a")]
    df = spark.createDataFrame(pts, "id long, lat double, lon double, cls string")

    def metres(p, q):
        a = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(a)))

    roots = {}
    for p in pts:  # ids rise, so the first point of a group is its root
        todo = [p] if p[0] not in roots else []
        while todo:
            at = todo.pop()
            roots[at[0]] = p[0]
            todo += [q for q in pts if at[1] and q[1] and q[0] not in roots and q[3] == at[3] and metres(at, q) <= 5.0]
    got = {r["id"]: r["root"] for r in spatial.near_groups(df, 5.0, ["cls"]).collect()}
    assert got == roots and 2 < len(set(got.values())) < 120


def test_clusters_make_no_pairs_of_points_in_a_dense_place(spark, monkeypatch):
    pts = spark.range(3000).selectExpr("id", "13 + id % 50 * 1e-7 as lat", "80 + id % 60 * 1e-7 as lon", "'a' as cls")
    linked = []
    monkeypatch.setattr(spatial, "connected", lambda links: linked.append(links.count()) or connected(links))
    assert {r["root"] for r in spatial.near_groups(pts, 5.0, ["cls"]).select("root").distinct().collect()} == {0}
    rows = pts.selectExpr("id as event_id", "cast(id as string) as detection_id", "cls", "1.0 as confidence", "lat", "lon", "concat('f', id % 3) as source_file")
    assert [r["n_views"] for r in spatial.clustered(rows).collect()] == [3] and max(linked) < 10


def test_bank_is_held_in_tiles():
    """A worker's memory does not grow with the bank: before, one table had 512 rows by all vectors of a block."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(2)
    x, known = rng.normal(size=(600, 6)), rng.normal(size=(60_000, 6))
    norm = (known**2).sum(axis=1)
    tracemalloc.start()
    got = raster._distances(x, known, norm)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    want = [np.sqrt(((known - p) ** 2).sum(axis=1).min()) for p in x[::50]]
    assert got[::50] == pytest.approx(want, abs=1e-12)


def test_resampled_rows_are_stored_in_few_bytes(spark, monkeypatch, tmp_path):
    """Steps without a longitude give 10,000 places each: every place has its row, dealt to many tasks, and stored in under a byte a row."""
    monkeypatch.setattr(series, "TASK_PLACES", 100_000)
    rows = [(line, i, 13.0 + line * 1e-3 + i * (0.03 if line == 7 else 1e-5), None if i in (2, 5) and line != 7 else 80.0) for line in range(30) for i in range(7)]
    df = spark.createDataFrame(rows, "line_id long, ping int, lat double, lon double")
    series.nearest_by_distance(df, ["line_id"], "ping", 2000.0).write.parquet(str(tmp_path / "out"))
    parts = list((tmp_path / "out").glob("*.parquet"))
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["line_id", "k"])
    track = series.travelled(df, ["line_id"], "ping").toPandas().sort_values(["line_id", "ping"])
    for line, own in track.groupby("line_id"):
        at, found = own["travelled_m"].to_numpy(), got[got["line_id"] == line]
        k = np.arange(int(at[-1] // 2000) + 1)
        nearest = len(at) - 1 - np.abs(at[::-1][None] - k[:, None] * 2000).argmin(axis=1)
        assert found["k"].tolist() == k.tolist() and found["ping"].tolist() == own["ping"].to_numpy()[nearest].tolist()
    assert len(got) > 1_000_000 and len(parts) > 8 and sum(p.stat().st_size for p in parts) < len(got)
    assert series.nearest_by_distance(df.where("false"), ["line_id"], "ping", 2000.0).count() == 0
