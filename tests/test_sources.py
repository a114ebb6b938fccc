"""Sources against files that the tests write."""

import json
import struct

import pytest

from pingframe.sources import geotiff, sonar_log, text


def log(n=5, samples=8, tail=0, ship_only=False, bad=False):
    head = bytearray(1024)
    head[0] = 0 if bad else 0x7B
    head[18:23] = b"SONAR"
    struct.pack_into("<HHH", head, 164, 3, 2, 0)
    for i, kind in enumerate((1, 2)):
        head[256 + 128 * i] = kind
        struct.pack_into("<H", head, 256 + 128 * i + 6, 2)
        head[256 + 128 * i + 74] = 3
    out = bytes(head)
    for k in range(n):
        size = 256 + 2 * (64 + 2 * samples)
        p = bytearray(size)
        struct.pack_into("<HBBH4sI", p, 0, 0xFACE, 0, 0, 2, b"", size)
        struct.pack_into("<H6B", p, 14, 2024, 5, 6, 7, 8, 9, 50 + k)
        struct.pack_into("<dd", p, 128, 12.5, 80.5)
        if not ship_only:
            struct.pack_into("<dd", p, 160, 13.0 + k, 80.0)
        struct.pack_into("<f", p, 152, 4.0)
        struct.pack_into("<6f", p, 192, 10.0, 8.0 if k else 0.0, 0.0, 1.0, 2.0, 90.0)
        for c in range(2):
            at = 256 + c * (64 + 2 * samples)
            struct.pack_into("<f", p, at + 4, 50.0)
            struct.pack_into("<I", p, at + 42, samples)
            struct.pack_into(f"<{samples}H", p, at + 64, *[100 * k + 10 * c + s for s in range(samples)])
        out += bytes(p)
    return out[: len(out) - tail]


def test_log(spark, tmp_path):
    for name, raw in {"a.xtf": log(), "b.xtf": log(tail=10), "c.xtf": log(bad=True), "d.xtf": log(n=0), "e.xtf": log(ship_only=True)}.items():
        (tmp_path / name).write_bytes(raw)
    of = {r["path"][-5:]: r for r in sonar_log.profile(spark, str(tmp_path)).collect()}
    assert of["a.xtf"]["pings"] == 5 and not of["a.xtf"]["truncated"] and of["a.xtf"]["port_samples"] == 8 and of["a.xtf"]["sonar"] == "SONAR"
    assert of["b.xtf"]["pings"] == 4 and of["b.xtf"]["truncated"]
    assert of["c.xtf"]["error"] == "CORRUPT_HEADER" and of["d.xtf"]["error"] == "NO_PINGS"
    rows = sonar_log.positioned(sonar_log.read(spark, str(tmp_path), batch=2)).collect()
    own = sorted((r for r in rows if r["path"].endswith("a.xtf")), key=lambda r: r["ping"])
    assert [r["ping"] for r in own] == list(range(5)) and own[2]["port"] == [200 + s for s in range(8)] and own[2]["starboard"][0] == 210
    assert own[0]["altitude_m"] is None and own[1]["altitude_m"] == 8 and own[1]["lat"] == 14 and own[1]["nav_source"] == "sensor"
    assert own[1]["time_utc"].microsecond == 510000 and own[1]["speed_mps"] == pytest.approx(4 * 1852 / 3600) and own[1]["slant_range_m"] == 50
    assert {r["nav_source"] for r in rows if r["path"].endswith("e.xtf")} == {"ship"}


def test_log_in_spans(spark, tmp_path):
    (tmp_path / "a b.xtf").write_bytes(log(n=7))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c.xtf").write_bytes(log(n=1))
    for batch in (1, 3, 7, 500):
        rows = sonar_log.read(spark, str(tmp_path), batch).where("path like '%a b.xtf'").orderBy("ping").collect()
        assert [(r["ping"], r["port"][0]) for r in rows] == [(k, 100 * k) for k in range(7)]
    assert sonar_log.read(spark, str(tmp_path)).count() == 8


def mosaic(values, order="<", epsg=32644, deep=2, packing=1, bands=1, transform=True):
    """A TIFF of uint16 strips with a pixel scale of 0.5 and a corner at (400000, 1500000)."""
    h, w = len(values), len(values[0])
    pixels = [struct.pack(f"{order}{w * bands}H", *[x for v in row for x in [v] * bands]) for row in values]
    blocks = [b"".join(pixels[k : k + deep]) for k in range(0, h, deep)]
    n = len(blocks)
    fields = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (16,) * bands), (259, 3, (packing,)), (273, 4, None), (277, 3, (bands,)), (278, 4, (deep,)), (284, 3, (1,)), (339, 3, (1,) * bands)]
    if transform:
        fields += [(33550, 12, (0.5, 0.5, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 400000.0, 1500000.0, 0.0))]
    if epsg:
        fields.append((34735, 3, (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg)))
    sizes = {3: (2, "H"), 4: (4, "I"), 12: (8, "d")}
    at = 8 + 2 + 12 * len(fields) + 4
    start = at + 1024
    places = tuple(start + sum(map(len, blocks[:k])) for k in range(n))
    head, more = b"", b""
    for tag, kind, vals in fields:
        vals = places if vals is None else vals
        size, letter = sizes[kind]
        raw = struct.pack(f"{order}{len(vals)}{letter}", *vals)
        if len(raw) <= 4:
            cell = raw.ljust(4, b"\0")
        else:
            cell, more = struct.pack(f"{order}I", at + len(more)), more + raw
        head += struct.pack(f"{order}HHI", tag, kind, len(vals)) + cell
    first = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8)
    return first + struct.pack(f"{order}H", len(fields)) + head + b"\0" * 4 + more.ljust(1024, b"\0") + b"".join(blocks)


def test_mosaics(spark, tmp_path):
    values = [[10 * r + c for c in range(4)] for r in range(5)]
    files = {
        "a.tif": mosaic(values), "b.tif": mosaic(values, ">", deep=5, bands=3), "none.tif": mosaic(values, epsg=None), "packed.tif": mosaic(values, packing=5),
        "flat.tif": mosaic(values, transform=False), "cut.tif": mosaic(values)[:-6], "text.tif": b"no raster at all", "empty.tif": b"",
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in geotiff.strips(spark, str(tmp_path)).collect()}
    assert errors == {
        "a.tif": None, "b.tif": None, "none.tif": "CRS_REQUIRED", "packed.tif": "UNSUPPORTED_FORMAT", "flat.tif": "CORRUPT_HEADER",
        "cut.tif": "CORRUPT_HEADER", "text.tif": "CORRUPT_HEADER",
    }
    for name in ("a.tif", "b.tif"):
        got = geotiff.read(spark, str(tmp_path / name)).orderBy("row").collect()
        assert [r["v"] for r in got] == values and got[0]["epsg"] == 32644 and got[0]["transform"] == [400000, 0.5, 0, 1500000, 0, -0.5]
    assert geotiff.read(spark, str(tmp_path / "none.tif"), 4326).first()["epsg"] == 4326


def test_mosaic_positions(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, 0, 4326, [80.0, 0.1, 0.0, 13.0, 0.0, -0.1]), (1, 3, 32644, [500000.0, 2.0, 0.0, 1437146.0, 0.0, -2.0]), (1, 3, 3857, [0.0, 2.0, 0.0, 0.0, 0.0, -2.0])], "r int, c int, epsg int, t array<double>")
    lat, lon = geotiff.position(F.col("r"), F.col("c"), F.col("epsg"), F.col("t"))
    got = rows.select(lat.alias("lat"), lon.alias("lon")).collect()
    assert got[0]["lat"] == pytest.approx(12.95) and got[0]["lon"] == pytest.approx(80.05)
    assert abs(got[1]["lat"] - 13.0) < 2e-3 and got[1]["lon"] == pytest.approx(81 + 7 / 108500, abs=1e-6)
    assert got[2]["lat"] is None and got[2]["lon"] is None


def test_navigation(spark):
    rows = spark.createDataFrame([("0", "50", "13", "80", "350"), ("4", "60", "13.4", "80", "10")], "ping string, slant_range_m string, lat string, lon string, heading_deg string")
    got = text.navigation(rows, 6).orderBy("ping").collect()
    assert [round(r["lat"], 6) for r in got] == [13, 13.1, 13.2, 13.3, 13.4, 13.5]
    assert [r["slant_range_m"] for r in got] == [50, 52.5, 55, 57.5, 60, 60]
    assert min(got[2]["heading_deg"], 360 - got[2]["heading_deg"]) < 1e-6
    assert [r["nav_source"] for r in got] == ["csv", *["interpolated"] * 3, "csv", "interpolated"]


@pytest.mark.parametrize("change, code", [({"ping": "1.5"}, "BAD_PING"), ({"ping": "9"}, "BAD_PING"), ({"ping": "4"}, "BAD_PING"), ({"lat": "x"}, "NO_NAVIGATION")])
def test_bad_navigation(spark, change, code):
    row = {"ping": "0", "slant_range_m": "50", "lat": "13", "lon": "80"} | change
    rows = spark.createDataFrame([("4", "50", "13", "80"), (row["ping"], row["slant_range_m"], row["lat"], row["lon"])], "ping string, slant_range_m string, lat string, lon string")
    with pytest.raises(text.BadSource) as e:
        text.navigation(rows, 6)
    assert e.value.code == code
    with pytest.raises(text.BadSource):
        text.navigation(rows.drop("lat"), 6)


def test_predictions_and_labels(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"image":"a","detections":[{"cls":1,"score":0.5,"polygon":[[0,0],[1,0],[1,1]]}]}\n')
    row = text.predictions(spark, str(tmp_path)).first()
    assert row["image"] == "a" and row["polygon"][2] == [1, 1]
    lines = spark.createDataFrame([("2 0 0 1 0 1 1",), ("2 0 0 1 0",), ("x 0 0 1 0 1 1",), ("0 .5 .5 .1 .1",)], "t string")
    got = lines.select(text.polygon(lines["t"]).alias("p"), text.box(lines["t"]).alias("b")).collect()
    assert [r["p"] is not None for r in got] == [True, False, False, False] and [r["b"] is not None for r in got] == [False, True, False, True]


def test_dispatch_and_settings(spark, tmp_path):
    from pingframe.sources import dispatch

    (tmp_path / "a.xtf").write_bytes(log())
    assert dispatch.read(spark, str(tmp_path / "a.xtf")).count() == 5
    (tmp_path / "n.csv").write_text("ping,lat\n1,2\n")
    assert dispatch.read(spark, str(tmp_path / "n.csv")).columns == ["ping", "lat"]
    with pytest.raises(text.BadSource):
        dispatch.read(spark, "x.jsf")
    got = dispatch.settings({"geo": {"sigma": 1}, "a": 2}, env={"PINGFRAME_GEO__SIGMA": "3", "PINGFRAME_NAME": "bay", "OTHER": "1"})
    assert got == {"geo": {"sigma": 3}, "a": 2, "name": "bay"}
    assert dispatch.digest({"a": 1, "b": 2}) == dispatch.digest({"b": 2, "a": 1})


def test_reports_are_written_and_read_back(spark, tmp_path):
    from pyspark.sql import functions as F

    from pingframe.operators import reports

    rows = [("S1-D0001", 1, "pipe", 87.25, 13.0, 80.0, ["DROPOUT", "TILE_EDGE"]), ("S1-D0002", 1, "cylinder", 40.0, None, None, []), ("S2-D0001", 2, "pipe", 9.0, 13.5, 80.5, [])]
    kinds = "detection_id string, survey_id int, cls string, confidence double, lat double, lon double, quality_flags array<string>"
    found = spark.createDataFrame(rows, kinds).withColumn("review_status", F.lit(None).cast("string")).withColumn("alert_tier", F.lit("review"))
    track = spark.createDataFrame([(1, [(13.0, 80.0), (13.1, 80.1)]), (2, [(13.0, 80.0)])], "survey_id int, points array<struct<lat: double, lon: double>>")
    path = str(tmp_path / "out")
    assert reports.write(found, path, ("csv", "geojson", "json", "kml", "csv"), track) == ["csv", "geojson", "json", "kml"]
    table = spark.read.option("header", True).csv(f"{path}/csv")
    assert [c for c in table.columns if c != "survey"] == list(reports.COLUMNS)
    one = table.where("detection_id = 'S1-D0001'").first()
    assert (one["confidence"], one["lat"], one["quality_flags"], one["review_status"], one["depth_m"]) == ("87.3", "13.000000", "DROPOUT;TILE_EDGE", "pending", None)
    made = [json.loads(r["value"]) for r in spark.read.text(f"{path}/geojson").collect()]
    assert sorted(f["properties"]["feature_kind"] for f in made) == ["detection", "detection", "track"]
    assert next(f for f in made if f["geometry"]["type"] == "LineString")["geometry"]["coordinates"] == [[80.0, 13.0], [80.1, 13.1]]
    assert spark.read.json(f"{path}/json").count() == 3 and spark.read.text(f"{path}/kml").count() == 2
    with pytest.raises(ValueError):
        reports.write(found.where("lat is null"), path + "2", ("kml",))
    with pytest.raises(ValueError):
        reports.write(found, path + "2", ("pdf",))
