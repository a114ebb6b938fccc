"""Stored reports: versions, repeats, broken runs, other writers and migrations."""

import pytest
from pyspark.sql import functions as F

from pingframe.sources import store


@pytest.fixture
def kept(spark, tmp_path):
    return store.Store(spark, f"file://{tmp_path}/reports")


def reports(spark, keys, confidence=0.5, extra=()):
    d = spark.createDataFrame([(k, i, confidence) for k in keys for i in range(3)] + list(extra), "survey_id long, id long, confidence double")
    return {"detections": d, "events": d.where("id = 1").select("survey_id", F.lit("GAP").alias("flag"))}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_second_run_changes_nothing(spark, kept):
    assert kept.save(reports(spark, [1, 2], extra=[(None, 9, 0.1)])) == 1
    assert rows(kept.read("detections")) == rows(reports(spark, [1, 2])["detections"]) and kept.read("events").count() == 2
    assert kept.save(reports(spark, [2, 1])) == 1 and kept.versions() == [1]
    assert kept.save({"detections": reports(spark, [1, 2])["detections"].repartition(7)}) == 1


def test_reports_take_the_place_of_their_own_only(spark, kept):
    kept.save(reports(spark, [1, 2, 3]))
    assert kept.save(reports(spark, [2, 4], 0.9)) == 2
    got = {r["survey_id"]: (r["n"], r["c"]) for r in kept.read("detections").groupBy("survey_id").agg(F.count("*").alias("n"), F.max("confidence").alias("c")).collect()}
    assert got == {1: (3, 0.5), 2: (3, 0.9), 3: (3, 0.5), 4: (3, 0.9)}
    assert kept.read("detections", 1).groupBy("survey_id").count().count() == 3
    assert kept.delete(spark.createDataFrame([(1,), (77,)], "k long")) == 3 and kept.delete(spark.createDataFrame([(77,)], "k long")) == 3
    assert {r["survey_id"] for r in kept.read("detections").collect()} == {2, 3, 4} == {r["survey_id"] for r in kept.read("events").collect()}


def test_a_broken_run_leaves_the_version_before(spark, kept):
    kept.save(reports(spark, [1]))
    before = rows(kept.read("detections"))
    new = reports(spark, [1, 5], 0.7)
    new["events"] = new["events"].withColumn("flag", F.when(F.col("survey_id") == 5, F.raise_error(F.lit("broken off"))).otherwise(F.col("flag")))
    with pytest.raises(Exception, match="broken off"):
        kept.save(new)
    digests, kept._digests = kept._digests, lambda t: digests({k: v for k, v in reports(spark, [1, 5], 0.7).items() if k in t})
    with pytest.raises(Exception, match="broken off"):  # now after rows of the first table are written
        kept.save(new)
    kept._digests = digests
    assert kept.versions() == [1] and rows(kept.read("detections")) == before
    assert kept.save(reports(spark, [1, 5], 0.7)) == 2 and kept.read("detections").count() == 6


def test_another_writer_is_noticed(spark, kept):
    kept.save(reports(spark, [1]))
    other = store.Store(spark, kept.root)
    state = kept.state
    kept.state = lambda version=None: state(1)
    assert other.save(reports(spark, [2])) == 2
    with pytest.raises(store.Conflict):
        kept.save(reports(spark, [3]))
    assert {r["survey_id"] for r in other.read("detections").collect()} == {1, 2}


def test_other_columns_need_a_migration(spark, kept):
    kept.save(reports(spark, [1]))
    with pytest.raises(store.Unfit):
        kept.save({"detections": reports(spark, [1])["detections"].withColumn("more", F.lit(1))})
    with pytest.raises(KeyError):
        kept.read("nothing")


FIRST = store.Migration(1, "percent", lambda t: {"detections": t["detections"].withColumn("percent", F.col("confidence") * 100).drop("confidence")})
SECOND = store.Migration(2, "notes", lambda t: {"notes": t["events"].select("survey_id", F.lower("flag").alias("note"))})
BROKEN = store.Migration(3, "broken", lambda t: {"events": t["events"].withColumn("flag", F.raise_error(F.lit("broken off")).cast("string"))})


def test_migrations_go_in_order_and_once(spark, kept):
    kept.save(reports(spark, [1, 2]))
    with pytest.raises(Exception, match="broken off"):
        kept.migrate([BROKEN, SECOND, FIRST])
    assert [a[:2] for a in kept.state()["applied"]] == [[1, "percent"], [2, "notes"]] and kept.state()["schema"] == 2
    assert kept.migrate([FIRST, SECOND]) == [] and rows(kept.read("events")) == [(1, "GAP"), (2, "GAP")]
    assert rows(kept.read("notes")) == [(1, "gap"), (2, "gap")] and kept.read("detections").columns == ["survey_id", "id", "percent"]
    assert "confidence" in kept.read("detections", 1).columns
    with pytest.raises(store.Unfit):
        kept.save(reports(spark, [3]))
    new = reports(spark, [2, 3])
    new["detections"] = new["detections"].select("survey_id", "id", (F.col("confidence") * 100).alias("percent"))
    version = kept.save(new)
    assert kept.read("detections").count() == 9 and kept.save(new) == version
    for wrong in ([SECOND], [FIRST, store.Migration(2, "other", SECOND.change)], [FIRST]):
        with pytest.raises(ValueError):
            kept.migrate(wrong)


def test_vacuum_keeps_what_is_read(spark, kept):
    for k in range(3):
        kept.save(reports(spark, [1, 2 + k], 0.1 * k))
    before = rows(kept.read("detections")), rows(kept.read("events"))
    assert kept.vacuum() > 0 and (rows(kept.read("detections")), rows(kept.read("events"))) == before and kept.versions() == [3]
    assert kept.save(reports(spark, [9])) == 4


def test_an_empty_store(spark, kept):
    assert kept.versions() == [] and kept.state()["version"] == 0 and kept.migrate([]) == []
    assert kept.save(reports(spark, [])) == 0


def test_models_and_segments(spark):
    models = spark.createDataFrame([("det", "a", "1", 5), ("det", "a", "1", 3), ("det", "b", "1", 1), ("fp", "a", "1", 2)], "kind string, name string, version string, size int")
    got = store.new_models(models, models.where("name = 'b'")).orderBy("model").collect()
    assert [(r["model"], r["size"]) for r in got] == [("det:a@1", 3), ("fp:a@1", 2)]
    points = spark.createDataFrame([("x", 2, 1.0, 2.0), ("x", 1, 1.0, 1.0), ("y", 1, 1.0, 1.0), ("y", 2, None, 1.0)], "line string, ping int, lat double, lon double")
    got = store.segments(points, ["line"], "ping").collect()
    assert [(r["line"], [p["at"] for p in r["points"]]) for r in got] == [("x", [1, 2])]
