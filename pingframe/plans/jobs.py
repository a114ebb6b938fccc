"""Queries over job events, in batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pingframe.plans.registry import query
from pingframe.plans.tables import shared_dir
from pingframe.plans.views import table, view
from pingframe.streaming import jobs, state

V = "v_job_event"


def events(spark, d):
    e = view(spark, d, V)
    return e.withColumn("seq", F.col("seq").cast("long"))


@query("str01_numbered_events", "SELECT job_id, seq, type FROM v_job_event", V)
def str01(spark, d):
    return events(spark, d).select("job_id", "seq", "type")


@query("str02_standing_detections", "SELECT job_id, detection_key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY job_id, detection_key ORDER BY seq DESC) AS k FROM v_job_event WHERE type IN ('detection', 'detection_update', 'detection_removed')) WHERE k = 1 AND type <> 'detection_removed'", V)
def str02(spark, d):
    return jobs.detections_now(events(spark, d))


@query("str03_replay", "SELECT job_id, seq, type FROM v_job_event WHERE seq > 25", V)
def str03(spark, d):
    e = events(spark, d)
    return jobs.replayed(e.unionByName(e.where("seq % 5 = 0")), 25).select("job_id", "seq", "type")


@query("str04_rising_numbers", "SELECT job_id, seq FROM (SELECT job_id, seq, max(seq) OVER (PARTITION BY job_id ORDER BY (seq * 7) % 31, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM v_job_event) WHERE seq > coalesce(top, -1)", V)
def str04(spark, d):
    e = events(spark, d).withColumn("arrival", F.struct((F.col("seq") * 7 % 31).alias("a"), "seq"))
    return jobs.rising(e, "arrival").select("job_id", "seq")


@query("str05_sampled_progress", "SELECT job_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, max(seq) AS seq FROM v_job_event WHERE type = 'progress' GROUP BY 1, 2", V)
def str05(spark, d):
    return jobs.sampled_progress(events(spark, d), 3600).select("job_id", F.col("slot").cast("long").alias("slot"), "seq")


@query("agg21_stage_latency", """p AS (SELECT job_id, max(g) AS gap FROM (SELECT job_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY job_id ORDER BY seq)) AS g FROM v_job_event WHERE type = 'progress') GROUP BY job_id) SELECT e.job_id, round(min(CASE WHEN type = 'detection' THEN epoch(ts) END) - min(epoch(ts)), 3) AS first_detection_s, round(min(p.gap), 3) AS largest_gap_s FROM v_job_event e LEFT JOIN p USING (job_id) GROUP BY e.job_id""", V)
def agg21(spark, d):
    return jobs.stage_latency(events(spark, d)).select("job_id", F.round("first_detection_s", 3).alias("first_detection_s"), F.round("largest_gap_s", 3).alias("largest_gap_s"))


@query("str10_hourly_counts", "SELECT date_trunc('hour', ts) AS hour, type, count(*) AS n FROM v_job_event GROUP BY 1, 2", V)
def str10(spark, d):
    return jobs.hourly_counts(events(spark, d)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("scl09_eta", "SELECT job_id, round((epoch(max(ts)) - epoch(min(ts))) * (100 - max(seq) % 100) / (max(seq) % 100), 2) AS eta_s FROM v_job_event GROUP BY job_id HAVING max(seq) % 100 > 0", V)
def scl09(spark, d):
    sec = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    p = F.max("seq") % 100
    out = events(spark, d).groupBy("job_id").agg((sec(F.max("ts")) - sec(F.min("ts"))).alias("spent"), p.alias("p")).where("p > 0")
    return out.select("job_id", F.round(F.col("spent") * (100 - F.col("p")) / F.col("p"), 2).alias("eta_s"))


NUMBERED = """e AS (SELECT user_id AS job_id, event_id, ts, CASE WHEN event_id % 97 = 0 THEN 'done' WHEN event_type IN ('view', 'click') THEN 'progress' ELSE 'detection' END AS type, concat('s', cast(floor(value / 60) as string)) AS stage FROM events),
 n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS seq FROM e), k AS (SELECT n.* FROM n LEFT JOIN (SELECT job_id, min(seq) AS last FROM n WHERE type = 'done' GROUP BY job_id) USING (job_id) WHERE seq <= coalesce(last, seq)),
 p AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS i FROM k WHERE type = 'progress'),
 w AS (SELECT job_id, seq, i, stage, ts AS at, TRUE AS written FROM p WHERE i = 1 UNION ALL SELECT p.job_id, p.seq, p.i, CASE WHEN {x} THEN p.stage ELSE w.stage END, CASE WHEN {x} THEN p.ts ELSE w.at END, {x} FROM w JOIN p ON p.job_id = w.job_id AND p.i = w.i + 1)""".replace("{x}", "(p.stage <> w.stage OR epoch(p.ts) - epoch(w.at) >= 21600)")


@query("str01_stream_numbers", f"WITH RECURSIVE {NUMBERED} SELECT k.job_id, k.seq, k.event_id, k.type, coalesce(w.written, TRUE) AS written, k.type = 'done' AS ended FROM k LEFT JOIN w USING (job_id, seq)".replace("cast(floor(value / 60) as string)", "CAST(CAST(floor(value / 60) AS BIGINT) AS VARCHAR)"))
def str01b(spark, d):
    """Events numbered in a stream of three batches, progress written on a new stage or every six hours, and the ends that were stored after their batch's rows."""
    kind = F.when(F.col("event_id") % 97 == 0, "done").when(F.col("event_type").isin("view", "click"), "progress").otherwise("detection")
    stage = F.concat(F.lit("s"), F.floor(F.col("value") / 60).cast("string"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"), stage.alias("stage"))
    place = f"{shared_dir(spark)}/job-events-{uuid.uuid4().hex}"
    first, second = rows.agg(F.percentile_approx(F.unix_micros("ts"), F.array(F.lit(0.3), F.lit(0.7)), F.lit(100))).first()[0] or (0, 0)
    at = F.unix_micros("ts")
    with state.with_state(spark):
        for part in (at < first, (at >= first) & (at < second), at >= second):  # all files of a part are there before the stream goes on, so they are one batch
            rows.where(part).write.mode("append").parquet(f"{place}/in")
            stream = jobs.read_events(spark, f"{place}/in", rows.schema)
            state.stored(state.numbered(stream, 21600.0, 10 * 365 * 86_400), f"{place}/out", f"{place}/state")
    ends = spark.read.parquet(f"{place}/out/ends").select("job_id", "seq", F.lit(True).alias("ended"))
    kept = spark.read.parquet(f"{place}/out/events").select("job_id", "seq", "event_id", "type", "written")
    return kept.join(ends, ["job_id", "seq"], "left").select("job_id", "seq", "event_id", "type", "written", F.coalesce("ended", F.lit(False)).alias("ended"))
