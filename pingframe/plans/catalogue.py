"""Queries over surveys, files, reviews and items."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pingframe.operators import catalogue, filters
from pingframe.plans.registry import query
from pingframe.plans.tables import shared_dir
from pingframe.plans.views import table, view
from pingframe.sources.store import Migration, Store, segments

S, SF = "v_survey", "v_source_file"


@query("flt05_history_search", """SELECT survey_key, name, status FROM v_survey s WHERE (contains(lower(name), 'house') OR contains(lower(name), 'red') OR survey_key IN (SELECT survey_key FROM v_source_file WHERE contains(lower(filename), 'red') OR contains(lower(filename), 'house'))) AND status IN ('done', 'failed') AND created_utc >= TIMESTAMP '1996-01-01' AND created_utc < TIMESTAMP '1999-01-01'""", S, SF)
def flt05(spark, d):
    surveys, files = view(spark, d, S), view(spark, d, SF)
    found = [filters.history(surveys, files, text=t, start="1996-01-01", end="1998-12-31", statuses=("done", "failed")) for t in ("House", "RED")]
    return found[0].unionByName(found[1]).select("survey_key", "name", "status").distinct()


@query("flt07_history_by_project", "SELECT survey_key, project_id FROM v_survey WHERE project_id = 7 AND contains(lower(name), '_') = FALSE AND name LIKE '%survey%'", S)
def flt07(spark, d):
    return filters.history(view(spark, d, S), view(spark, d, SF), text="survey", project=7).select("survey_key", "project_id")


@query("flt17_last_days", "SELECT survey_key FROM v_survey WHERE created_utc >= (SELECT max(created_utc) FROM v_survey) - INTERVAL 30 DAY", S)
def flt17(spark, d):
    rows = view(spark, d, S)
    last = rows.agg(F.max("created_utc").alias("last"))
    return rows.join(F.broadcast(last)).where(F.col("created_utc") >= F.col("last") - F.expr("INTERVAL 30 DAYS")).select("survey_key")


@query("agg03_total_bytes", "SELECT s.survey_key, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM v_survey s LEFT JOIN v_source_file f USING (survey_key) GROUP BY s.survey_key", S, SF)
def agg03(spark, d):
    return catalogue.overview(view(spark, d, S), view(spark, d, SF)).select("survey_key", "bytes")


@query("jn15_survey_overview", """f AS (SELECT survey_key, count(*) AS files, sum(size_bytes) AS bytes, sum(pings) AS pings, string_agg(DISTINCT filename, ',' ORDER BY filename) AS names FROM v_source_file GROUP BY survey_key),
 l AS (SELECT l_orderkey AS survey_key, epoch(max(l_shipdate)) - epoch(min(l_shipdate)) AS duration_s, max(l_linestatus) AS state, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS hazards FROM lineitem GROUP BY 1)
 SELECT s.survey_key, s.status, coalesce(files, 0) AS files, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes, CAST(coalesce(pings, 0) AS BIGINT) AS pings, coalesce(names, '') AS filenames, CASE WHEN total >= 3 THEN state ELSE s.status END AS job_status,
  CASE WHEN total >= 3 THEN duration_s END AS duration_s, coalesce(total, 0) AS total, coalesce(hazards, 0) AS hazards FROM v_survey s LEFT JOIN f USING (survey_key) LEFT JOIN l USING (survey_key)""", S, SF)
def jn15(spark, d):
    lines = table(spark, d, "lineitem")
    jobs = lines.groupBy(F.col("l_orderkey").alias("survey_key")).agg(F.count("*").alias("n"), F.min("l_shipdate").alias("started"), F.max("l_shipdate").alias("finished"), F.max("l_linestatus").alias("status"))
    found = lines.select(F.col("l_orderkey").alias("survey_key"), F.when(F.col("l_returnflag") == "R", "hazard").otherwise("review").alias("alert_tier"))
    out = catalogue.overview(view(spark, d, S), view(spark, d, SF), jobs.where("n >= 3").withColumn("job_id", F.col("survey_key")), found)
    return out.select("survey_key", "status", "files", "bytes", "pings", F.array_join("filenames", ",").alias("filenames"), "job_status", "duration_s", "total", "hazards")


@query("agg06_project_rollup", "SELECT project_id, count(*) AS lines, CAST(sum(CAST(track_m AS BIGINT)) AS BIGINT) AS pings, bool_or(status = 'done') AS geotagged, min(created_utc) AS first_utc, max(created_utc) AS last_utc, string_agg(DISTINCT status, ',' ORDER BY status) AS warnings FROM (SELECT *, floor(track_m) AS t FROM v_survey) GROUP BY project_id".replace("CAST(track_m AS BIGINT)", "CAST(t AS BIGINT)"), S)
def agg06(spark, d):
    rows = view(spark, d, S).select("project_id", F.floor("track_m").cast("long").alias("pings"), (F.col("status") == "done").alias("geotagged"), F.col("created_utc").alias("first_utc"), F.col("created_utc").alias("last_utc"), F.array("status").alias("warnings"))
    return catalogue.survey_rollup(rows, ["project_id"])


@query("agg07_source_flags", "SELECT survey_key, CAST(sum(pings) AS BIGINT) AS pings, bool_or(pings > 40) AS large, string_agg(DISTINCT filename, ',' ORDER BY filename) AS names FROM v_source_file GROUP BY survey_key", SF)
def agg07(spark, d):
    return view(spark, d, SF).groupBy("survey_key").agg(F.sum("pings").alias("pings"), F.bool_or(F.col("pings") > 40).alias("large"), F.array_join(F.array_sort(F.collect_set("filename")), ",").alias("names"))


@query("src01_admission", """SELECT page_id, CASE WHEN ext NOT IN ('com', 'net') THEN 'UNSUPPORTED_FORMAT' WHEN strlen(content) > 20000 THEN 'FILE_TOO_LARGE' WHEN substr(content, 1, 2) <> '<!' THEN 'CORRUPT_HEADER' ELSE '' END AS error FROM (SELECT page_id, content, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS ext FROM v_file)""".replace("\\\\", "\\"), "v_file")
def src01(spark, d):
    return catalogue.admitted(view(spark, d, "v_file"), 20000, {"com": "page", "net": "page"}, {"com": ("3C21",), "net": ("3C21",)}).select("page_id", F.coalesce("error", F.lit("")).alias("error"))


@query("src21_content_digest", "SELECT page_id, sha256(content) AS digest FROM v_file", "v_file")
def src21(spark, d):
    return view(spark, d, "v_file").select("page_id", F.sha2("content", 256).alias("digest"))


@query("scl18_safe_filename", r"SELECT page_id, CASE WHEN trim(c, '._') = '' THEN 'file' ELSE c END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(path, '^.*[/\\]', ''), '[^A-Za-z0-9._-]+', '_', 'g') AS c FROM v_file)", "v_file")
def scl18(spark, d):
    return view(spark, d, "v_file").select("page_id", catalogue.safe_name(F.col("path")).alias("name"))


@query("snk12_project_slug", "SELECT survey_key, lower(trim(regexp_replace(name, '[^A-Za-z0-9]+', '-', 'g'), '-')) AS slug FROM v_survey", S)
def snk12(spark, d):
    return view(spark, d, S).select("survey_key", catalogue.slug(F.col("name")).alias("slug"))


@query("snk12_next_survey_id", "SELECT 'SRV-' || lpad(CAST(max(CAST(substr(survey_id, 5) AS BIGINT)) + 1 AS VARCHAR), 5, '0') AS next_id FROM v_survey", S)
def snk12b(spark, d):
    return catalogue.next_id(view(spark, d, S), "survey_id", "SRV-").select(F.concat(F.lit("SRV-"), F.lpad(F.substring("next_id", 5, 20), 5, "0")).alias("next_id"))


@query("snk13_cascade_delete", "SELECT 'survey' AS tab, count(*) AS n FROM v_survey WHERE survey_key <> (SELECT min(survey_key) FROM v_survey WHERE status = 'done') UNION ALL SELECT 'source_file', count(*) FROM v_source_file WHERE survey_key <> (SELECT min(survey_key) FROM v_survey WHERE status = 'done')", S, SF)
def snk13(spark, d):
    rows = {"survey": view(spark, d, S), "source_file": view(spark, d, SF)}
    key = rows["survey"].where("status = 'done'").agg(F.min("survey_key")).first()[0]
    left = catalogue.without_survey(rows, key if key is not None else -1)
    out = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("tab"), "n") for k, t in left.items()]
    return out[0].unionByName(out[1])


@query("snk11_model_versions", "SELECT DISTINCT p_brand || ':' || p_type AS model FROM part")
def snk11(spark, d):
    rows = table(spark, d, "part").select(F.concat_ws(":", "p_brand", "p_type").alias("model"), "p_size")
    known = rows.where("p_size < 10").dropDuplicates(["model"])
    return catalogue.added(known, rows.where("p_size >= 10"), ["model"]).select("model")


@query("snk14_label_store", "SELECT detection_key, turn, status FROM (SELECT *, row_number() OVER (PARTITION BY detection_key ORDER BY turn DESC) AS k FROM v_review) WHERE k = 1 AND status <> 'pending'", "v_review")
def snk14(spark, d):
    return catalogue.label_store(view(spark, d, "v_review")).select("detection_key", "turn", "status")


@query("scl13_review_changes", "SELECT detection_key, turn, old_status, status FROM (SELECT *, coalesce(lag(status) OVER (PARTITION BY detection_key ORDER BY turn), 'pending') AS old_status FROM v_review) WHERE status <> old_status", "v_review")
def scl13(spark, d):
    return catalogue.review_changes(view(spark, d, "v_review")).select("detection_key", "turn", "old_status", "status")


@query("srt05_latest_report", "SELECT survey_key, arg_max(filename, file_no) AS filename FROM (SELECT survey_key, file_no, max(filename) AS filename FROM v_source_file GROUP BY survey_key, file_no) GROUP BY survey_key", SF)
def srt05(spark, d):
    return catalogue.latest(view(spark, d, SF), "survey_key", ["file_no", "filename"], "filename").select("survey_key", "filename")


@query("srt04_stable_order", "SELECT survey_key, row_number() OVER (PARTITION BY project_id ORDER BY created_utc, survey_key) AS place FROM v_survey", S)
def srt04(spark, d):
    return view(spark, d, S).select("survey_key", F.row_number().over(Window.partitionBy("project_id").orderBy("created_utc", "survey_key")).cast("long").alias("place"))


@query("src16_site_of_name", "SELECT p_partkey, lower(regexp_extract(p_name || CAST(p_partkey AS VARCHAR), '^[^0-9]+', 0)) AS site FROM part")
def src16(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lower(F.regexp_extract(F.concat("p_name", F.col("p_partkey").cast("string")), "^[^0-9]+", 0)).alias("site"))


@query("src23_paired_items", "SELECT i.doc_id, i.site, l.quality FROM (SELECT doc_id, concat(source, ':', lang) AS site FROM documents) i JOIN labels l USING (doc_id)")
def src23(spark, d):
    return view(spark, d, "v_item").join(table(spark, d, "labels"), "doc_id").select("doc_id", "site", "quality")


#: A report: detections and quality events of a survey, its track by files, its models.
REPORT = {
    "detections": "SELECT survey_id, event_id, cls, confidence, alert_tier FROM v_detection",
    "quality_events": "SELECT survey_id, event_id, quality_flags FROM v_detection WHERE quality_flags <> ''",
}
D = "v_detection"


def _reports(spark, d):
    rows = view(spark, d, D)
    return {"detections": rows.select("survey_id", "event_id", "cls", "confidence", "alert_tier"), "quality_events": rows.where("quality_flags <> ''").select("survey_id", "event_id", "quality_flags")}


def _stored(spark, d):
    """A store with all reports, saved twice, then those of every third survey anew without their hidden detections."""
    kept = Store(spark, f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}")
    reports = _reports(spark, d)
    for _ in range(2):
        kept.save(reports)
    kept.save({k: t.where("survey_id % 3 = 0") if k != "detections" else t.where("survey_id % 3 = 0 and alert_tier <> 'hidden'") for k, t in reports.items()})
    return kept


@query("snk11_stored_reports", f"""SELECT survey_id, count(*) AS n, round(sum(confidence), 4) AS confidence, (SELECT count(*) FROM v_detection q WHERE q.survey_id = d.survey_id AND quality_flags <> '') AS quality_events
 FROM ({REPORT["detections"]}) d WHERE survey_id % 3 <> 0 OR alert_tier <> 'hidden' GROUP BY survey_id""", D)
def snk11b(spark, d):
    kept = _stored(spark, d)
    quality = kept.read("quality_events").groupBy("survey_id").agg(F.count("*").alias("quality_events"))
    own = kept.read("detections").groupBy("survey_id").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))
    return own.join(quality, "survey_id", "left").select("survey_id", "n", "confidence", F.coalesce("quality_events", F.lit(0)).alias("quality_events"))


MIGRATIONS = [
    Migration(1, "tiers as ranks", lambda t: {"detections": t["detections"].withColumn("rank", F.when(F.col("alert_tier") == "hazard", 0).when(F.col("alert_tier") == "review", 1).when(F.col("alert_tier") == "anomaly", 2).otherwise(3)).drop("alert_tier")}),
    Migration(2, "flags one by one", lambda t: {"quality_events": t["quality_events"].withColumn("flag", F.explode(F.split("quality_flags", ";"))).drop("quality_flags")}),
]


@query("snk17_migrated_reports", """SELECT d.survey_id, flag, count(*) AS n, CAST(sum(CASE alert_tier WHEN 'hazard' THEN 0 WHEN 'review' THEN 1 WHEN 'anomaly' THEN 2 ELSE 3 END) AS BIGINT) AS ranks
 FROM (SELECT survey_id, event_id, alert_tier, unnest(string_split(quality_flags, ';')) AS flag FROM v_detection WHERE quality_flags <> '') d WHERE survey_id % 3 <> 0 OR alert_tier <> 'hidden' GROUP BY d.survey_id, flag""", D)
def snk17b(spark, d):
    """Stored reports after two migrations, of detections and of quality events."""
    kept = _stored(spark, d)
    kept.migrate(MIGRATIONS)
    both = kept.read("detections").join(kept.read("quality_events"), ["survey_id", "event_id"])
    return both.groupBy("survey_id", "flag").agg(F.count("*").alias("n"), F.sum("rank").alias("ranks"))


@query("snk11_track_segments", "SELECT line_id, ping // 50 AS segment, count(*) AS points, min(ping) AS first, max(ping) AS last FROM v_ping WHERE lon IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2", "v_ping")
def snk11c(spark, d):
    rows = view(spark, d, "v_ping").withColumn("segment", F.floor(F.col("ping") / 50))
    own = segments(rows, ["line_id", "segment"], "ping")
    return own.select("line_id", "segment", F.size("points").cast("long").alias("points"), F.get("points", F.lit(0))["at"].cast("long").alias("first"), F.element_at("points", -1)["at"].cast("long").alias("last"))
