"""The given tables seen as survey data. Each view is SQL that Spark and DuckDB read alike (1e0 is a double in both)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: events as detections: groups of three neighbours 0, 2.2 and 4.4 m apart, every tenth without a position.
DETECTION = """
SELECT concat('SRV-', lpad(cast(user_id % 20 as string), 3, '0'), '-D', lpad(cast(event_id as string), 7, '0')) AS detection_id,
  user_id % 20 AS survey_id, concat('line_', cast(user_id % 5 as string)) AS source_file, event_id,
  CASE WHEN event_id % 11 = 0 THEN 'unknown_anomaly' WHEN event_type = 'click' THEN 'ghost_net' WHEN event_type = 'view' THEN 'cylinder'
       WHEN event_type = 'error' THEN 'debris_other' WHEN event_type = 'purchase' THEN 'pipe' ELSE 'shipwreck' END AS cls,
  least(value, 100e0) AS confidence, (event_id % 97) / 97e0 AS anomaly,
  CASE WHEN least(value, 100e0) >= 80e0 THEN 'hazard' WHEN least(value, 100e0) >= 50e0 THEN 'review'
       WHEN (event_id % 97) / 97e0 >= 5e-1 AND least(value, 100e0) >= 30e0 THEN 'anomaly' ELSE 'hidden' END AS alert_tier,
  CASE WHEN event_id % 10 = 9 THEN NULL ELSE 13e0 + (((event_id - event_id % 3) * 7919) % 10007) / 1e6 + (event_id % 3) * 2e-5 END AS lat,
  CASE WHEN event_id % 10 = 9 THEN NULL ELSE 80e0 + (((event_id - event_id % 3) * 104729) % 10009) / 1e6 END AS lon,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE ((event_id * 31) % 997) / 20e0 END AS area_m2,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE (event_id * 13) % 5000 END AS ping_start, (event_id * 13) % 5000 + event_id % 40 AS ping_end,
  (event_id * 17 % 1000) / 10e0 - 50e0 AS across_start, (event_id * 17 % 1000) / 10e0 - 50e0 + 1e0 + event_id % 5 AS across_end, event_id % 4 AS chunk_id,
  concat_ws(';', CASE WHEN event_id % 3 = 0 THEN 'DROPOUT' END, CASE WHEN event_id % 5 = 0 THEN 'HIGH_MOTION' END,
    CASE WHEN event_id % 10 = 9 THEN 'NOT_GEOTAGGED' END) AS quality_flags,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'confirmed' WHEN 2 THEN 'rejected' ELSE 'reclassified' END AS review_status, ts AS time_utc
FROM events
"""

#: events as navigation: one line a user; values over 200 jump half a degree, every 17th longitude and 13th altitude is missing.
PING = """
SELECT user_id AS line_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ping, ts AS time_utc, event_type, value,
  13e0 + user_id * 1e-3 + (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 1e-5 + CASE WHEN value > 200 THEN 5e-1 ELSE 0e0 END AS lat,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE 80e0 + (event_id % 3) * 1e-6 END AS lon,
  (event_id * 37) % 360 * 1e0 AS heading_deg, (event_id % 23 - 11) * 1e0 AS roll_deg, 50e0 + event_id % 7 AS slant_range_m,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE 5e0 + event_id % 10 END AS altitude_m, (event_id % 50) / 1e1 AS speed_mps,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE (event_id % 120) * 1e0 END AS cable_out_m, (event_id % 40) * 1e0 AS sensor_depth_m,
  CASE WHEN event_id % 4 = 0 THEN 'ship' WHEN event_id % 4 = 1 THEN 'csv' ELSE 'sensor' END AS nav_source
FROM events
"""

#: labels and documents as scored detections, images and predictions of an evaluation.
SCORED = """
SELECT l.doc_id, d.source AS grp, d.lang, l.quality AS label, l.toxic, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS score,
  CAST(d.n_chars % 777 AS DOUBLE) / 777 AS anomaly, CAST(l.doc_id % 101 AS DOUBLE) / 101 AS shadow
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""

#: documents as dataset items; a site is a source and language.
ITEM = "SELECT doc_id, concat(source, ':', lang) AS site, lang AS dataset, n_chars AS objects, sha256(text) AS digest, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM documents"

#: orders as surveys of customers' nations, their lines as source files.
SURVEY = """
SELECT o_orderkey AS survey_key, concat('SRV-', lpad(cast(o_orderkey as string), 8, '0')) AS survey_id, concat(c_mktsegment, ' survey ', c_name) AS name, c_nationkey AS project_id,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS created_utc, o_totalprice AS track_m
FROM orders JOIN customer ON o_custkey = c_custkey
"""
SOURCE_FILE = "SELECT l_orderkey AS survey_key, l_linenumber AS file_no, concat(p_name, '.xtf') AS filename, CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes, CAST(floor(l_quantity) AS BIGINT) AS pings FROM lineitem JOIN part ON l_partkey = p_partkey"

#: events as the numbered event stream of a job.
JOB_EVENT = """
SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts, event_id % 37 AS detection_key, value,
  CASE event_type WHEN 'click' THEN 'detection' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'detection_update' WHEN 'error' THEN 'warning' ELSE 'detection_removed' END AS type
FROM events
"""

#: conversations as review decisions, pages as files for admission.
REVIEW = "SELECT conv_id AS detection_key, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'rejected' ELSE 'reclassified' END AS status, length(text) AS note_chars FROM conversations"
FILE = "SELECT page_id, url AS path, html AS content FROM pages"

ALL = {"v_detection": DETECTION, "v_ping": PING, "v_scored": SCORED, "v_item": ITEM, "v_survey": SURVEY, "v_source_file": SOURCE_FILE, "v_job_event": JOB_EVENT, "v_review": REVIEW, "v_file": FILE}
READS = {"v_detection": ["events"], "v_ping": ["events"], "v_scored": ["labels", "documents"], "v_item": ["documents"], "v_survey": ["orders", "customer"], "v_source_file": ["lineitem", "part"], "v_job_event": ["events"], "v_review": ["conversations"], "v_file": ["pages"]}

#: embeddings as a waterfall: a ping is a vector, 32 port samples (nadir first) and 32 starboard ones.
SAMPLE_SQL = """
SELECT vec_id AS ping, 'port' AS side, 32 - i AS sample, CAST(floor(abs(embedding[i]) * 1000) AS BIGINT) AS v FROM embeddings, unnest(range(1, 33)) AS x(i)
UNION ALL SELECT vec_id, 'starboard', i - 33, CAST(floor(abs(embedding[i]) * 1000) AS BIGINT) FROM embeddings, unnest(range(33, 65)) AS x(i)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ALL over the tables in sf_dir."""
    sql = ALL[name].replace("sha256(text)", "sha2(text, 256)")
    return spark.sql(_braced(sql, READS[name]), **{t: table(spark, sf_dir, t) for t in READS[name]})


def _braced(sql: str, tables: list[str]) -> str:
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return sql


def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ping, port, starboard): sample arrays, nadir first."""
    level = lambda a: F.transform(a, lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("long"))
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ping"), level(F.reverse(F.slice(e, 1, 32))).alias("port"), level(F.slice(e, 33, 32)).alias("starboard"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ping, side, sample, v), a row for each sample."""
    w = waterfall(spark, sf_dir)
    one = lambda side: w.select("ping", F.lit(side).alias("side"), F.posexplode(side).alias("sample", "v"))
    return one("port").unionByName(one("starboard"))


def oracle(sql: str, *views: str) -> str:
    """DuckDB SQL with the named views as common table expressions."""
    parts = [f"{v} AS ({SAMPLE_SQL.replace('embedding[i]', 'CAST(embedding[i] AS DOUBLE)') if v == 'v_sample' else ALL[v]})" for v in views]
    return f"WITH {'RECURSIVE ' if 'RECURSIVE' in sql else ''}{', '.join(parts)}{', ' if not sql.lstrip().upper().startswith('SELECT') else ' '}{sql.replace('RECURSIVE ', '')}"
