"""Queries over detections: filters, orders, counts, clusters, scores and export rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pingframe.functions import geo, score, text
from pingframe.operators import filters, merging, ranking, reports, spatial
from pingframe.operators.filters import Wanted
from pingframe.plans.registry import query
from pingframe.plans.views import view

V = "v_detection"
COLS = ["detection_id", "cls", "confidence", "alert_tier", "lat", "lon", "area_m2", "ping_end"]
SHOWN = ", ".join(COLS)
WANTED = Wanted.of(classes="ghost_net, pipe,cylinder", min_conf=20, max_conf=95, tier="hazard,review,anomaly", flags="DROPOUT,HIGH_MOTION", bbox="80,13,80.009,13.009", include_rejected=False)
WHERE = """cls IN ('ghost_net', 'pipe', 'cylinder') AND confidence >= 20 AND confidence <= 95 AND alert_tier IN ('hazard', 'review', 'anomaly')
 AND (contains(quality_flags, 'DROPOUT') OR contains(quality_flags, 'HIGH_MOTION')) AND coalesce(review_status, 'pending') <> 'rejected' AND lon BETWEEN 80 AND 80.009e0 AND lat BETWEEN 13 AND 13.009e0"""


def detections(spark, d):
    return view(spark, d, V).withColumn("quality_flags", F.filter(F.split("quality_flags", ";"), lambda x: x != ""))


@query("flt01_predicates", f"SELECT {SHOWN} FROM v_detection WHERE {WHERE}", V)
def flt01(spark, d):
    return filters.filtered(detections(spark, d), WANTED).select(*COLS)


@query("flt03_filter_and_sort", f"SELECT detection_id, row_number() OVER (ORDER BY coalesce(area_m2, 0) DESC, detection_id) AS place FROM v_detection WHERE {WHERE}", V)
def flt03(spark, d):
    q = WANTED.but(sort="-area")
    return ranking.placed(filters.filtered(detections(spark, d), q).select("detection_id", "area_m2"), filters.ordering(q.sort), "place").select("detection_id", "place")


for _scope, _where in {"all": "TRUE", "hazards": "alert_tier = 'hazard'", "confirmed": "review_status IN ('confirmed', 'reclassified')", "filtered": WHERE}.items():
    @query(f"flt04_scope_{_scope}", f"SELECT {SHOWN} FROM v_detection WHERE ({_where}) AND coalesce(review_status, 'pending') <> 'rejected'", V)
    def flt04(spark, d, scope=_scope):
        return filters.scoped(detections(spark, d), scope, WANTED).select(*COLS)


@query("flt08_filtered_page", f"SELECT {SHOWN}, t.total FROM (SELECT *, count(*) OVER () AS total FROM v_detection WHERE {WHERE}) t ORDER BY confidence DESC, detection_id LIMIT 100 OFFSET 20", V)
def flt08(spark, d):
    rows = detections(spark, d)
    total = filters.filtered(rows, WANTED).agg(F.count("*").alias("total"))
    return filters.page(rows, WANTED, 20, 100).select(*COLS).join(F.broadcast(total))


@query("flt09_filtered_export", f"SELECT cls, alert_tier, count(*) AS n, count(*) FILTER (WHERE lat IS NOT NULL) AS geotagged FROM v_detection WHERE {WHERE} GROUP BY cls, alert_tier", V)
def flt09(spark, d):
    return filters.scoped(detections(spark, d), "filtered", WANTED).groupBy("cls", "alert_tier").agg(F.count("*").alias("n"), F.count("lat").alias("geotagged"))


@query("flt10_client_filter", f"SELECT {SHOWN} FROM v_detection WHERE alert_tier IN ('hazard', 'review', 'anomaly') AND confidence BETWEEN 30 AND 100 AND coalesce(review_status, 'pending') IN ('pending', 'confirmed')", V)
def flt10(spark, d):
    return filters.client_filtered(detections(spark, d), statuses=("pending", "confirmed")).select(*COLS)


@query("flt11_url_parameters", f"SELECT {SHOWN} FROM v_detection WHERE cls IN ('ghost_net', 'pipe') AND confidence <= 100 AND confidence >= 20 AND contains(quality_flags, 'DROPOUT')", V)
def flt11(spark, d):
    """Parameters of a link: names and fields that are not known are passed over, numbers held in their bounds."""
    q = Wanted.of_url("?class=ghost_net,boat,pipe&max_conf=250&min_conf=20&flags=DROPOUT,WET&sort=size&page=3&bbox=1,2")
    return filters.filtered(detections(spark, d), Wanted.of_url(q.url())).select(*COLS)


@query("flt12_output_predicates", """SELECT detection_id, CASE WHEN contains(quality_flags, 'DROPOUT') THEN 1 ELSE 0 END + CASE WHEN contains(quality_flags, 'HIGH_MOTION') THEN 1 ELSE 0 END + CASE WHEN lat IS NULL THEN 1 ELSE 0 END AS n_flags
 FROM v_detection WHERE confidence >= 25 AND ping_start >= 7 AND ping_end <= (SELECT max(ping_end) FROM v_detection) - 7""", V)
def flt12(spark, d):
    rows = detections(spark, d)
    last = rows.agg(F.max("ping_end").alias("last"))
    flags = F.array_compact(F.array(F.when(F.array_contains("quality_flags", "DROPOUT"), "DROPOUT"), F.when(F.array_contains("quality_flags", "HIGH_MOTION"), "HIGH_MOTION"), F.when(F.col("lat").isNull(), "NOT_GEOTAGGED")))
    kept = rows.join(F.broadcast(last)).where("confidence >= 25 and ping_start >= 7 and ping_end <= last - 7")
    return kept.select("detection_id", F.size(flags).alias("n_flags"))


@query("flt13_surface_band", """SELECT detection_id FROM v_detection WHERE anomaly >= 0.5 AND area_m2 >= 4e0 * (across_end - across_start)
 AND least((event_id * 7) % 180, 180 - (event_id * 7) % 180) <= 15""", V)
def flt13(spark, d):
    return detections(spark, d).where(filters.pipe_texture(F.col("anomaly"), F.col("area_m2"), F.col("across_end") - F.col("across_start"), (F.col("event_id") * 7).cast("double"))).select("detection_id")


@query("flt15_point_lookup", "SELECT detection_id, cls, confidence FROM v_detection WHERE event_id = 77", V)
def flt15(spark, d):
    return detections(spark, d).where("event_id = 77").select("detection_id", "cls", "confidence")


@query("flt16_next_pending", """SELECT detection_id, coalesce(min(CASE WHEN p THEN detection_id END) OVER (PARTITION BY survey_id ORDER BY detection_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(CASE WHEN p THEN detection_id END) OVER (PARTITION BY survey_id)) AS next_id
 FROM (SELECT *, review_status IS NULL AS p FROM v_detection)""", V)
def flt16(spark, d):
    """The next pending detection of a survey, from its last one on the first. Those ahead are walked from the end: a frame that ends there is
    summed up anew for every row."""
    pending = F.when(F.col("review_status").isNull(), F.col("detection_id"))
    ahead = Window.partitionBy("survey_id").orderBy(F.desc("detection_id")).rowsBetween(Window.unboundedPreceding, -1)
    return detections(spark, d).select("detection_id", F.coalesce(F.min(pending).over(ahead), F.min(pending).over(Window.partitionBy("survey_id"))).alias("next_id"))


for _sort, _sql in {"confidence": "confidence", "-confidence": "confidence DESC", "area": "coalesce(area_m2, 0)", "-area": "coalesce(area_m2, 0) DESC", "ping": "coalesce(ping_start, 0)", "-ping": "coalesce(ping_start, 0) DESC", "class": "cls"}.items():
    @query(f"srt01_by_{_sort.replace('-', 'falling_')}", f"SELECT detection_id, row_number() OVER (ORDER BY {_sql}, detection_id) AS place FROM v_detection", V)
    def srt01(spark, d, sort=_sort):
        rows = detections(spark, d).select("detection_id", "cls", "confidence", "area_m2", "ping_start")
        return ranking.placed(rows, filters.ordering(sort), "place").select("detection_id", "place")


@query("srt02_client_class", "SELECT detection_id, row_number() OVER (PARTITION BY survey_id ORDER BY cls, confidence DESC, detection_id) AS place FROM v_detection", V)
def srt02(spark, d):
    w = Window.partitionBy("survey_id").orderBy("cls", F.desc("confidence"), "detection_id")
    return detections(spark, d).select("detection_id", F.row_number().over(w).cast("long").alias("place"))


@query("srt03_page", "SELECT detection_id FROM v_detection ORDER BY confidence DESC, detection_id LIMIT 100 OFFSET 300", V)
def srt03(spark, d):
    return filters.page(detections(spark, d), Wanted(), 300, 100).select("detection_id")


@query("win14_sequential_ids", """SELECT detection_id, 'D' || lpad(CAST(row_number() OVER (PARTITION BY survey_id ORDER BY ping_start NULLS FIRST, across_start, cls, detection_id) AS VARCHAR), 4, '0') AS seq_id FROM v_detection WHERE confidence >= 25""", V)
def win14(spark, d):
    w = Window.partitionBy("survey_id").orderBy("ping_start", "across_start", "cls", "detection_id")
    return detections(spark, d).where("confidence >= 25").select("detection_id", F.concat(F.lit("D"), F.lpad(F.row_number().over(w).cast("string"), 4, "0")).alias("seq_id"))


@query("set01_union_lines", """SELECT survey_id, source_file, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM (SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY source_file, event_id) AS seq FROM v_detection) GROUP BY survey_id, source_file""", V)
def set01(spark, d):
    w = Window.partitionBy("survey_id").orderBy("source_file", "event_id")
    return detections(spark, d).withColumn("seq", F.row_number().over(w).cast("long")).groupBy("survey_id", "source_file").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("agg01_summary", "SELECT survey_id, count(*) AS total, count(DISTINCT cls) AS classes, string_agg(DISTINCT alert_tier, ',' ORDER BY alert_tier) AS tiers FROM v_detection GROUP BY survey_id", V)
def agg01(spark, d):
    return detections(spark, d).groupBy("survey_id").agg(F.count("*").alias("total"), F.countDistinct("cls").alias("classes"), F.array_join(F.array_sort(F.collect_set("alert_tier")), ",").alias("tiers"))


@query("agg02_class_and_tier_counts", "SELECT survey_id, cls, alert_tier, count(*) AS n FROM v_detection GROUP BY GROUPING SETS ((survey_id, cls), (survey_id, alert_tier), (survey_id))", V)
def agg02(spark, d):
    rows = detections(spark, d)
    return rows.groupingSets([[F.col("survey_id"), F.col("cls")], [F.col("survey_id"), F.col("alert_tier")], [F.col("survey_id")]], F.col("survey_id"), F.col("cls"), F.col("alert_tier")).agg(F.count("*").alias("n"))


@query("agg04_is_geotagged", "SELECT survey_id, bool_or(lat IS NOT NULL) AS geotagged FROM v_detection GROUP BY survey_id", V)
def agg04(spark, d):
    return detections(spark, d).groupBy("survey_id").agg(F.bool_or(F.col("lat").isNotNull()).alias("geotagged"))


@query("agg22_flag_histogram", "SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(quality_flags, ';')) AS flag FROM v_detection WHERE quality_flags <> '') GROUP BY flag", V)
def agg22(spark, d):
    return detections(spark, d).select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("agg24_review_counts", "SELECT cls, count(*) FILTER (WHERE review_status IS NULL) AS pending, count(*) FILTER (WHERE review_status = 'confirmed') AS confirmed, count(*) FILTER (WHERE review_status = 'rejected') AS rejected, count(*) FILTER (WHERE review_status = 'reclassified') AS reclassified FROM v_detection GROUP BY cls", V)
def agg24(spark, d):
    status = F.coalesce("review_status", F.lit("pending"))
    return detections(spark, d).groupBy("cls").agg(*[F.count_if(status == s).alias(s) for s in filters.STATUSES])


HAVERSINE = "2 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
LINKS = f"links AS (SELECT a.event_id AS x, b.event_id AS y FROM v_detection a JOIN v_detection b ON a.cls = b.cls AND a.event_id < b.event_id AND abs(a.lat - b.lat) < 1e-4 AND abs(a.lon - b.lon) < 1e-4 WHERE {HAVERSINE} <= 5)"


@query("jn01_near_pairs", f"{LINKS} SELECT x AS a, y AS b FROM links", V)
def jn01(spark, d):
    return spatial.near_pairs(detections(spark, d).select(F.col("event_id").alias("id"), "lat", "lon", "cls"), 5.0, ["cls"])


@query("agg05_clusters", f"""{LINKS}, both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT event_id AS n, event_id AS m FROM v_detection UNION SELECT r.n, b.y FROM reach r JOIN both_ways b ON r.m = b.x),
root AS (SELECT n, min(m) AS root FROM reach GROUP BY n),
agg AS (SELECT root, count(*) AS members, count(DISTINCT source_file) AS sources, arg_min(detection_id, (-confidence, detection_id)) AS kept, avg(lat) AS la, avg(lon) AS lo FROM root JOIN v_detection ON n = event_id GROUP BY root)
SELECT detection_id, cls, confidence, CASE WHEN members >= 2 AND sources >= 2 THEN round(la, 6) ELSE lat END AS lat, CASE WHEN members >= 2 AND sources >= 2 THEN round(lo, 6) ELSE lon END AS lon,
 CAST(CASE WHEN members >= 2 AND sources >= 2 THEN sources ELSE 1 END AS INTEGER) AS n_views, 1 - pow(0.5e0, CASE WHEN members >= 2 AND sources >= 2 THEN sources ELSE 1 END) AS persistence
FROM root JOIN v_detection ON n = event_id JOIN agg USING (root) WHERE NOT (members >= 2 AND sources >= 2) OR detection_id = kept /* RECURSIVE */""", V)
def agg05(spark, d):
    return spatial.clustered(detections(spark, d))


OVERLAP = """a.survey_id = b.survey_id AND a.cls = b.cls AND a.event_id < b.event_id AND a.ping_start <= b.ping_end AND b.ping_start <= a.ping_end AND a.across_start < b.across_end AND b.across_start < a.across_end"""
PAIR_IOU = """WITH_INTER AS (SELECT a.event_id AS a, b.event_id AS b, (least(a.ping_end, b.ping_end) - greatest(a.ping_start, b.ping_start) + 1) * (least(a.across_end, b.across_end) - greatest(a.across_start, b.across_start)) AS i,
 (a.ping_end - a.ping_start + 1) * (a.across_end - a.across_start) AS sa, (b.ping_end - b.ping_start + 1) * (b.across_end - b.across_start) AS sb FROM v_detection a JOIN v_detection b ON """ + OVERLAP + ")"


@query("jn02_box_overlaps", f"{PAIR_IOU} SELECT a, b, round(i / (sa + sb - i), 6) AS iou, round(i / least(sa, sb), 6) AS ios FROM WITH_INTER", V)
def jn02(spark, d):
    return merging.overlaps(detections(spark, d).where("ping_start is not null"), ["survey_id", "cls"]).select("a", "b", F.round("iou", 6).alias("iou"), F.round("ios", 6).alias("ios"))


#: A line's chunks are 1,200 pings from every 1,000th on; every second box in an overlap is the one that the chunk before saw.
CHUNKED = """c AS (SELECT *, floor((ping_start + ping_end) / 2e0 / 1000) AS k, (ping_start + ping_end) / 2e0 AS mid FROM v_detection WHERE ping_start IS NOT NULL),
 ch AS (SELECT * EXCLUDE (chunk_id), CAST(CASE WHEN event_id % 2 = 1 AND k > 0 AND mid - k * 1000 < 200 THEN k - 1 ELSE k END AS BIGINT) AS chunk_id FROM c),
 b AS (SELECT *, least(mid - chunk_id * 1000, chunk_id * 1000 + 1200 - mid) AS margin FROM ch)"""


def chunked(spark, d):
    rows = detections(spark, d).where("ping_start is not null").withColumn("mid", (F.col("ping_start") + F.col("ping_end")) / 2)
    k = F.floor(F.col("mid") / 1000)
    before = (F.col("event_id") % 2 == 1) & (k > 0) & (F.col("mid") - k * 1000 < 200)
    rows = rows.withColumn("chunk_id", F.when(before, k - 1).otherwise(k).cast("long"))
    return rows.withColumn("chunk_start", F.col("chunk_id") * 1000).withColumn("chunk_end", F.col("chunk_id") * 1000 + 1200)


@query("jn03_chunk_dedupe", f"""{CHUNKED}, p AS (SELECT a.event_id AS a, b.event_id AS b FROM (SELECT x.event_id AS a, y.event_id AS b, (least(x.ping_end, y.ping_end) - greatest(x.ping_start, y.ping_start) + 1) * (least(x.across_end, y.across_end) - greatest(x.across_start, y.across_start)) AS i,
  (x.ping_end - x.ping_start + 1) * (x.across_end - x.across_start) AS sa, (y.ping_end - y.ping_start + 1) * (y.across_end - y.across_start) AS sb FROM b x JOIN b y ON x.survey_id = y.survey_id AND x.cls = y.cls AND x.chunk_id <> y.chunk_id
  AND x.ping_start <= y.ping_end AND y.ping_start <= x.ping_end AND x.across_start < y.across_end AND y.across_start < x.across_end) q JOIN b a ON a.event_id = q.a JOIN b ON b.event_id = q.b WHERE q.i / (q.sa + q.sb - q.i) >= 0.3),
 n AS (SELECT a, list(b) AS near FROM p GROUP BY a),
 o AS (SELECT event_id, survey_id, cls, near, row_number() OVER (PARTITION BY survey_id, cls ORDER BY margin DESC, confidence DESC, chunk_id, event_id) AS i FROM b LEFT JOIN n ON a = event_id),
 walk AS (SELECT DISTINCT survey_id, cls, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept FROM o UNION ALL
  SELECT o.survey_id, o.cls, o.i, CASE WHEN o.near IS NULL OR NOT list_has_any(w.kept, o.near) THEN list_append(w.kept, o.event_id) ELSE w.kept END FROM walk w JOIN o ON o.survey_id = w.survey_id AND o.cls = w.cls AND o.i = w.i + 1)
 SELECT unnest(kept) AS event_id FROM walk w WHERE i = (SELECT max(i) FROM o WHERE o.survey_id = w.survey_id AND o.cls = w.cls) /* RECURSIVE */""", V)
def jn03(spark, d):
    return merging.kept_across_chunks(chunked(spark, d), 0.3).select("event_id")


@query("jn02_merged_boxes")
def jn02b(spark, d):
    """Boxes of a chunk's image and class united to a fixed point; tests hold it against a plain walk."""
    rows = chunked(spark, d).select("survey_id", "chunk_id", "cls", F.col("across_start").alias("x1"), F.col("across_end").alias("x2"), F.col("ping_start").alias("y1"), (F.col("ping_end") + 1).alias("y2"), F.col("confidence").alias("score"))
    return merging.merged_boxes(rows, ["survey_id", "chunk_id"])


@query("scl10_fuse", """SELECT detection_id, CASE WHEN w = 0 THEN 0e0 ELSE round(least(1e0, greatest(0e0, s / w - CASE WHEN contains(quality_flags, 'DROPOUT') THEN 0.1e0 ELSE 0e0 END - CASE WHEN contains(quality_flags, 'HIGH_MOTION') THEN 0.05e0 ELSE 0e0 END)), 6) END AS fused
 FROM (SELECT *, 0.5e0 + 0.3e0 + CASE WHEN area_m2 IS NULL THEN 0e0 ELSE 0.2e0 END AS w, 0.5e0 * confidence / 100 + 0.3e0 * anomaly + coalesce(0.2e0 * area_m2 / 50, 0e0) AS s FROM v_detection)""", V)
def scl10(spark, d):
    parts = [(F.col("confidence") / 100, 0.5), (F.col("anomaly"), 0.3), (F.col("area_m2") / 50, 0.2)]
    penalties = [F.when(F.array_contains("quality_flags", "DROPOUT"), 0.1), F.when(F.array_contains("quality_flags", "HIGH_MOTION"), 0.05)]
    return detections(spark, d).select("detection_id", F.round(score.fused(parts, penalties), 6).alias("fused"))


@query("scl11_tier", "SELECT detection_id, CASE WHEN round(confidence, 1) >= 80 THEN 'hazard' WHEN round(confidence, 1) >= 50 THEN 'review' WHEN anomaly >= 0.5 AND round(confidence, 1) >= 30 THEN 'anomaly' ELSE 'hidden' END AS tier FROM v_detection", V)
def scl11(spark, d):
    return detections(spark, d).select("detection_id", score.tier(F.round("confidence", 1), F.col("anomaly")).alias("tier"))


@query("scl12_review_status", "SELECT coalesce(review_status, 'pending') AS status, count(*) AS n FROM v_detection GROUP BY 1", V)
def scl12(spark, d):
    return detections(spark, d).groupBy(F.coalesce("review_status", F.lit("pending")).alias("status")).agg(F.count("*").alias("n"))


@query("scl02_valid_coordinates", "SELECT survey_id, coalesce(bool_and(abs(lat) <= 90 AND abs(lon) <= 180), FALSE) AS geographic FROM v_detection WHERE NOT (coalesce(lat, 1) = 0 AND coalesce(lon, 1) = 0) GROUP BY survey_id", V)
def scl02(spark, d):
    return detections(spark, d).where(~((F.coalesce("lat", F.lit(1.0)) == 0) & (F.coalesce("lon", F.lit(1.0)) == 0))).groupBy("survey_id").agg(F.coalesce(F.bool_and((F.abs("lat") <= 90) & (F.abs("lon") <= 180)), F.lit(False)).alias("geographic"))


@query("scl03_utm_zone", "SELECT detection_id, CAST(CASE WHEN lat IS NULL THEN 0 ELSE 32600 + least(floor((lon * (event_id % 5 - 2) + 180) / 6) + 1, 60) END AS INTEGER) AS epsg FROM v_detection", V)
def scl03(spark, d):
    return detections(spark, d).select("detection_id", F.coalesce(geo.utm_epsg(F.col("lat"), F.col("lon") * (F.col("event_id") % 5 - 2)), F.lit(0)).alias("epsg"))


@query("scl05_dms", """SELECT detection_id, printf('%.6f', lat) AS decimal_lat, printf('%02d° %02d'' %02d.%02d" N', CAST(t // 360000 AS BIGINT), CAST(t % 360000 // 6000 AS BIGINT), CAST(t % 6000 // 100 AS BIGINT), CAST(t % 100 AS BIGINT)) AS dms
 FROM (SELECT detection_id, lat, CAST(round_even(lat * 360000, 0) AS BIGINT) AS t FROM v_detection WHERE lat IS NOT NULL)""", V)
def scl05(spark, d):
    return detections(spark, d).where("lat is not null").select("detection_id", F.format_string("%.6f", "lat").alias("decimal_lat"), geo.dms(F.col("lat"), "N", "S").alias("dms"))


@query("scl08_wkt", "SELECT detection_id, 'POINT (' || printf('%.6f', lon) || ' ' || printf('%.6f', lat) || ')' AS wkt, round(lon, 6) AS x FROM v_detection WHERE lat IS NOT NULL", V)
def scl08(spark, d):
    made = detections(spark, d).where("lat is not null").select("detection_id", text.wkt_point(F.col("lon"), F.col("lat")).alias("wkt"))
    return made.withColumn("x", text.wkt_numbers(F.col("wkt"))[0])


def reported(spark, d):
    """Detections with all that a report shows; sizes and places that the given tables lack are made from their numbers."""
    n = F.col("event_id")
    return detections(spark, d).withColumns({
        "depth_m": F.when(n % 4 > 0, n % 40), "uncertainty_m": n % 9 + 1, "length_m": n % 25, "width_m": F.when(n % 6 > 0, n % 8), "height_m": F.when(n % 5 == 0, n % 3), "orientation_deg": n % 180,
        "side": F.when(F.col("across_start") < 0, "port").otherwise("starboard"), "ground_range_m": n % 50, "n_views": n % 3 + 1, "area_m2": F.floor("area_m2"), "time_utc": F.date_format("time_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "footprint": F.when(F.col("lat").isNotNull() & (n % 4 < 3), F.transform(F.slice(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (1, 1), (1, 0))]), 1, (n % 4 + 2).cast("int")),
            lambda p: F.struct((F.col("lat") + p["a"] * 1e-4).alias("lat"), (F.col("lon") + p["b"] * 1e-4).alias("lon")))),
    })


@query("snk01_csv_rows", """SELECT concat_ws(',', detection_id, survey_id, cls, printf('%.1f', floor(confidence)), alert_tier, coalesce(printf('%.6f', lat), ''), coalesce(printf('%.6f', lon), ''), CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 40 AS VARCHAR) ELSE '' END,
 event_id % 9 + 1, event_id % 25, CASE WHEN event_id % 6 > 0 THEN CAST(event_id % 8 AS VARCHAR) ELSE '' END, coalesce(CAST(CAST(floor(area_m2) AS BIGINT) AS VARCHAR), ''), CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 3 AS VARCHAR) ELSE '' END, event_id % 180, CASE WHEN across_start < 0 THEN 'port' ELSE 'starboard' END,
 coalesce(CAST(ping_start AS VARCHAR), ''), ping_end, event_id % 50, strftime(time_utc, '%Y-%m-%dT%H:%M:%SZ'), event_id % 3 + 1, quality_flags, coalesce(review_status, 'pending'), source_file) AS line FROM v_detection""", V)
def snk01(spark, d):
    rows = reports.rows(reported(spark, d).withColumn("confidence", F.floor("confidence")))
    return rows.select(F.concat_ws(",", *reports.COLUMNS).alias("line"))


@query("snk03_geojson_features", """g AS (SELECT *, printf('[%.5f,%.5f]', lon, lat) AS p FROM (SELECT *, round(lat, 5) + 1e-9 AS la, round(lon, 5) + 1e-9 AS lo FROM v_detection WHERE lat IS NOT NULL)),
 t AS (SELECT survey_id, count(*) AS n FROM g WHERE event_id % 100 < 2 GROUP BY survey_id HAVING count(*) >= 2)
 SELECT survey_id, 'detection' AS kind, detection_id AS key, 'Point' AS shape, 1 AS corners, cls AS class FROM g
 UNION ALL SELECT survey_id, 'footprint', detection_id, 'Polygon', event_id % 4 + 3, cls FROM g WHERE event_id % 4 IN (1, 2)
 UNION ALL SELECT survey_id, 'track', CAST(survey_id AS VARCHAR), 'LineString', n, NULL FROM t""", V)
def snk03(spark, d):
    """What the features say of themselves; their texts are read back."""
    rows = reported(spark, d)
    points = rows.where("lat is not null and event_id % 100 < 2").groupBy("survey_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("points"))
    out = reports.features(rows, points)
    shape = F.get_json_object("feature", "$.geometry.type")
    places = F.get_json_object("feature", "$.geometry.coordinates")
    corners = F.when(shape == "Point", 1).otherwise(F.size(F.regexp_extract_all(places, F.lit(r"(\[[-0-9.E]+,[-0-9.E]+\])"), F.lit(1)))).cast("long")
    return out.select("survey_id", "kind", "key", shape.alias("shape"), corners.alias("corners"), F.get_json_object("feature", "$.properties.class").alias("class"))


@query("snk03_geojson_points", """SELECT detection_id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || printf('%.6f', lon) || ',' || printf('%.6f', lat) || ']},"properties":{"class":"' || cls || '","tier":"' || alert_tier || '"}}' AS feature FROM v_detection WHERE lat IS NOT NULL""", V)
def snk03b(spark, d):
    return detections(spark, d).where("lat is not null").select("detection_id", text.geojson_point(F.col("lon"), F.col("lat"), {"class": F.col("cls"), "tier": F.col("alert_tier")}).alias("feature"))


@query("snk04_kml_placemarks", """SELECT survey_id, cls, '<Folder><name>' || cls || '</name>' || string_agg('<Placemark><name>' || detection_id || '</name><Point><coordinates>' || printf('%.6f', lon) || ',' || printf('%.6f', lat) || ',0</coordinates></Point></Placemark>', '' ORDER BY detection_id) || '</Folder>' AS folder FROM v_detection WHERE lat IS NOT NULL GROUP BY survey_id, cls""", V)
def snk04(spark, d):
    return text.kml_folders(detections(spark, d).where("lat is not null"), ["survey_id"])


@query("snk08_alert_lines", """SELECT detection_id, 'SS1|' || CAST(survey_id AS VARCHAR) || '|' || substr(detection_id, 9) || '|' || cls || '|' || printf('%.0f', floor(confidence)) || '|' || coalesce(printf('%.6f', lat), '') || '|' || coalesce(printf('%.6f', lon), '') || '||' || coalesce(printf('%.1f', floor(area_m2 * 10) / 10), '') || '|' || strftime(time_utc, '%Y-%m-%dT%H:%M:%SZ') AS line FROM v_detection WHERE confidence >= 50""", V)
def snk08(spark, d):
    rows = detections(spark, d).where("confidence >= 50")
    return rows.select("detection_id", text.alert(F.col("survey_id"), F.col("detection_id"), F.col("cls"), F.floor("confidence"), F.col("lat"), F.col("lon"), F.lit(""), F.floor(F.col("area_m2") * 10) / 10, F.col("time_utc")).alias("line"))


@query("jn09_nearest_detection", f"""SELECT a.event_id AS truth_id, arg_min(b.event_id, ({HAVERSINE}, b.event_id)) AS nearest_id, round(min({HAVERSINE}), 3) AS metres FROM v_detection a JOIN v_detection b
 ON abs(a.lat - b.lat) < 6e-4 AND abs(a.lon - b.lon) < 6e-4 AND b.cls IN ('shipwreck', 'debris_other') WHERE a.cls = 'unknown_anomaly' AND {HAVERSINE} <= 50 GROUP BY a.event_id""", V)
def jn09(spark, d):
    rows = detections(spark, d).select(F.col("event_id").alias("id"), "lat", "lon", "cls")
    return merging.nearest(rows.where("cls = 'unknown_anomaly'"), rows.where("cls in ('shipwreck', 'debris_other')"), 50.0).select(F.col("id").alias("truth_id"), "nearest_id", F.round("metres", 3).alias("metres"))
