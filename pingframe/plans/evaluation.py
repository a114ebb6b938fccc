"""Queries that evaluate scored detections and data sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pingframe.operators import catalogue, evaluation, matching, merging
from pingframe.plans.registry import query
from pingframe.plans.views import view

V = "v_scored"


def scored(spark, d):
    return view(spark, d, V)


@query("agg13_calibration_bins", "SELECT lang, CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS mean_label FROM v_scored GROUP BY 1, 2", V)
def agg13(spark, d):
    out = evaluation.calibration_bins(scored(spark, d), ["lang"], "score", "label")
    return out.select("lang", F.col("bin").cast("long").alias("bin"), "n", F.round("mean_score", 6).alias("mean_score"), F.round("mean_label", 6).alias("mean_label"))


@query("agg13_calibration_error", "SELECT lang, round(sum(gap) / sum(n), 6) AS ece FROM (SELECT lang, count(*) AS n, abs(avg(label) - avg(score)) * count(*) AS gap FROM v_scored GROUP BY lang, least(floor(score * 10), 9)) GROUP BY lang", V)
def agg13b(spark, d):
    return evaluation.calibration_error(scored(spark, d), ["lang"], "score", "label").select("lang", F.round("ece", 6).alias("ece"))


@query("agg14_auroc", """SELECT lang, round(sum(CASE WHEN p.score > n.score THEN 1e0 WHEN p.score = n.score THEN 5e-1 ELSE 0 END) / count(*), 6) AS auroc FROM v_scored p JOIN (SELECT lang, score FROM v_scored WHERE label = 0) n USING (lang) WHERE p.label = 1 GROUP BY lang""", V)
def agg14(spark, d):
    return evaluation.auroc(scored(spark, d), ["lang"], "score", "label").where("auroc is not null").select("lang", F.round("auroc", 6).alias("auroc"))


RANK = "r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS k, sum(label) OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS hits FROM v_scored)"


@query("agg15_average_precision", f"{RANK} SELECT lang, round(sum(CASE WHEN label = 1 THEN hits / CAST(k AS DOUBLE) END) / sum(label), 6) AS ap FROM r GROUP BY lang HAVING sum(label) > 0", V)
def agg15(spark, d):
    return evaluation.average_precision(scored(spark, d), ["lang"], "score", "label", "doc_id").where("ap is not null").select("lang", F.round("ap", 6).alias("ap"))


@query("agg16_average_precision_101", f"""{RANK}, n AS (SELECT lang, sum(label) AS n FROM v_scored GROUP BY lang) SELECT lang, round(sum(best) / 101, 6) AS ap FROM (SELECT n.lang, g, max(CASE WHEN hits / CAST(n AS DOUBLE) >= g / 100e0 - 1e-9 THEN hits / CAST(k AS DOUBLE) ELSE 0 END) AS best FROM n JOIN r USING (lang), unnest(range(0, 101)) AS x(g) WHERE label = 1 GROUP BY n.lang, g) GROUP BY lang""", V)
def agg16(spark, d):
    return evaluation.average_precision_101(scored(spark, d), ["lang"], "score", "label", "doc_id").select("lang", F.round("ap", 6).alias("ap"))


@query("agg17_per_class_metrics", "SELECT grp, round(avg(CASE WHEN label = 1 THEN 1e0 ELSE 0e0 END) FILTER (WHERE score >= 0.25), 6) AS precision, round(count(*) FILTER (WHERE label = 1 AND score >= 0.25) / CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE), 6) AS recall FROM v_scored GROUP BY grp HAVING count(*) FILTER (WHERE label = 1) > 0", V)
def agg17(spark, d):
    found = (F.col("score") >= 0.25)
    hit = F.count_if(found & (F.col("label") == 1))
    out = scored(spark, d).groupBy("grp").agg(F.round(F.try_divide(hit, F.count_if(found)), 6).alias("precision"), F.round(F.try_divide(hit, F.sum("label")), 6).alias("recall"))
    return out.where("recall is not null")


def greedy(same: str, order: str, least: str = "TRUE") -> str:
    """SQL of one-to-one matches of even (truth) and odd (prediction) boxes with equal `same` columns: pairs in `order`, each if both are
    still free. Ends in o (pairs) and w (steps with take)."""
    on = " AND ".join(f"x.{c} = y.{c}" for c in same.split(", "))
    key = " AND ".join(f"o.{c} = w.{c}" for c in same.split(", "))
    own = ", ".join(f"o.{c}" for c in same.split(", "))
    free = "NOT list_contains(w.used, o.truth * 2) AND NOT list_contains(w.used, o.prediction * 2 + 1)"
    return f"""q AS (SELECT x.survey_id, x.cls, y.cls AS prediction_cls, x.event_id AS truth, y.event_id AS prediction, y.confidence, (least(x.ping_end, y.ping_end) - greatest(x.ping_start, y.ping_start) + 1) * (least(x.across_end, y.across_end) - greatest(x.across_start, y.across_start)) AS i,
  (x.ping_end - x.ping_start + 1) * (x.across_end - x.across_start) AS sa, (y.ping_end - y.ping_start + 1) * (y.across_end - y.across_start) AS sb FROM v_detection x JOIN v_detection y ON {on} AND x.event_id % 2 = 0 AND y.event_id % 2 = 1
  AND x.ping_start <= y.ping_end AND y.ping_start <= x.ping_end AND x.across_start < y.across_end AND y.across_start < x.across_end),
 r AS (SELECT *, i / (sa + sb - i) AS iou FROM q), o AS (SELECT *, row_number() OVER (PARTITION BY {same} ORDER BY {order}) AS k FROM r WHERE {least}),
 w AS (SELECT DISTINCT {same}, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, FALSE AS take FROM o UNION ALL
  SELECT {own}, o.k, CASE WHEN {free} THEN list_concat(w.used, [o.truth * 2, o.prediction * 2 + 1]) ELSE w.used END, {free} FROM w JOIN o ON {key} AND o.k = w.k + 1)"""


BY_CONFIDENCE = "confidence DESC, prediction, iou DESC, truth DESC"


def rated(spark, d):
    """Odd events as predictions that hit a truth of their class where they overlap by a twentieth, even ones as truths."""
    boxes = view(spark, d, "v_detection").where("ping_start is not null")
    met = matching.truth_matches(boxes, ["survey_id", "cls"], 0.05).select(F.col("prediction").alias("event_id"), F.lit(1).alias("hit"))
    own = boxes.where("event_id % 2 = 1").join(met, "event_id", "left")
    predictions = own.select("cls", "survey_id", F.col("event_id").alias("id"), (F.col("confidence") / 100).alias("score"), F.coalesce("hit", F.lit(0)).alias("hit"))
    return predictions, boxes.where("event_id % 2 = 0").select("cls", "survey_id")


@query("agg17_per_class_ap", greedy("survey_id, cls", BY_CONFIDENCE, "iou >= 0.05") + """, m AS (SELECT prediction FROM o JOIN w USING (survey_id, cls, k) WHERE take), p AS (SELECT cls, event_id AS id, confidence / 100 AS score, CASE WHEN event_id IN (SELECT prediction FROM m) THEN 1 ELSE 0 END AS hit FROM v_detection WHERE ping_start IS NOT NULL AND event_id % 2 = 1),
 n AS (SELECT cls, count(*) AS n FROM v_detection WHERE ping_start IS NOT NULL AND event_id % 2 = 0 GROUP BY cls), h AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, id) AS rk, sum(hit) OVER (PARTITION BY cls ORDER BY score DESC, id) AS hits FROM p),
 a AS (SELECT n.cls, g, max(CASE WHEN hit = 1 AND hits / CAST(n AS DOUBLE) >= g / 100e0 - 1e-9 THEN hits / CAST(rk AS DOUBLE) ELSE 0 END) AS best FROM n LEFT JOIN h USING (cls), unnest(range(0, 101)) AS x(g) GROUP BY n.cls, g)
 SELECT cls, any_value(n) AS n_truth, round(any_value(ap), 6) AS ap, round(avg(hit) FILTER (WHERE score >= 0.25), 6) AS precision, round(sum(hit) FILTER (WHERE score >= 0.25) / CAST(any_value(n) AS DOUBLE), 6) AS recall FROM p JOIN n USING (cls) JOIN (SELECT cls, sum(best) / 101 AS ap FROM a GROUP BY cls) USING (cls) GROUP BY cls /* RECURSIVE */""", "v_detection")
def agg17b(spark, d):
    predictions, truths = rated(spark, d)
    return evaluation.per_class(predictions, truths).select("cls", "n_truth", *[F.round(c, 6).alias(c) for c in ("ap", "precision", "recall")])


@query("agg17_bootstrap_map")
def agg17c(spark, d):
    """Percentiles of the mean average precision over resampled surveys; tests draw them anew."""
    return evaluation.bootstrap_map(*rated(spark, d), "survey_id")


CUMULATED = " + ".join(f"CASE WHEN u >= {p} THEN 1 ELSE 0 END" for p in evaluation.POISSON)


@query("agg18_bootstrap", f"""p AS (SELECT grp, least(floor(score * 10), 9) AS bin, count(*) AS n, sum(score) AS s, sum(label) AS y FROM v_scored GROUP BY 1, 2),
 d AS (SELECT r, bin, n, s, y, {CUMULATED} AS w FROM (SELECT *, ('0x' || substr(md5(grp || ':' || r), 1, 8))::BIGINT / 4294967296e0 AS u FROM p, unnest(range(1, 201)) AS x(r))),
 e AS (SELECT r, sum(gap) / sum(n) AS e FROM (SELECT r, bin, sum(n * w) AS n, abs(sum(y * w) - sum(s * w)) AS gap FROM d WHERE w > 0 GROUP BY r, bin) GROUP BY r)
 SELECT round(quantile_cont(e, 0.025), 6) AS low, round(quantile_cont(e, 0.5), 6) AS middle, round(quantile_cont(e, 0.975), 6) AS high FROM e""", V)
def agg18(spark, d):
    """Percentiles of the calibration error over resampled sources."""
    out = evaluation.bootstrap_calibration(scored(spark, d), "grp", "score", "label")
    return out.select(*[F.round(c, 6).alias(c) for c in ("low", "middle", "high")])


@query("ras14_isotonic", """s AS (SELECT lang, score, label, doc_id, row_number() OVER (PARTITION BY lang ORDER BY score, doc_id) AS i FROM v_scored), c AS (SELECT lang, i, sum(label) OVER (PARTITION BY lang ORDER BY i) AS c FROM s UNION ALL SELECT DISTINCT lang, 0, 0 FROM s),
 m AS (SELECT a.lang, a.i AS j, b.i AS k, (b.c - a.c) / CAST(b.i - a.i AS DOUBLE) AS mean FROM c a JOIN c b ON a.lang = b.lang AND b.i > a.i),
 lo AS (SELECT s.lang, s.i, m.j, min(m.mean) AS v FROM s JOIN m ON m.lang = s.lang AND m.j < s.i AND m.k >= s.i GROUP BY s.lang, s.i, m.j) SELECT s.doc_id, round(max(v), 6) AS fitted FROM s JOIN lo USING (lang, i) GROUP BY s.doc_id""", V)
def ras14(spark, d):
    return evaluation.isotonic(scored(spark, d), ["lang"], "score", "label", "doc_id").select("doc_id", F.round("fitted", 6).alias("fitted"))


@query("int04_calibrated", "SELECT doc_id, round(CASE WHEN score <= 0.1 THEN 0.05 WHEN score <= 0.4 THEN 0.05 + 0.45 * (score - 0.1) / 0.3 WHEN score <= 0.8 THEN 0.5 + 0.4 * (score - 0.4) / 0.4 ELSE 0.9 END, 6) AS calibrated FROM v_scored", V)
def int04(spark, d):
    return scored(spark, d).select("doc_id", F.round(evaluation.looked_up(F.col("score"), [0.1, 0.4, 0.8], [0.05, 0.5, 0.9]), 6).alias("calibrated"))


@query("ras16_weight_grid", """g AS (SELECT a / 20e0 AS w0, b / 20e0 AS w1, (20 - a - b) / 20e0 AS w2 FROM unnest(range(0, 21)) AS x(a), unnest(range(0, 21)) AS y(b) WHERE a + b <= 20), s AS (SELECT w0, w1, w2, doc_id, label, round(score * w0 + anomaly * w1 + shadow * w2, 9) AS s FROM v_scored, g),
 r AS (SELECT *, row_number() OVER (PARTITION BY w0, w1 ORDER BY s DESC, doc_id) AS k, sum(label) OVER (PARTITION BY w0, w1 ORDER BY s DESC, doc_id) AS hits FROM s), a AS (SELECT w0, w1, w2, sum(CASE WHEN label = 1 THEN hits / CAST(k AS DOUBLE) END) / sum(label) AS ap FROM r GROUP BY w0, w1, w2)
 SELECT w0, w1, w2, round(ap, 6) AS ap FROM a ORDER BY round(a.ap, 9) DESC, round(pow(w0 - 0.5, 2) + pow(w1 - 0.3, 2) + pow(w2 - 0.2, 2), 9), w0, w1 LIMIT 1""", V)
def ras16(spark, d):
    best = evaluation.best_weights(scored(spark, d), ["score", "anomaly", "shadow"], "label", "doc_id")
    return best.select("w0", "w1", "w2", F.round("ap", 6).alias("ap"))


@query("jn05_greedy_matches", greedy("survey_id, cls", BY_CONFIDENCE) + " SELECT survey_id, cls, prediction, truth, round(iou, 6) AS iou FROM o JOIN w USING (survey_id, cls, k) WHERE take /* RECURSIVE */", "v_detection")
def jn05(spark, d):
    """One-to-one matches of boxes of even and odd events of a survey and class, by confidence and overlap."""
    boxes = view(spark, d, "v_detection").where("ping_start is not null")
    return matching.truth_matches(boxes, ["survey_id", "cls"]).withColumn("iou", F.round("iou", 6))


NEAR = "2 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query("agg20_position_errors", f"""n AS (SELECT a.event_id, min({NEAR}) AS m FROM v_detection a JOIN v_detection b ON abs(a.lat - b.lat) < 6e-4 AND abs(a.lon - b.lon) < 6e-4 AND b.cls IN ('shipwreck', 'debris_other') WHERE a.cls = 'unknown_anomaly' AND {NEAR} <= 50 GROUP BY a.event_id)
 SELECT a.source_file, count(*) AS n, count(m) AS matched, round(median(m), 3) AS median_error, round(max(m), 3) AS max_error, round(avg(CASE WHEN m IS NOT NULL THEN CASE WHEN m <= 2 * (8e0 + a.event_id % 9) THEN 1e0 ELSE 0e0 END END), 6) AS within
 FROM v_detection a LEFT JOIN n USING (event_id) WHERE a.cls = 'unknown_anomaly' GROUP BY a.source_file""", "v_detection")
def agg20(spark, d):
    """Charted truths and the nearest detection within 50 m of each; sigma is each truth's own."""
    rows = view(spark, d, "v_detection").select(F.col("event_id").alias("id"), "lat", "lon", "cls", "source_file")
    truths = rows.where("cls = 'unknown_anomaly'")
    met = merging.nearest(truths.select("id", "lat", "lon"), rows.where("cls in ('shipwreck', 'debris_other')").select("id", "lat", "lon"), 50.0)
    out = evaluation.position_errors(truths.join(met, "id", "left"), ["source_file"], F.col("metres"), 8.0 + F.col("id") % 9)
    return out.withColumns({"median_error": F.round("median_error", 3), "max_error": F.round("max_error", 3), "within": F.round("within", 6)})


@query("ras17_folds")
def ras17(spark, d):
    """(doc_id, fold, calibrated): each source's scores calibrated by the isotonic fit of the other folds' sources; tests refit them."""
    fold = F.conv(F.substring(F.md5("grp"), 1, 4), 16, 10).cast("long") % 5
    rows = scored(spark, d).select("doc_id", "grp", "score", "label", fold.cast("int").alias("fold"))
    return evaluation.out_of_fold(rows, "fold", 5, "score", "label", "doc_id").select("doc_id", "fold", F.round("calibrated", 6).alias("calibrated"))


@query("snk15_confusion", "SELECT lang, count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp FROM v_scored GROUP BY lang", V)
def snk15(spark, d):
    cell = F.when(F.col("label") == 0, F.when(F.col("score") < 0.5, "tn").otherwise("fp")).otherwise(F.when(F.col("score") < 0.5, "fn").otherwise("tp"))
    return scored(spark, d).withColumn("cell", cell).groupBy("lang").pivot("cell", ["tn", "fp", "fn", "tp"]).count().na.fill(0)


@query("agg19_dataset_digest", """b AS (SELECT split, substr(digest, 1, 3) AS bin, sha256(string_agg(digest, ',' ORDER BY digest)) AS part FROM v_item GROUP BY 1, 2), g AS (SELECT split, sha256(string_agg(part, ',' ORDER BY bin)) AS digest FROM b GROUP BY split)
 SELECT split, count(*) AS n, count(DISTINCT site) AS sites, median(objects) AS median_objects, round(quantile_cont(objects, 0.9), 6) AS p90, any_value(g.digest) AS digest FROM v_item JOIN g USING (split) GROUP BY split""", "v_item")
def agg19(spark, d):
    return catalogue.split_digests(view(spark, d, "v_item"), "split", "site", "objects", "digest").withColumn("p90", F.round("p90", 6))


@query("set05_leaking_sites", "SELECT site, count(DISTINCT split) AS splits FROM v_item GROUP BY site HAVING count(DISTINCT split) > 1", "v_item")
def set05(spark, d):
    return view(spark, d, "v_item").groupBy("site").agg(F.countDistinct("split").alias("splits")).where("splits > 1")


@query("set03_capped_variant", "SELECT doc_id, dataset FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY digest, doc_id) AS k FROM v_item WHERE split = 'train') WHERE k <= 20 OR dataset = 'en'", "v_item")
def set03(spark, d):
    rows = view(spark, d, "v_item").where("split = 'train'")
    first = rows.where("dataset <> 'en'").withColumn("k", F.row_number().over(Window.partitionBy("dataset").orderBy("digest", "doc_id"))).where("k <= 20")
    return first.select("doc_id", "dataset").unionByName(rows.where("dataset = 'en'").select("doc_id", "dataset"))


@query("set06_duplicate_items", "SELECT digest, count(*) AS n, min(doc_id) AS first_id FROM v_item GROUP BY digest HAVING count(*) > 1", "v_item")
def set06(spark, d):
    return view(spark, d, "v_item").groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("ras18_site_splits")
def ras18(spark, d):
    """Whole sites assigned to splits near 70, 20 and 10 per cent; tests hold the assignment against all ways."""
    return evaluation.site_splits(view(spark, d, "v_item"), "site", {"train": 0.7, "val": 0.2, "test": 0.1})
