"""Queries over sample rasters and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pingframe.operators import blocks, detectors, features, ranking, raster
from pingframe.operators.similarity import correlated
from pingframe.plans.registry import query
from pingframe.plans.tables import shared_dir
from pingframe.plans.views import samples, table, waterfall
from pingframe.sources import log_files, readers, sonar_log

V = "v_sample"
DARR = lambda c: F.transform(c, lambda x: x.cast("double"))


@query("geo11_ground_range_samples", """k AS (SELECT DISTINCT ping, 5e0 + ping % 10 AS h, g FROM v_sample, unnest(range(0, 40)) AS x(g)), i AS (SELECT *, sqrt(g * 1.5e0 * g * 1.5e0 + h * h) / 50e0 * 32 AS idx FROM k)
 SELECT i.ping, round(sum(CASE WHEN idx <= 31 THEN a.v + (coalesce(b.v, a.v) - a.v) * (idx - floor(idx)) ELSE 0 END), 3) AS total FROM i LEFT JOIN v_sample a ON a.ping = i.ping AND a.side = 'port' AND a.sample = floor(idx) LEFT JOIN v_sample b ON b.ping = i.ping AND b.side = 'port' AND b.sample = floor(idx) + 1 GROUP BY i.ping""", V)
def geo11(spark, d):
    w = waterfall(spark, d)
    g = raster.ground_samples(DARR("port"), F.lit(50.0), 5.0 + F.col("ping") % 10, 1.5, 40)
    return w.select("ping", F.round(F.aggregate(g, F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@query("geo12_row_image", "SELECT ping, CAST(sum(CASE WHEN side = 'port' THEN (31 - sample) * v ELSE (32 + sample) * v END) AS BIGINT) AS weighted, CAST(count(*) FILTER (WHERE side = 'port' AND sample * 0.5e0 < 0.3e0 * (5 + ping % 10)) AS BIGINT) AS near_nadir FROM v_sample GROUP BY ping", V)
def geo12(spark, d):
    row = raster.row_image(F.col("port"), F.col("starboard"))
    weighted = F.aggregate(F.transform(row, lambda x, i: x * i), F.lit(0).cast("long"), lambda s, x: s + x)
    near = F.size(F.filter(raster.near_nadir(32, 0.5, 5.0 + F.col("ping") % 10), lambda b: b)).cast("long")
    return waterfall(spark, d).select("ping", weighted.alias("weighted"), near.alias("near_nadir"))


@query("geo13_water_column", "SELECT ping, CAST(count(*) AS BIGINT) AS n FROM v_sample WHERE sample < 3 + ping % 6 GROUP BY ping", V)
def geo13(spark, d):
    return samples(spark, d).where(F.col("sample") < 3 + F.col("ping") % 6).groupBy("ping").agg(F.count("*").alias("n"))


@query("agg11_dropouts", """s AS (SELECT ping, avg(v) AS mean, stddev_pop(v) AS std, list(v ORDER BY side, sample) AS l FROM v_sample GROUP BY ping) SELECT ping, round(mean, 6) AS mean, round(std, 6) AS std, std < 0.05 * (SELECT median(std) FROM s WHERE std > 0) OR mean < 1 OR coalesce(l = lag(l) OVER (ORDER BY ping), FALSE) AS dropout FROM s""", V)
def agg11(spark, d):
    return raster.dropouts(waterfall(spark, d)).select("ping", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "dropout")


@query("agg12_stretch", """m AS (SELECT side, median(v) AS m FROM v_sample WHERE v > 0 GROUP BY side), g AS (SELECT ping, ln(1 + v / m) AS g FROM v_sample JOIN m USING (side)), q AS (SELECT quantile_cont(g, 0.01) AS lo, quantile_cont(g, 0.995) AS hi FROM g)
 SELECT ping, CAST(sum(round_even(least(1, greatest(0, (g - lo) / (hi - lo))) * 255, 0)) AS BIGINT) AS total FROM g, q GROUP BY ping""", V)
def agg12(spark, d):
    return raster.stretched(samples(spark, d), "side", "v", "ping").groupBy("ping").agg(F.sum("level").cast("long").alias("total"))


@query("src05_port_order", """v AS (SELECT side, sample, CASE WHEN side = 'port' THEN v * (1 + sample) ELSE v * (32 - sample) END AS v FROM v_sample WHERE ping % greatest(1, (SELECT count(DISTINCT ping) FROM v_sample) // 200) = 0),
 b AS (SELECT side, sample, avg(ln(1 + v)) AS a FROM v GROUP BY side, sample), c AS (SELECT corr(p.a, s.a) AS same, corr(p.a, r.a) AS turned FROM b p JOIN b s ON s.sample = p.sample AND s.side = 'starboard' JOIN b r ON r.sample = 31 - p.sample AND r.side = 'starboard' WHERE p.side = 'port')
 SELECT round(same, 6) AS same, round(turned, 6) AS turned, CASE WHEN abs(same - turned) < 0.2 THEN NULL WHEN same > turned THEN 'nadir_first' ELSE 'nadir_last' END AS "order" FROM c""", V)
def src05(spark, d):
    """About 200 pings, evenly spaced; the port side is made to fall towards the nadir, the starboard side away from it."""
    rows = samples(spark, d)
    n = rows.select("ping").distinct().count()
    some = rows.where(F.col("ping") % max(1, n // 200) == 0)
    sloped = some.withColumn("v", F.col("v") * F.when(F.col("side") == "port", 1 + F.col("sample")).otherwise(32 - F.col("sample")))
    return raster.port_order(sloped, "side", "sample", "v", 32).withColumns({"same": F.round("same", 6), "turned": F.round("turned", 6)})


@query("src06_split_waterfall", "SELECT vec_id AS ping, CAST(floor(abs(CAST(embedding[32] AS DOUBLE)) * 1000) AS BIGINT) AS first_port, CAST(floor(abs(CAST(embedding[33] AS DOUBLE)) * 1000) AS BIGINT) AS first_starboard FROM embeddings")
def src06(spark, d):
    return waterfall(spark, d).select("ping", F.get("port", F.lit(0)).alias("first_port"), F.get("starboard", F.lit(0)).alias("first_starboard"))


#: The waterfall as an image: a row is a ping, port runs outwards to the left.
IMAGE = "im AS (SELECT ping AS r, CASE WHEN side = 'port' THEN 31 - sample ELSE 32 + sample END AS c, CAST(v AS DOUBLE) AS v FROM v_sample), sz AS (SELECT max(r) AS n FROM im)"


def mirrored(half: int) -> str:
    """Every cell of im with the values xv around it, rows and columns mirrored at the borders."""
    return f"""mir AS (SELECT im.r, im.c, im.v, CASE WHEN im.r + dr < 0 THEN -im.r - dr - 1 WHEN im.r + dr > n THEN 2 * n + 1 - im.r - dr ELSE im.r + dr END AS sr,
  CASE WHEN im.c + dc < 0 THEN -im.c - dc - 1 WHEN im.c + dc > 63 THEN 127 - im.c - dc ELSE im.c + dc END AS sc FROM im, sz, unnest(range(-{half}, {half + 1})) AS a(dr), unnest(range(-{half}, {half + 1})) AS b(dc)),
 near AS (SELECT mir.r, mir.c, mir.v, x.v AS xv FROM mir JOIN im x ON x.r = sr AND x.c = sc)"""


def image(spark, d):
    c = F.when(F.col("side") == "port", 31 - F.col("sample")).otherwise(32 + F.col("sample"))
    return samples(spark, d).select(F.col("ping").alias("r"), c.alias("c"), F.col("v").cast("double").alias("v"))


@query("ras01_lee", f"""{IMAGE}, {mirrored(2)}, m AS (SELECT r, c, v, avg(xv) AS mean, greatest(avg(xv * xv) - avg(xv) * avg(xv), 0) AS var FROM near GROUP BY r, c, v)
 SELECT r, c, round(mean + var / (var + (SELECT avg(var) FROM m)) * (v - mean), 3) AS filtered FROM m""", V)
def ras01(spark, d):
    return raster.lee_filtered(image(spark, d), "r", "c", "v").select("r", F.col("c").cast("long").alias("c"), F.round("filtered", 3).alias("filtered"))


@query("ras02_local_std", f"{IMAGE}, {mirrored(3)} SELECT r, c, round(sqrt(greatest(avg(xv * xv) - avg(xv) * avg(xv), 0)), 3) AS std FROM near GROUP BY r, c", V)
def ras02(spark, d):
    return raster.lee_filtered(image(spark, d), "r", "c", "v", 3).select("r", F.col("c").cast("long").alias("c"), F.round(F.sqrt("variance"), 3).alias("std"))


@query("ras04_tiles", f"""{IMAGE}, ts AS (SELECT t * 12 AS tr FROM sz, unnest(range(0, 1000000)) AS x(t) WHERE t * 12 < n + 1 - 16 UNION SELECT greatest(n + 1 - 16, 0) FROM sz)
 SELECT tr, tc, round(avg(v), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM im JOIN ts ON r >= tr AND r < tr + 16, (SELECT unnest([0, 12, 24, 36, 48]) AS tc) WHERE c BETWEEN tc AND tc + 15 GROUP BY tr, tc HAVING avg(CASE WHEN v < 20 THEN 1e0 ELSE 0e0 END) <= 0.8""", V)
def ras04(spark, d):
    cells = image(spark, d)
    rows = cells.agg((F.max("r") + 1).alias("rows"))
    cut = cells.join(F.broadcast(rows)).withColumn("tr", F.explode(raster.tiles_of(F.col("r"), F.col("rows"), 16, 0.25))).withColumn("tc", F.explode(raster.tiles_of(F.col("c"), F.lit(64), 16, 0.25)))
    tiles = cut.groupBy("tr", "tc").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("*").alias("n"), F.avg((F.col("v") < 20).cast("double")).alias("masked"))
    return tiles.where("masked <= 0.8").drop("masked")


@query("ras08_heatmap", "SELECT vec_id % 64 AS r, i AS c, max(CAST(embedding[i] AS DOUBLE)) AS heat FROM embeddings, unnest(range(1, 65)) AS x(i) GROUP BY 1, 2")
def ras08(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 64).alias("r"), F.posexplode("embedding").alias("c", "v"))
    return e.groupBy("r", (F.col("c") + 1).cast("long").alias("c")).agg(F.max(F.col("v").cast("double")).alias("heat"))


@query("agg25_texture", f"""{IMAGE}, p AS (SELECT floor(least(v, 255) * 8 / 256) AS i, lead(floor(least(v, 255) * 8 / 256)) OVER (PARTITION BY r ORDER BY c) AS j FROM im), s AS (SELECT i, j FROM p WHERE j IS NOT NULL UNION ALL SELECT j, i FROM p WHERE j IS NOT NULL), n AS (SELECT i, j, count(*) / (SELECT count(*) FROM s) AS p FROM s GROUP BY i, j)
 SELECT round(sum(p * (i - j) * (i - j)), 6) AS contrast, round(sum(p / (1 + abs(i - j))), 6) AS homogeneity, round(sqrt(sum(p * p)), 6) AS energy FROM n""", V)
def agg25(spark, d):
    grey = image(spark, d).withColumn("v", F.least("v", F.lit(255.0)))
    return raster.cooccurrence(grey, "r", "c", "v").select(*[F.round(c, 6).alias(c) for c in ("contrast", "homogeneity", "energy")])


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query("ras09_bank_distance", """SELECT p.vec_id AS id, round(min(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(p.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2))))), 6) AS distance FROM embeddings p, embeddings b WHERE p.label >= 5 AND b.label < 5 GROUP BY p.vec_id""")
def ras09(spark, d):
    v = vectors(spark, d)
    return raster.bank_distance(v.where("label >= 5"), v.where("label < 5")).select("id", F.round("distance", 6).alias("distance"))


@query("agg26_normal_thresholds", "SELECT label, round(quantile_cont(CAST(embedding[1] AS DOUBLE), 0.99), 6) AS p99, round(quantile_cont(CAST(embedding[1] AS DOUBLE), 0.999), 6) AS p999 FROM embeddings GROUP BY label")
def agg26(spark, d):
    first = vectors(spark, d).select("label", F.get("v", F.lit(0)).alias("x"))
    out = ranking.group_percentiles(first, ["label"], "x", {"p99": 0.99, "p999": 0.999})
    return out.select("label", F.round("p99", 6).alias("p99"), F.round("p999", 6).alias("p999"))


@query("ras10_coreset")
def ras10(spark, d):
    """Farthest-first selection: rank and id of the chosen vectors."""
    return raster.coreset(vectors(spark, d), 8).select("rank", "id")


@query("ras09_coreset_distance")
def ras09b(spark, d):
    """Distance of vectors to the nearest of a bank of bounded size, picked of the normal ones; tests hold it against a plain walk."""
    v = vectors(spark, d)
    return raster.bank_distance(v.where("label >= 5"), raster.coreset(v.where("label < 5"), 32)).select("id", F.round("distance", 6).alias("distance"))


def grey_lines(spark, d):
    """Lines of 100 pings, a row for each ping: v an array of grey levels up to 255."""
    return lines(spark, d).withColumn("v", F.transform("v", lambda x: F.least(x, F.lit(255.0))))


LINE_IMAGE = "im AS (SELECT ping // 100 AS line, ping % 100 AS r, CASE WHEN side = 'port' THEN 31 - sample ELSE 32 + sample END AS c, least(v, 255) AS v FROM v_sample), sz AS (SELECT line, max(r) AS n FROM im GROUP BY line)"


@query("ras09_blurred_heat", f"""{LINE_IMAGE}, w AS (SELECT k, exp(-k * k / 4.5e0) / sum(exp(-k * k / 4.5e0)) OVER () AS w FROM unnest(range(-6, 7)) AS x(k)),
 a AS (SELECT im.line, im.r, im.c, sum(w * o.v) AS v FROM im, w, im o WHERE o.line = im.line AND o.r = im.r AND o.c = CASE WHEN im.c + k < 0 THEN -im.c - k WHEN im.c + k > 63 THEN 126 - im.c - k ELSE im.c + k END GROUP BY 1, 2, 3),
 b AS (SELECT a.line, a.r, a.c, CASE WHEN n = 0 THEN 0 WHEN abs(a.r + k) % (2 * n) > n THEN 2 * n - abs(a.r + k) % (2 * n) ELSE abs(a.r + k) % (2 * n) END AS o, w FROM a JOIN sz USING (line), w)
 SELECT b.line, b.r AS row, round(sum(w * a.v * (b.c + 1)), 4) AS total FROM b JOIN a ON a.line = b.line AND a.r = o AND a.c = b.c GROUP BY b.line, b.r""", V)
def ras09c(spark, d):
    """Heat of lines blurred by a Gauss curve of 1.5 cells, as a weighted total of each row."""
    out = blocks.blurred(grey_lines(spark, d), ["line"], "row", "v", 1.5, "soft")
    total = F.aggregate(F.transform("soft", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return out.select("line", "row", F.round(total, 4).alias("total"))


def _around(half: int) -> str:
    return f"""(SELECT k.line, k.r, k.c, k.v, avg(o.v) AS m, greatest(avg(o.v * o.v) - avg(o.v) * avg(o.v), 0) AS s
 FROM (SELECT im.*, CASE WHEN r + dr < 0 THEN -r - dr - 1 WHEN r + dr > n THEN 2 * n + 1 - r - dr ELSE r + dr END AS sr, CASE WHEN c + dc < 0 THEN -c - dc - 1 WHEN c + dc > 63 THEN 127 - c - dc ELSE c + dc END AS sc
  FROM im JOIN sz USING (line), unnest(range(-{half}, {half + 1})) AS a(dr), unnest(range(-{half}, {half + 1})) AS b(dc)) k JOIN im o ON o.line = k.line AND o.r = k.sr AND o.c = k.sc GROUP BY 1, 2, 3, 4)"""


@query("ras02_channels", f"""{LINE_IMAGE}, l AS {_around(2)}, t AS {_around(3)}, z AS (SELECT line, avg(s) AS noise FROM l GROUP BY line)
 SELECT l.line, l.r AS row, CAST(sum(l.v * (l.c + 1)) AS BIGINT) AS raw, CAST(sum(greatest(0, least(255, round_even(round(l.m + coalesce(l.s / nullif(l.s + noise, 0), 0) * (l.v - l.m), 9), 0))) * (l.c + 1)) AS BIGINT) AS lee, CAST(sum(greatest(0, least(255, round_even(round(2 * sqrt(t.s), 9), 0))) * (l.c + 1)) AS BIGINT) AS texture
 FROM l JOIN t USING (line, r, c) JOIN z ON z.line = l.line GROUP BY l.line, l.r""", V)
def ras02b(spark, d):
    """Raw, despeckled and texture channels of lines, as weighted totals of each row."""
    out = blocks.channels(grey_lines(spark, d), ["line"], "row", "v")
    total = lambda k: F.aggregate(F.transform(F.get("channels", F.lit(k)), lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("line", "row", total(0).alias("raw"), total(1).alias("lee"), total(2).alias("texture"))


@query("src17_normal_tiles", "SELECT label, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(avg(CASE WHEN v < 5 THEN 1e0 ELSE 0e0 END), 6) AS dark FROM (SELECT label, s.v FROM v_sample s JOIN embeddings e ON e.vec_id = s.ping) GROUP BY label HAVING avg(v) >= 12 AND stddev_pop(v) >= 4 AND avg(CASE WHEN v < 5 THEN 1e0 ELSE 0e0 END) <= 0.3", V)
def src17(spark, d):
    of = table(spark, d, "embeddings").select(F.col("vec_id").alias("ping"), "label")
    dark = F.avg((F.col("v") < 5).cast("double"))
    out = samples(spark, d).join(of, "ping").groupBy("label").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), dark.alias("dark"))
    return out.where("mean >= 12 and std >= 4 and dark <= 0.3").select("label", *[F.round(c, 6).alias(c) for c in ("mean", "std", "dark")])


@query("ras12_shadow_run", """f AS (SELECT ping, list(v < 60 ORDER BY sample) AS d FROM v_sample WHERE side = 'starboard' GROUP BY ping), s AS (SELECT *, list_filter([0, 1, 2, 3], lambda i: d[i + 1])[1] AS start FROM f),
 e AS (SELECT *, coalesce(list_filter(range(0, 32), lambda e: e > start AND NOT d[e + 1] AND NOT coalesce(d[e + 2], FALSE))[1], 32) AS stop FROM s) SELECT ping, coalesce(start, 0) AS start, CASE WHEN start IS NULL THEN 0 ELSE stop - start END AS length FROM e""", V)
def ras12(spark, d):
    run = raster.dark_run(F.transform("starboard", lambda x: x < 60))
    return waterfall(spark, d).select("ping", run.alias("run")).select("ping", F.col("run.start").cast("long").alias("start"), F.col("run.length").cast("long").alias("length"))


@query("ras12_shadow_scores")
def ras12b(spark, d):
    """Shadow scores of boxes of 6 pings and 5 samples over the waterfall; tests hold them against a plain computation."""
    rows = waterfall(spark, d).select(F.col("ping").alias("y"), raster.row_image(*(F.transform(c, lambda x: x.cast("double")) for c in ("port", "starboard"))).alias("v"))
    x1 = F.col("y") * 7 % 58
    boxes = rows.where("y % 5 = 0").select(F.col("y").alias("id"), x1.alias("x1"), F.col("y").alias("y1"), (x1 + 5).alias("x2"), (F.col("y") + 6).alias("y2"), F.when(F.col("y") % 15 > 0, 5.0 + F.col("y") % 10).alias("altitude_m"))
    out = raster.shadow_scores(boxes, rows, 32, 0.5)
    return out.select("id", *[F.round(c, 6).alias(c) for c in out.columns if c != "id"])


def small_targets(grey):
    """Bright regions for images of 64 columns: smaller and fainter than those of whole lines."""
    return detectors.bright_targets(grey, least_contrast=60, least_pixels=2, most_share=0.2, window=3)


def lines(spark, d):
    """The waterfall as images of 100 rows."""
    v = raster.row_image(*(F.transform(c, lambda x: x.cast("double")) for c in ("port", "starboard")))
    return waterfall(spark, d).select(F.floor(F.col("ping") / 100).alias("line"), (F.col("ping") % 100).alias("row"), "ping", v.alias("v"))


@query("ras06_tile_detections")
def ras06(spark, d):
    """Boxes of bright targets in tiles of 32 pixels, all tiles apart; tests hold them against a loop over the same tiles."""
    return detectors.detected(detectors.tiled(lines(spark, d), ["line"], "row", "v", 32, 0.25), ["line"], "row", small_targets)


@query("ras07_mosaic_detections")
def ras07(spark, d):
    """Lines as mosaics of half a metre a pixel in UTM zone 44, stretched, searched in tiles, united and placed."""
    where = F.array(*map(F.lit, (500000.0, 0.5, 0.0))), F.array(1437146.0 + 50.0 * F.col("line"), F.lit(0.0), F.lit(-0.5))
    rows = lines(spark, d).select(F.col("line").cast("string").alias("path"), "row", "v", F.lit(32644).alias("epsg"), F.concat(*where).alias("transform"))
    out = detectors.mosaic_detections(rows, small_targets, 32, 0.25)
    return out.select("path", "cls", "score", "x1", "y1", "x2", "y2", "members", "lat", "lon", "length_m", "width_m", F.to_json("footprint").alias("footprint"))


@query("ras13_detection_features")
def ras13(spark, d):
    """Features of boxes of 12 rows and 10 columns over the lines; tests hold them against plain computations of each box."""
    rows = lines(spark, d).withColumnRenamed("row", "y")
    x1 = F.col("ping") * 7 % 54
    boxes = rows.where("ping % 5 = 0 and y < 84").select(
        "line", F.col("ping").alias("id"), F.when(F.col("ping") % 2 == 0, "pipe").otherwise("cylinder").alias("cls"), F.lit(0.5).alias("score"), x1.alias("x1"), F.col("y").alias("y1"), (x1 + 10).alias("x2"), (F.col("y") + 12).alias("y2"),
        F.lit(6.0).alias("length_m"), F.lit(5.0).alias("width_m"), F.lit(60).alias("pixels"), (F.col("ping") % 360).alias("orientation_deg"), F.lit(30.0).alias("heading_deg"),
    )
    out = features.detection_features(boxes, rows, ["line"])
    return out.select("line", "id", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("line", "id")])


@query("src18_tile_exports", """im AS (SELECT ping // 100 AS line, ping % 100 AS row, ping, CASE WHEN side = 'port' THEN 31 - sample ELSE 32 + sample END AS c, v FROM v_sample), sz AS (SELECT line, max(row) + 1 AS n FROM im GROUP BY line),
 ts AS (SELECT line, least(t * 24, greatest(n - 32, 0)) AS tr, max(t) AS ti FROM sz, unnest(range(0, 5)) AS x(t) WHERE t = 0 OR (t - 1) * 24 < greatest(n - 32, 0) GROUP BY 1, 2), tc AS (SELECT * FROM (VALUES (0, 0), (24, 1), (32, 2)) AS y(tc, tj))
 SELECT line, line || '_t' || lpad(CAST(ti * 3 + tj AS VARCHAR), 4, '0') AS name, min(ping) AS ping_start, max(ping) AS ping_end, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM im JOIN ts USING (line), tc WHERE row >= tr AND row < tr + 32 AND c >= tc AND c < tc + 32
 GROUP BY line, ti, tj HAVING count(DISTINCT CASE WHEN ping % 60 BETWEEN 20 AND 45 THEN ping END) <= 0.7 * count(DISTINCT ping)""", V)
def src18(spark, d):
    rows = lines(spark, d).withColumns({"masked": (F.col("ping") % 60).between(20, 45), "lat": 13 + F.col("ping") * 1e-6, "lon": F.lit(80.0), "heading_deg": F.lit(0.0)})
    out = detectors.tile_exports(rows, ["line"], 32, 0.5, 32, 0.25, 0.7)
    flat = F.flatten("pixels")
    end = lambda k: F.get_json_object("about", f"$.{k}").cast("long").alias(k)
    total = F.aggregate(flat, F.lit(0.0), lambda s, x: s + x).cast("long")
    return out.select("line", "name", end("ping_start"), end("ping_end"), total.alias("total"), F.size(flat).cast("long").alias("n"))


LINES = "s AS (SELECT *, ping // 100 AS line FROM v_sample)"


@query("win09_inpainted_dropouts", f"""{LINES}, g AS (SELECT DISTINCT line, ping, ping % 9 IN (3, 4) OR ping % 60 BETWEEN 40 AND 45 AS bad FROM s), k AS (SELECT *, max(CASE WHEN NOT bad THEN ping END) OVER (PARTITION BY line ORDER BY ping ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, min(CASE WHEN NOT bad THEN ping END) OVER (PARTITION BY line ORDER BY ping ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM g),
 f AS (SELECT *, bad AND coalesce(hi - lo - 1 <= 3, FALSE) AS inpainted FROM k)
 SELECT f.ping, any_value(inpainted) AS inpainted, any_value(bad AND NOT inpainted) AS masked, CAST(sum(CASE WHEN inpainted THEN round_even(a.v * (1 - (f.ping - lo) / CAST(hi - lo AS DOUBLE)) + b.v * ((f.ping - lo) / CAST(hi - lo AS DOUBLE)), 0) ELSE s.v END) AS BIGINT) AS total
 FROM f JOIN s ON s.ping = f.ping LEFT JOIN s a ON a.ping = lo AND a.side = s.side AND a.sample = s.sample LEFT JOIN s b ON b.ping = hi AND b.side = s.side AND b.sample = s.sample GROUP BY f.ping""", V)
def win09(spark, d):
    rows = waterfall(spark, d).withColumn("line", F.floor(F.col("ping") / 100)).withColumn("bad", (F.col("ping") % 9).isin(3, 4) | (F.col("ping") % 60).between(40, 45))
    fixed = raster.repaired(rows, "bad", ["line"])
    total = F.aggregate(F.concat("port", "starboard"), F.lit(0).cast("long"), lambda s, x: s + x)
    return fixed.select("ping", "inpainted", "masked", total.alias("total"))


@query("win10_flattened", """cap AS (SELECT side, sample, quantile_cont(v, 0.99) AS cap FROM v_sample GROUP BY side, sample), c AS (SELECT s.*, least(v, cap) AS x FROM v_sample s JOIN cap USING (side, sample)),
 m AS (SELECT *, (sum(x) OVER (PARTITION BY side, sample ORDER BY ping ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) + greatest(0, 10 - ping) * first_value(x) OVER (PARTITION BY side, sample ORDER BY ping) + greatest(0, ping + 9 - (count(*) OVER (PARTITION BY side, sample) - 1)) * last_value(x) OVER (PARTITION BY side, sample ORDER BY ping ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 20 AS mean FROM c)
 SELECT ping, side, sample, round(v / greatest(mean, greatest((SELECT median(mean) FROM m) * 1e-3, 1e-6)), 6) AS flat FROM m""", V)
def win10b(spark, d):
    out = raster.flattened(samples(spark, d), ["side", "sample"], "ping", "v", 20)
    return out.select("ping", "side", F.col("sample").cast("long").alias("sample"), F.round("flat", 6).alias("flat"))


@query("win11_bottom_track")
def win11b(spark, d):
    """First returns and the tracked bottom of lines of 100 pings; tests hold both against a plain computation."""
    firsts = raster.first_returns(samples(spark, d), "ping", "sample", "v", 32).withColumn("line", F.floor(F.col("ping") / 100))
    return raster.bottom_track(firsts, ["line"], "ping").select("line", "ping", "first_return", F.round("tracked", 6).alias("tracked"))


@query("set04_similar_vectors", """n AS (SELECT vec_id, list_transform(embedding, lambda x: (x - list_avg(embedding)) / list_stddev_pop(embedding)) AS z FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings)) SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id < b.vec_id AND list_inner_product(a.z, b.z) / 64 >= 0.97""".replace("n AS (", "WITH n AS (", 1))
def set04(spark, d):
    return correlated(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")), 0.97)


def logs(spark, d, folder):
    """The waterfall as logs of 100 pings; both sides fall with the range, and logs of even numbers store the port side farthest first."""
    fall = lambda c: F.transform(c, lambda x, i: x * (40 - i))
    rows = waterfall(spark, d).select(
        F.floor(F.col("ping") / 100).cast("string").alias("line"), "ping", fall("port").alias("port"), fall("starboard").alias("starboard"), (F.floor(F.col("ping") / 100) % 2 == 0).alias("far"),
        (F.col("ping") % 360).cast("double").alias("heading_deg"), F.when(F.col("ping") % 13 != 0, 5.0 + F.col("ping") % 10).alias("altitude_m"), (F.col("ping") % 700 * 1.25).alias("cable_out_m"), F.lit(50.0).alias("slant_range_m"),
        (13 + F.col("ping") * 1e-6).alias("lat"), F.lit(80.0).alias("lon"),
    )
    log_files.write(rows, folder, "line", "far").write.format("noop").mode("overwrite").save()
    readers.register(spark)


def _line_of():
    return F.regexp_extract("path", r"(\d+)\.xtf$", 1).cast("long").alias("line")


LOGS = "w AS (SELECT ping // 100 AS line, ping % 100 AS ping, ping AS p, sum(CASE WHEN side = 'port' THEN v * (40 - sample) * (sample + 1) ELSE 0 END) AS port, sum(CASE WHEN side = 'starboard' THEN v * (40 - sample) * (sample + 1) ELSE 0 END) AS starboard FROM v_sample GROUP BY ping)"


def _weighted(side):
    return F.aggregate(F.transform(side, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x).cast("long").alias(side)


@query("src04_port_order_of_logs", f"{LOGS} SELECT line, ping, CAST(port AS BIGINT) AS port, CAST(starboard AS BIGINT) AS starboard FROM w", V)
def src04(spark, d):
    """Samples of logs, nadir first whatever their port order, which is told from the samples; read by spans of 30 pings."""
    logs(spark, d, folder := f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}")
    return sonar_log.read(spark, folder, batch=30).select(_line_of(), "ping", _weighted("port"), _weighted("starboard"))


@query("src03_log_source", f"{LOGS} SELECT line, ping, CAST(starboard AS BIGINT) AS starboard, CASE WHEN p % 13 <> 0 THEN 5e0 + p % 10 END AS altitude_m, round(CASE WHEN p % 700 <> 0 THEN p % 700 * 125 // 100 + p % 700 * 125 % 100 / 100e0 END, 2) AS cable_out_m, round(13 + p * 1e-6, 6) AS lat FROM w", V)
def src03(spark, d):
    """Some columns of logs by the data source: the port side is not read."""
    logs(spark, d, folder := f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}")
    rows = spark.read.format("sonar_log").schema("path string, ping long, altitude_m double, cable_out_m double, sensor_y double, starboard array<double>").load(folder)
    return rows.select(_line_of(), "ping", _weighted("starboard"), "altitude_m", F.round("cable_out_m", 2).alias("cable_out_m"), F.round("sensor_y", 6).alias("lat"))
