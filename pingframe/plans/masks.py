"""Queries over masks as runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pingframe.operators import masks, raster
from pingframe.plans.registry import query
from pingframe.plans.views import samples, table

V = "v_sample"

#: Events whose polygons a task fills, so that its memory does not grow with the table.
TASK_EVENTS = 50_000
#: A polygon for each event, by its corners; every third one crosses itself.
CORNERS = (
    ("event_id % 12 + 0.3e0", "event_id % 9 + 0.2e0"),
    ("event_id % 12 + 5.3e0 + event_id % 11", "event_id % 9 + 1.2e0"),
    ("event_id % 12 + CASE WHEN event_id % 3 = 0 THEN 0.8e0 ELSE 3.3e0 + event_id % 11 END", "event_id % 9 + 4.2e0 + event_id % 13"),
    ("event_id % 12 + 4.1e0", "event_id % 9 + 2.7e0"),
    ("event_id % 12 + CASE WHEN event_id % 3 = 0 THEN 6.3e0 ELSE 1.3e0 END", "event_id % 9 + 3.2e0 + event_id % 13"),
)
POLYGON_CELLS = f"""pg AS (SELECT event_id, [{", ".join(f"{{'x': {x}, 'y': {y}}}" for x, y in CORNERS)}] AS p FROM events), eg AS (SELECT event_id, p[i] AS p, p[i % len(p) + 1] AS q FROM pg, unnest(range(1, len(p) + 1)) AS t(i)),
 cr AS (SELECT event_id, r, p.x + (r + 0.5 - p.y) * (q.x - p.x) / (q.y - p.y) AS x FROM eg, unnest(range(0, 40)) AS y(r) WHERE (p.y <= r + 0.5) <> (q.y <= r + 0.5)),
 cell AS (SELECT event_id, r, c FROM cr, unnest(range(0, 40)) AS z(c) GROUP BY event_id, r, c HAVING count(*) FILTER (WHERE x <= c + 0.5) % 2 = 1)"""


def tasks_of(spark, d):
    """So many partitions that each has about TASK_EVENTS events."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, d, "events").count() // TASK_EVENTS))


def polygons(spark, d):
    """(event_id, row, start, end) of the events' polygons."""
    events = table(spark, d, "events").select("event_id").where("event_id is not null").repartition(tasks_of(spark, d), "event_id")
    points = F.array(*[F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")) for x, y in CORNERS])
    return masks.filled(events.select("event_id", points.alias("p")), ["event_id"], "p")


def cells(spark, d):
    """(line, row, ping, col, v): the waterfall as images of 100 rows, a row for each cell."""
    c = F.when(F.col("side") == "port", 31 - F.col("sample")).otherwise(32 + F.col("sample"))
    return samples(spark, d).select(F.floor(F.col("ping") / 100).alias("line"), (F.col("ping") % 100).alias("row"), "ping", c.cast("long").alias("col"), "v")


CELLS = "im AS (SELECT ping // 100 AS line, ping % 100 AS row, ping, CASE WHEN side = 'port' THEN 31 - sample ELSE 32 + sample END AS col, v FROM v_sample)"


@query("scl17_mask_iou", f"WITH {POLYGON_CELLS}, n AS (SELECT event_id, count(*) AS n FROM cell GROUP BY event_id), b AS (SELECT a.event_id AS first, count(*) AS shared FROM cell a JOIN cell b ON a.event_id % 2 = 0 AND b.event_id = a.event_id + 1 AND a.r = b.r AND a.c = b.c GROUP BY 1) SELECT first AS event_id, shared, round(shared / (x.n + y.n - shared), 6) AS iou FROM b JOIN n x ON x.event_id = first JOIN n y ON y.event_id = first + 1")
def scl17(spark, d):
    """Overlap of the masks of events 2k and 2k + 1, which share an image."""
    runs = polygons(spark, d).withColumn("image", F.floor(F.col("event_id") / 2))
    even, odd = (runs.where(F.col("event_id") % 2 == k).withColumnRenamed("event_id", name) for k, name in enumerate(("event_id", "other")))
    return masks.mask_ious(even, odd, ["image"], "event_id", "other", tasks_of(spark, d)).select("event_id", "shared", F.round("iou", 6).alias("iou"))


@query("set02_tile_unions", f"WITH {POLYGON_CELLS}, m AS (SELECT DISTINCT event_id // 3 AS mask, r + (event_id % 3) * 12 - 6 AS r, c + (event_id % 5) * 9 - 8 AS c FROM cell) SELECT mask, count(*) AS cells, min(r) AS first_row, max(r) AS last_row FROM m WHERE r BETWEEN 0 AND 39 AND c BETWEEN 0 AND 43 GROUP BY mask")
def set02b(spark, d):
    """Masks of tiles in their image: shifted, clipped and united by threes; those without a cell in the image are gone."""
    moved = masks.shifted(polygons(spark, d), (F.col("event_id") % 3) * 12 - 6, (F.col("event_id") % 5) * 9 - 8, 40, 44).withColumn("mask", F.floor(F.col("event_id") / 3))
    whole = masks.united(moved.repartition(tasks_of(spark, d), "mask"), ["mask"])
    return whole.groupBy("mask").agg(F.sum(F.col("end") - F.col("start")).alias("cells"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


TILES = "sz AS (SELECT line, max(row) + 1 AS n FROM im GROUP BY line), ts AS (SELECT DISTINCT line, least(t * 24, greatest(n - 32, 0)) AS tr FROM sz, unnest(range(0, 5)) AS x(t) WHERE t = 0 OR (t - 1) * 24 < greatest(n - 32, 0))"
HEAT = f"{CELLS}, {TILES}, heat AS (SELECT im.line, row, col, max(v * (1e0 + (tr % 5) / 1e1)) AS heat FROM im JOIN ts ON ts.line = im.line AND row >= tr AND row < tr + 32 GROUP BY 1, 2, 3)"


def heat_map(spark, d):
    """Heat of overlapping tiles of 32 rows, the largest for each cell; a tile's own scale depends on where it starts."""
    image = cells(spark, d)
    rows = image.groupBy("line").agg((F.max("row") + 1).alias("n"))
    tiled = image.join(rows, "line").withColumn("tr", F.explode(raster.tiles_of(F.col("row"), F.col("n"), 32, 0.25)))
    return tiled.groupBy("line", "row", "col").agg(F.max(F.col("v") * (1.0 + (F.col("tr") % 5) / 10)).alias("heat"))


@query("ras08_merged_heat", f"{HEAT} SELECT line, row, col, round(heat, 6) AS heat FROM heat", V)
def ras08b(spark, d):
    return heat_map(spark, d).select("line", "row", "col", F.round("heat", 6).alias("heat"))


@query("ras08_heat_in_masks", f"{HEAT}, k AS (SELECT im.line, im.col // 8 AS band, heat FROM im JOIN heat USING (line, row, col) WHERE v >= 200) SELECT line, band, round(least(1, greatest(0, avg(heat) / 799.4e0)), 6) AS mean_share, round(least(1, greatest(0, max(heat) / 799.4e0)), 6) AS max_share FROM k GROUP BY line, band", V)
def ras08c(spark, d):
    """Heat in the masks of bright cells of bands of 8 columns."""
    bright = cells(spark, d).where("v >= 200").withColumn("band", F.floor(F.col("col") / 8))
    runs = masks.runs_of(bright, ["line", "band"], "row", "col")
    out = masks.heat_in_masks(heat_map(spark, d), runs, ["line"], ["line", "band"], "row", "col", "heat", 399.7)
    return out.select("line", "band", F.round("mean_share", 6).alias("mean_share"), F.round("max_share", 6).alias("max_share"))


@query("geo09_measured_regions", f"""{CELLS}, g AS (SELECT line, row, col, col - row_number() OVER (PARTITION BY line, row ORDER BY col) AS g FROM im WHERE v >= 200),
 rn AS (SELECT row_number() OVER (ORDER BY line, row, min(col)) AS id, line, row, min(col) AS s, max(col) + 1 AS e FROM g GROUP BY line, row, g),
 adj AS (SELECT a.id AS x, b.id AS y FROM rn a JOIN rn b ON a.line = b.line AND abs(a.row - b.row) = 1 AND a.s <= b.e AND b.s <= a.e),
 reach AS (SELECT id AS root, id FROM rn UNION SELECT reach.root, adj.y FROM reach JOIN adj ON adj.x = reach.id),
 reg AS (SELECT id, min(root) AS region FROM reach GROUP BY id),
 own AS (SELECT region, line, row, s, e FROM reg JOIN rn USING (id)),
 sm AS (SELECT region, any_value(line) AS line, sum(e - s) AS cells, sum((e - s) * row) / sum(e - s) AS cr, sum((e - s) * (s + e - 1) / 2) / sum(e - s) AS cc FROM own GROUP BY region),
 pt AS (SELECT DISTINCT region, x, y FROM (SELECT region, s AS x, row AS y FROM own UNION ALL SELECT region, e - 1, row FROM own)),
 pr AS (SELECT region, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM pt a JOIN pt b USING (region) WHERE a.x <> b.x OR a.y <> b.y),
 hull AS (SELECT region, dx, dy FROM pr JOIN pt USING (region) GROUP BY region, ax, ay, dx, dy HAVING min(dx * (y - ay) - dy * (x - ax)) >= 0),
 dir AS (SELECT DISTINCT region, CASE WHEN dx > 0 AND dy >= 0 THEN dx WHEN dx <= 0 AND dy > 0 THEN dy WHEN dx < 0 THEN -dx ELSE -dy END AS ux, CASE WHEN dx > 0 AND dy >= 0 THEN dy WHEN dx <= 0 AND dy > 0 THEN -dx WHEN dx < 0 THEN -dy ELSE dx END AS uy FROM hull),
 bx AS (SELECT region, ux, uy, max(ux * x + uy * y) - min(ux * x + uy * y) AS a, max(ux * y - uy * x) - min(ux * y - uy * x) AS b, ux * ux + uy * uy AS n FROM dir JOIN pt USING (region) GROUP BY region, ux, uy),
 bs AS (SELECT region, first(struct_pack(a := a / sqrt(n), b := b / sqrt(n), t := degrees(atan2(uy, ux))) ORDER BY round(a * b / n, 6), round(degrees(atan2(uy, ux)), 6)) AS k FROM bx GROUP BY region),
 fin AS (SELECT sm.*, first.row AS first_row, first.s AS first_col, greatest(coalesce(k.a, 0), coalesce(k.b, 0)) AS l, least(coalesce(k.a, 0), coalesce(k.b, 0)) AS w, coalesce(k.t + CASE WHEN k.a < k.b THEN 90 ELSE 0 END, 0) AS t, sm.line * 100 + CAST(round_even(cr, 0) AS BIGINT) AS ping FROM sm JOIN rn first ON first.id = region LEFT JOIN bs USING (region))
 SELECT line, first_row, first_col, CAST(cells AS BIGINT) AS cells, round((l + 1) * 0.5, 4) AS length_m, round((w + 1) * 0.5, 4) AS width_m, round(cells * 0.25, 4) AS area_m2, CASE WHEN cc >= 32 THEN 'starboard' ELSE 'port' END AS side, round(abs(cc - 32) * 0.5, 4) AS ground_range_m,
  CASE WHEN ping % 11 <> 0 THEN round(((ping * 7 % 360 + 90 - t) % 180 + 180) % 180, 4) END AS orientation_deg, CASE WHEN ping % 13 <> 0 THEN round(ping % 40 + 5e0 + ping % 10, 4) END AS depth_m FROM fin /* RECURSIVE */""", V)
def geo09b(spark, d):
    """Bright regions of lines of 100 pings at half a metre a cell: sides, area, direction, side, range and depth."""
    runs = masks.regions(masks.runs_of(cells(spark, d).where("v >= 200"), ["line"], "row", "col"), ["line"])
    by = ["line", "first_row", "first_col"]
    rows = cells(spark, d).select("line", "row", "ping").distinct()
    heading, altitude = F.when(F.col("ping") % 11 != 0, (F.col("ping") * 7 % 360).cast("double")), F.when(F.col("ping") % 13 != 0, 5.0 + F.col("ping") % 10)
    pings = rows.select("line", "row", heading.alias("heading_deg"), (F.col("ping") % 40).cast("double").alias("sensor_depth_m"), altitude.alias("altitude_m"), (13 + F.col("ping") * 1e-6).alias("lat"), F.lit(80.0).alias("lon"))
    out = masks.placed(masks.measured(runs, by, 0.5), pings, by, "line", 32.0, 0.5)
    return out.select(*by, "cells", *[F.round(c, 4).alias(c) for c in ("length_m", "width_m", "area_m2")], "side", *[F.round(c, 4).alias(c) for c in ("ground_range_m", "orientation_deg", "depth_m")])
