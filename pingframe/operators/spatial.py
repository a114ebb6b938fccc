"""Spatial joins and clusters over grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingframe.functions.geo import EARTH_M, haversine
from pingframe.operators.graph import connected
from pingframe.plans.tables import written

DEGREE_M = EARTH_M * 3.141592653589793 / 180


def near_pairs(points: DataFrame, radius_m: float, same: list[str]) -> DataFrame:
    """(a, b): ids of points with equal `same` columns within radius_m, a < b. Points without a position take no part.

    An equi-join on (same, row, column) cells of the radius: one side visits its own and the neighbouring cells. Longitude columns are
    sized for the row's own band of a tenth of a degree; a point at the edge of a band also visits the next band's columns.
    """
    height = radius_m * 1.01 / DEGREE_M
    placed = points.where("lat is not null and lon is not null")
    band = lambda lat: F.floor(lat * 10)
    width = lambda b: F.lit(height) / F.greatest(F.cos(F.radians(F.least(F.abs(b) + 1, F.lit(899)) / 10)), F.lit(1e-6))
    own = placed.select("id", "lat", "lon", *same, band(F.col("lat")).alias("band"), F.floor(F.col("lat") / height).alias("gy"))
    own = own.withColumn("gx", F.floor(F.col("lon") / width(F.col("band"))))
    other = placed.select(F.col("id").alias("o_id"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), *same, F.explode(F.array_distinct(F.array(band(F.col("lat") - height), band(F.col("lat")), band(F.col("lat") + height)))).alias("band"))
    other = other.withColumn("gy", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("o_lat") / height) + d)))
    other = other.withColumn("gx", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("o_lon") / width(F.col("band"))) + d)))
    met = own.join(other, [*same, "band", "gy", "gx"]).where("id < o_id")
    return met.where(haversine(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")) <= radius_m).select(F.col("id").alias("a"), F.col("o_id").alias("b"))


def near_groups(points: DataFrame, radius_m: float, same: list[str]) -> DataFrame:
    """points (id, lat, lon, same and more) with root: the smallest id that chains of points within radius_m with equal `same` columns reach.
    Points without a position are their own root.

    Points of one cell of 0.7 radii a side are all near each other, so links are between cells. Cells beside each other are linked by their
    outermost points, if these are near; all points are compared only where two cells are in different groups after that. So pairs grow with
    the cells, and dense places give no more of them.
    """
    height = radius_m * 0.7 / DEGREE_M
    nearest = lambda gy: F.when(gy >= 0, gy).otherwise(-gy - 1) * height
    width = lambda gy: F.lit(height) / F.greatest(F.cos(F.radians(F.least(nearest(gy), F.lit(90.0)))), F.lit(1e-9))
    cut = points.withColumn("__gy", F.floor(F.col("lat") / height))
    cut = cut.withColumn("__gx", F.floor(F.col("lon") / width(F.col("__gy"))))
    key = [*same, "__gy", "__gx"]
    by_lat, by_lon = F.struct("lat", "lon"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
    turned = lambda c: F.struct(c["y"].alias("lat"), c["x"].alias("lon"))
    outer = F.array(F.min(by_lat), F.max(by_lat), turned(F.min(by_lon)), turned(F.max(by_lon)))
    cells = cut.where("lat is not null and lon is not null").groupBy(*key).agg(F.min("id").alias("cell"), F.count("*").alias("n"), outer.alias("p"), F.min("lon").alias("lo"), F.max("lon").alias("hi"))
    cells = written(cells, "cells")
    # cells of the same row to the right, and those of the two rows above that a circle around the cell touches
    seen = cells.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("row", F.col("__gy") + F.col("up"))
    most = F.least(F.greatest(F.abs(F.col("__gy")), F.abs(F.col("row") + 1)) * height, F.lit(90.0))
    reach = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sin(F.lit(radius_m / 2 / EARTH_M)) * 1.001 / F.greatest(F.cos(F.radians(most)), F.lit(1e-9)))))
    seen = seen.withColumn("col", F.explode(F.sequence(F.floor((F.col("lo") - reach) / width(F.col("row"))), F.floor((F.col("hi") + reach) / width(F.col("row"))))))
    seen = seen.where("up > 0 or col > __gx").select(*same, F.col("row").alias("__gy"), F.col("col").alias("__gx"), F.col("cell").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"))
    met = seen.join(cells.select(*key, F.col("cell").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb")), key)
    close = F.exists("pa", lambda p: F.exists("pb", lambda q: haversine(p["lat"], p["lon"], q["lat"], q["lon"]) <= radius_m))
    beside = written(met.select("a", "b", (F.greatest("na", "nb") > 2).alias("more"), close.alias("near")), "beside")
    links = beside.where("near").select("a", "b")
    roots = connected(links)
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    open_ = beside.where("more and not near").join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
    open_ = written(open_, "open")
    if not open_.isEmpty():
        placed = cut.join(cells.select(*key, "cell"), key)
        mine, other = (placed.select(F.col("cell").alias(c), F.col("lat").alias(f"{c}_lat"), F.col("lon").alias(f"{c}_lon")) for c in ("a", "b"))
        linked = open_.join(mine, "a").join(other, "b").where(haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= radius_m)
        roots = connected(links.unionByName(linked.select("a", "b").distinct()))
    rooted = cells.select(*key, "cell").join(roots, F.col("cell") == F.col("node"), "left").select(*key, F.coalesce("root", "cell").alias("root"))
    return cut.join(rooted, key, "left").withColumn("root", F.coalesce("root", "id")).drop("__gy", "__gx")


def clustered(detections: DataFrame, radius_m: float = 5.0) -> DataFrame:
    """Detections of a class that chains of near sightings join, merged where at least two source files saw them.

    The most confident member stays (ties: smaller detection_id) at the mean position, with n_views distinct sources and persistence
    1 - 0.5^n; the others go. Components that one file saw stay as they are, with one view.
    """
    rooted = near_groups(detections.select(F.col("event_id").alias("id"), "detection_id", "lat", "lon", "cls", "confidence", "source_file"), radius_m, ["cls"])
    best = F.struct((-F.col("confidence")).alias("c"), "detection_id")
    sums = rooted.groupBy("root").agg(F.count("*").alias("members"), F.countDistinct("source_file").alias("sources"), F.min(best)["detection_id"].alias("kept"), F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"))
    out = rooted.join(sums, "root")
    merged = (F.col("members") >= 2) & (F.col("sources") >= 2)
    out = out.where(~merged | (F.col("detection_id") == F.col("kept")))
    views = F.when(merged, F.col("sources")).otherwise(1).cast("int")
    return out.select("detection_id", "cls", "confidence", F.when(merged, F.round("mean_lat", 6)).otherwise(F.col("lat")).alias("lat"), F.when(merged, F.round("mean_lon", 6)).otherwise(F.col("lon")).alias("lon"), views.alias("n_views"), (1 - F.pow(F.lit(0.5), views)).alias("persistence"))
