"""Reports of detections as rows and files: CSV, GeoJSON, KML and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingframe.functions import geo, text

#: The columns of a report, in order, and the decimals of those that have a fixed number of them.
COLUMNS = (
    "detection_id", "survey_id", "class", "confidence", "alert_tier", "lat", "lon", "depth_m", "uncertainty_m", "length_m", "width_m", "area_m2",
    "height_m", "orientation_deg", "side", "ping_start", "ping_end", "ground_range_m", "time_utc", "n_views", "quality_flags", "review_status", "source_file",
)
DECIMALS = {"confidence": 1, "lat": 6, "lon": 6}
#: Formats of which a file is written, and those that need a position.
FORMATS, MAPPED = ("csv", "geojson", "json", "kml"), ("geojson", "kml")


def rows(detections: DataFrame) -> DataFrame:
    """The COLUMNS of each detection as text: nulls are empty, flags joined by semicolons; columns that are not there are empty."""
    named = detections.withColumnRenamed("cls", "class") if "cls" in detections.columns else detections

    def cell(name: str) -> Column:
        if name not in named.columns:
            return F.lit("")
        c = F.col(name)
        if name == "quality_flags":
            return F.array_join(c, ";")
        if name == "review_status":
            return F.coalesce(c, F.lit("pending"))
        return text.fixed(c, DECIMALS[name]) if name in DECIMALS else F.coalesce(c.cast("string"), F.lit(""))

    return named.select(*[cell(name).alias(name) for name in COLUMNS])


def features(detections: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """(survey_id, kind, key, feature): GeoJSON features of the tracks, the detections with a position, and their footprints.

    tracks: (survey_id, points: array of lat, lon), a line from two points on. A footprint (array of lat, lon) is a closed ring that
    runs counter-clockwise; one of under three corners is left out. Coordinates have six decimals.
    """
    own = [c for c in ("confidence", "alert_tier", "length_m", "width_m", "depth_m") if c in detections.columns]
    seen = detections.where("lat is not null and lon is not null")
    about = F.struct(F.lit("detection").alias("feature_kind"), "detection_id", F.col("cls").alias("class"), *own, F.coalesce("review_status", F.lit("pending")).alias("review_status"))
    at = lambda lon, lat: F.array(F.round(lon, 6), F.round(lat, 6))
    out = _features(seen, "detection", F.col("detection_id"), about, "Point", at(F.col("lon"), F.col("lat")))
    if "footprint" in detections.columns:
        ring = F.transform(geo.closed_ring(F.col("footprint")), lambda p: at(p["lon"], p["lat"]))
        shaped = seen.withColumn("ring", ring).where("ring is not null")
        about = F.struct(F.lit("footprint").alias("feature_kind"), "detection_id", F.col("cls").alias("class"))
        out = out.unionByName(_features(shaped, "footprint", F.col("detection_id"), about, "Polygon", F.array("ring")))
    if tracks is not None:
        about = F.struct(F.lit("track").alias("feature_kind"), "survey_id")
        line = F.transform("points", lambda p: at(p["lon"], p["lat"]))
        out = out.unionByName(_features(tracks.where(F.size("points") >= 2), "track", F.col("survey_id").cast("string"), about, "LineString", line))
    return out


def _features(df: DataFrame, kind: str, key: Column, about: Column, shape: str, places: Column) -> DataFrame:
    geometry = F.struct(F.lit(shape).alias("type"), places.alias("coordinates"))
    whole = F.to_json(F.struct(F.lit("Feature").alias("type"), about.alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"})
    return df.select("survey_id", F.lit(kind).alias("kind"), key.alias("key"), whole.alias("feature"))


def written_formats(detections: DataFrame) -> DataFrame:
    """(survey_id, formats): the formats that a survey's report has; those with a map only if a detection has a position."""
    mapped = F.count("lat") > 0
    return detections.groupBy("survey_id").agg(F.when(mapped, ",".join(FORMATS)).otherwise(",".join(f for f in FORMATS if f not in MAPPED)).alias("formats"))


def write(detections: DataFrame, path: str, formats: tuple[str, ...] = ("json",), tracks: DataFrame | None = None) -> list[str]:
    """Write each format to a folder of its name under path, a folder of it for each survey; returns the formats that were written.

    csv has a header; geojson is a feature a line, json a detection a line, kml the folders by class. Formats with a map are refused
    where no detection has a position. Every file is written by the tasks that hold its rows.
    """
    if unknown := set(formats) - set(FORMATS):
        raise ValueError(f"no report formats: {', '.join(sorted(unknown))}")
    asked = set(formats) & set(MAPPED)
    if asked and detections.where("lat is not null and lon is not null").isEmpty():
        raise ValueError(f"no detection has a position for {', '.join(sorted(asked))}")
    for name in dict.fromkeys(formats):
        folder = f"{path.rstrip('/')}/{name}"
        if name == "csv":
            rows(detections).withColumn("survey", F.col("survey_id")).write.partitionBy("survey").option("header", True).option("emptyValue", "").csv(folder)
        elif name == "json":
            detections.withColumn("survey", F.col("survey_id")).write.partitionBy("survey").json(folder)
        elif name == "geojson":
            features(detections, tracks).select("survey_id", F.col("feature").alias("value")).write.partitionBy("survey_id").text(folder)
        else:
            text.kml_folders(detections.where("lat is not null and lon is not null"), ["survey_id"]).select("survey_id", F.col("folder").alias("value")).write.partitionBy("survey_id").text(folder)
    return list(dict.fromkeys(formats))
