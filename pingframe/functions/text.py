"""Text forms of detections: CSV, WKT, GeoJSON, KML and alert lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALERT_BYTES = 256


def fixed(value: Column, decimals: int) -> Column:
    """The value with so many decimals; empty if it is null."""
    return F.when(value.isNull(), "").otherwise(F.format_string(f"%.{decimals}f", value.cast("double")))


def csv_line(*cells: Column) -> Column:
    """Cells joined by commas; null cells are empty."""
    return F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells])


def wkt_point(lon: Column, lat: Column) -> Column:
    return F.format_string("POINT (%.6f %.6f)", lon, lat)


def wkt_numbers(wkt: Column) -> Column:
    return F.transform(F.regexp_extract_all(wkt, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def geojson_point(lon: Column, lat: Column, properties: dict[str, Column]) -> Column:
    inside = F.to_json(F.struct(*[c.alias(k) for k, c in properties.items()]))
    return F.concat(F.format_string('{"type":"Feature","geometry":{"type":"Point","coordinates":[%.6f,%.6f]},"properties":', lon, lat), inside, F.lit("}"))


def kml_folders(detections: DataFrame, by: list[str]) -> DataFrame:
    """One folder text for each group and class, placemarks by detection_id."""
    mark = F.format_string("<Placemark><name>%s</name><Point><coordinates>%.6f,%.6f,0</coordinates></Point></Placemark>", "detection_id", "lon", "lat")
    listed = detections.groupBy(*by, "cls").agg(F.array_sort(F.collect_list(F.struct("detection_id", mark.alias("mark")))).alias("m"))
    return listed.select(*by, "cls", F.concat(F.lit("<Folder><name>"), "cls", F.lit("</name>"), F.array_join(F.transform("m", lambda x: x["mark"]), ""), F.lit("</Folder>")).alias("folder"))


def alert(survey: Column, detection: Column, cls: Column, confidence: Column, lat: Column, lon: Column, size: Column, depth: Column, time: Column) -> Column:
    """The compact alert line, cut to ALERT_BYTES bytes."""
    line = F.concat_ws("|", F.lit("SS1"), survey.cast("string"), F.substring_index(detection, "-", -1), cls, fixed(confidence, 0), fixed(lat, 6), fixed(lon, 6), size, fixed(depth, 1), F.coalesce(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")))
    return F.when(F.octet_length(line) <= ALERT_BYTES, line).otherwise(F.decode(F.substring(F.encode(line, "UTF-8"), 1, ALERT_BYTES), "UTF-8"))
