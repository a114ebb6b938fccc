"""Text sources: label lines, predictions, navigation tables, truth files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingframe.operators import series

NAV_REQUIRED = ("ping", "slant_range_m")
NAV_OPTIONAL = ("heading_deg", "altitude_m", "sensor_depth_m", "speed_mps", "roll_deg", "pitch_deg")


class BadSource(ValueError):
    """The source breaks its format; `code` says how."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def polygon(line: Column) -> Column:
    """`class x1 y1 x2 y2 ...` (three points at least) as a struct (cls, points); null for other lines."""
    parts = F.split(F.trim(line), r"\s+")
    n = F.size(parts)
    values = F.transform(parts, lambda x: x.try_cast("double"))
    points = F.transform(F.sequence(F.lit(1), F.floor((n - 1) / 2).cast("int")), lambda k: F.struct(F.get(values, 2 * k - 1).alias("x"), F.get(values, 2 * k).alias("y")))
    fine = (n >= 7) & (n % 2 == 1) & F.forall(values, lambda x: x.isNotNull())
    return F.when(fine, F.struct(F.get(values, F.lit(0)).cast("int").alias("cls"), points.alias("points")))


def box(line: Column) -> Column:
    """`class xc yc w h` as a struct; null unless there are exactly five numbers."""
    values = F.transform(F.split(F.trim(line), r"\s+"), lambda x: x.try_cast("double"))
    fine = (F.size(values) == 5) & F.forall(values, lambda x: x.isNotNull())
    names = ("cls", "xc", "yc", "w", "h")
    return F.when(fine, F.struct(*[(F.get(values, F.lit(i)).cast("int") if n == "cls" else F.get(values, F.lit(i))).alias(n) for i, n in enumerate(names)]))


def bounds(points: Column) -> Column:
    """The box of a polygon's points."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(image, cls, score, polygon) of a folder of JSON lines."""
    kind = "image string, detections array<struct<cls:int,score:double,polygon:array<array<double>>>>"
    return spark.read.schema(kind).json(path).select("image", F.explode("detections").alias("d")).select("image", "d.*")


def truths(text: Column) -> Column:
    """Charted truth in both of its shapes: a list of wrecks, or one approximate position; an array of (name, lat, lon)."""
    wreck = "struct<name:string,lat:double,lon:double>"
    parsed = F.from_json(text, f"wrecks array<{wreck}>, approx_lat double, approx_lon double, class string")
    one = F.when(parsed["approx_lat"].isNotNull(), F.array(F.struct(parsed["class"].alias("name"), parsed["approx_lat"].alias("lat"), parsed["approx_lon"].alias("lon"))))
    return F.coalesce(parsed["wrecks"], one, F.array().cast(f"array<{wreck}>"))


def navigation(rows: DataFrame, n_rows: int) -> DataFrame:
    """A navigation table of text columns, checked, as one row for each of n_rows pings.

    Pings are whole, distinct and below n_rows, at least two have a position. Positions run on linearly beyond the ends, headings by
    their sines and cosines, other columns hold their ends. nav_source tells given rows (csv) from those between (interpolated).
    """
    if missing := [c for c in (*NAV_REQUIRED, "lat", "lon") if c not in rows.columns]:
        raise BadSource("MISSING_COLUMNS", f"columns are missing: {', '.join(missing)}")
    known = [c for c in NAV_OPTIONAL if c in rows.columns]
    typed = rows.select(F.col("ping").try_cast("double").alias("ping"), *[F.col(c).try_cast("double").alias(c) for c in ("slant_range_m", "lat", "lon", *known)])
    bad = (F.col("ping").isNull()) | (F.col("ping") != F.floor("ping")) | ~F.col("ping").between(0, n_rows - 1)
    seen = typed.agg(F.count("*").alias("n"), F.countDistinct("ping").alias("d"), F.count_if(bad).alias("bad"), F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("fixes")).first()
    if seen["bad"] or seen["d"] != seen["n"]:
        raise BadSource("BAD_PING", "pings must be distinct whole numbers below the number of rows")
    if seen["fixes"] < 2:
        raise BadSource("NO_NAVIGATION", "at least two rows need a position")
    every = rows.sparkSession.range(n_rows).select(F.col("id").alias("ping"))
    out = every.join(typed.withColumn("ping", F.col("ping").cast("long")).withColumn("given", F.lit(True)), "ping", "left").withColumn("line", F.lit(0))
    for c in ("lat", "lon", "slant_range_m", *known):
        if c == "heading_deg":
            out = series.interpolated_angle(out, c, "ping", ["line"], "__filled")
        else:
            out = series.interpolated(out, c, "ping", ["line"], "__filled", extrapolate=c in ("lat", "lon"))
        out = out.withColumn(c, F.col("__filled")).drop("__filled")
    return out.withColumn("nav_source", F.when(F.col("given"), "csv").otherwise("interpolated")).drop("given", "line")


def site_of(path: Column) -> Column:
    """The part of a file name before its first digit, in lower case."""
    return F.lower(F.regexp_extract(F.regexp_replace(path, r"^.*/", ""), r"^[^0-9]+", 0))



def with_navigation(rows: DataFrame, navigation: DataFrame, by: list[str], row: str, ping: str) -> DataFrame:
    """Image rows with the navigation of their ping, and not_geotagged; rows without navigation, or without a position there, are kept."""
    nav = navigation.select(*[F.col(c).alias(f"__{c}") for c in by], *[c for c in navigation.columns if c not in by])
    same = F.col(row) == F.col(ping)
    for c in by:
        same &= F.col(c) == F.col(f"__{c}")
    met = rows.join(nav, same, "left").drop(*[f"__{c}" for c in by])
    return met.withColumn("not_geotagged", F.col("lat").isNull() | F.col("lon").isNull())
