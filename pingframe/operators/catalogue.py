"""Surveys, files, reviews and reports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Format by extension, and the first bytes (hexadecimal) that a format's files begin with.
FORMATS = {"xtf": "xtf", "tif": "geotiff", "tiff": "geotiff", "png": "image_nav", "jpg": "image_nav", "jpeg": "image_nav", "csv": "csv"}
MAGIC = {"xtf": ("7B",), "geotiff": ("49492A00", "4D4D002A", "49492B00", "4D4D002B"), "png": ("89504E470D0A1A0A",), "jpg": ("FFD8FF",), "jpeg": ("FFD8FF",)}


def admitted(files: DataFrame, most_bytes: int, formats: dict[str, str] | None = None, magic: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """files (path, content) with format and error: UNSUPPORTED_FORMAT, FILE_TOO_LARGE, CORRUPT_HEADER or null."""
    formats, magic = formats or FORMATS, magic or MAGIC
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    raw = F.col("content").cast("binary")
    head = F.hex(F.substring(raw, 1, 8))
    fine = F.lit(False)
    for e in formats:
        if e == "csv":
            ok = ~F.contains(head, F.lit("00"))
        else:
            ok = F.lit(False)
            for m in magic.get(e, ()):
                ok |= head.startswith(m)
        fine |= (F.col("ext") == e) & ok
    named = files.withColumn("ext", ext)
    kind = F.lit(None).cast("string")
    for e, k in formats.items():
        kind = F.when(F.col("ext") == e, k).otherwise(kind)
    error = F.when(kind.isNull(), "UNSUPPORTED_FORMAT").when(F.octet_length(raw) > most_bytes, "FILE_TOO_LARGE").when(~fine, "CORRUPT_HEADER")
    return named.withColumn("format", kind).withColumn("error", error)


def safe_name(name: Column) -> Column:
    """The last path part with everything but letters, digits, dot, dash and underscore replaced; never empty."""
    last = F.regexp_replace(name, r"^.*[/\\]", "")
    clean = F.regexp_replace(last, r"[^A-Za-z0-9._-]+", "_")
    return F.when(F.trim(clean, F.lit("._")) == "", "file").otherwise(clean)


def slug(name: Column, default: str = "default") -> Column:
    """Lower-case words joined by dashes."""
    out = F.lower(F.trim(F.regexp_replace(name, "[^A-Za-z0-9]+", "-"), F.lit("-")))
    return F.when((out == "") | out.isNull(), default).otherwise(out)


def next_id(ids: DataFrame, column: str, prefix: str) -> DataFrame:
    """(next_id): prefix and the largest numeric suffix plus one, three digits at least."""
    number = F.expr(f"try_cast(substring({column}, {len(prefix) + 1}) AS bigint)")
    top = F.coalesce(F.max(F.when(F.col(column).startswith(prefix), number)), F.lit(0)) + 1
    return ids.agg(top.alias("n")).select(F.concat(F.lit(prefix), F.when(F.col("n") < 1000, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string"))).alias("next_id"))


def overview(surveys: DataFrame, files: DataFrame, jobs: DataFrame | None = None, detections: DataFrame | None = None) -> DataFrame:
    """Each survey with its files' number, bytes, pings and names, its job's status and seconds, and its detections by tier.

    jobs: (survey_key, job_id, status, started, finished); a survey without a job has its own status. detections: (survey_key,
    alert_tier). Everything is summed before it is joined, so nothing is looked up per row.
    """
    sums = files.groupBy("survey_key").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.sum("pings").alias("pings"), F.array_sort(F.collect_set("filename")).alias("filenames"))
    out = surveys.join(sums, "survey_key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    more = [zero("files"), zero("bytes"), zero("pings"), F.coalesce("filenames", F.array().cast("array<string>")).alias("filenames")]
    if jobs is not None:
        seconds = (F.unix_micros(F.col("finished").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
        out = out.join(jobs.select("survey_key", "job_id", F.col("status").alias("job_state"), seconds.alias("duration_s")), "survey_key", "left")
        more += ["job_id", F.coalesce("job_state", "status").alias("job_status"), "duration_s"]
    if detections is not None:
        tiers = detections.groupBy("survey_key").agg(F.count("*").alias("total"), F.count_if(F.col("alert_tier") == "hazard").alias("hazards"))
        out = out.join(tiers, "survey_key", "left")
        more += [zero("total"), zero("hazards")]
    return out.select(*surveys.columns, *more)


def latest(rows: DataFrame, key: str, order: list[str], *keep: str) -> DataFrame:
    """The last row of each key by `order`; a maximum of structs, so rows combine before the shuffle."""
    top = F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("m")
    return rows.groupBy(key).agg(top).select(key, *[F.col(f"m.{c}").alias(c) for c in keep])


def label_store(reviews: DataFrame) -> DataFrame:
    """The labels that stand: each detection's last decision, unless it is pending."""
    return latest(reviews, "detection_key", ["turn"], "turn", "status").where("status <> 'pending'")


def review_changes(reviews: DataFrame) -> DataFrame:
    """The decisions that changed something, with the state before (pending at first)."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy("detection_key").orderBy("turn")), F.lit("pending"))
    return reviews.withColumn("old_status", before).where("status <> old_status")


def without_survey(tables: dict[str, DataFrame], survey_key: int, unfinished: tuple[str, ...] = ("queued", "running")) -> dict[str, DataFrame]:
    """All tables less the rows of one survey; refused while its job runs."""
    if tables["survey"].where((F.col("survey_key") == survey_key) & F.col("status").isin(*unfinished)).limit(1).count():
        raise ValueError(f"survey {survey_key} is not finished")
    return {k: t.where(F.col("survey_key") != survey_key) for k, t in tables.items()}


def added(known: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """known and the rows of new whose key it does not hold, each once."""
    return known.unionByName(new.dropDuplicates(key).join(known.select(*key), key, "left_anti"), allowMissingColumns=True)


def survey_rollup(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines summed to surveys: pings, flags by or, span of time and the sorted union of warnings."""
    warnings = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("warnings")))), ",")
    return lines.groupBy(*by).agg(F.count("*").alias("lines"), F.sum("pings").alias("pings"), F.bool_or("geotagged").alias("geotagged"), F.min("first_utc").alias("first_utc"), F.max("last_utc").alias("last_utc"), warnings.alias("warnings"))


def split_digests(items: DataFrame, split: str, site: str, objects: str, digest: str) -> DataFrame:
    """(split, n, sites, median_objects, p90, digest): counts of each split and a digest of its items that no order changes.

    Digests are sorted and hashed in bins of their first three digits, and the bins' hashes in order once more, so no task sees all of
    a split. Medians come from the counts of distinct values.
    """
    bins = items.groupBy(split, F.substring(digest, 1, 3).alias("bin")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), ","), 256).alias("part"))
    pairs = F.array_sort(F.collect_list(F.struct("bin", "part")))
    whole = bins.groupBy(split).agg(F.sha2(F.array_join(F.transform(pairs, lambda p: p["part"]), ","), 256).alias("digest"))
    values = items.groupBy(split, objects).agg(F.count("*").alias("k"))
    middle = values.groupBy(split).agg(F.sum("k").alias("n"), F.percentile(objects, F.lit(0.5), F.col("k")).alias("median_objects"), F.percentile(objects, F.lit(0.9), F.col("k")).alias("p90"))
    sites = items.groupBy(split).agg(F.countDistinct(site).alias("sites"))
    return middle.join(sites, split).join(whole, split).select(split, "n", "sites", "median_objects", "p90", "digest")
