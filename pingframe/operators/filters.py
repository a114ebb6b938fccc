"""Detection filters, scopes, orders, pages and their validation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta
from functools import reduce
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the data model.
CLASSES = ("shipwreck", "pipe", "cylinder", "ghost_net", "debris_other", "unknown_anomaly")
TIERS = ("hazard", "review", "anomaly", "hidden")
STATUSES = ("pending", "confirmed", "rejected", "reclassified")
FLAGS = (
    "DROPOUT", "HIGH_MOTION", "NEAR_NADIR", "SURFACE_RETURN_BAND", "TILE_EDGE", "GPS_INTERPOLATED", "LAYBACK_ESTIMATED", "HEADING_FROM_COG",
    "NO_ALTITUDE_BOTTOM_TRACKED", "NOT_GEOTAGGED",
)
SORTS = ("confidence", "-confidence", "area", "-area", "ping", "-ping", "class")
MOST_ROWS = 5000


class Refused(ValueError):
    """A value lies outside of the domain of its field."""


def status() -> Column:
    """The review status; detections that nobody reviewed are pending."""
    return F.coalesce("review_status", F.lit("pending"))


@dataclass(frozen=True)
class OneOf:
    """Names of a fixed list, comma-joined; rows whose value is one of them stay."""

    known: tuple[str, ...]
    value: Callable[[], Column]

    def read(self, given: str) -> tuple[str, ...] | None:
        return tuple(dict.fromkeys(filter(None, map(str.strip, str(given).split(","))))) or None

    def wrong(self, names: tuple[str, ...]) -> bool:
        return not set(names) <= set(self.known)

    def keeps(self, names: tuple[str, ...]) -> Column:
        return self.value().isin(*names)


class AnyOf(OneOf):
    """As OneOf, of an array that must hold one of the names."""

    def keeps(self, names: tuple[str, ...]) -> Column:
        return F.arrays_overlap(self.value(), F.array(*map(F.lit, names)))


@dataclass(frozen=True)
class Bound:
    """A number between low and high that values must reach, or must not exceed."""

    column: str
    upper: bool
    low: float = 0.0
    high: float = 100.0

    def read(self, given: float | str) -> float:
        return float(given)

    def wrong(self, number: float) -> bool:
        return not self.low <= number <= self.high

    def keeps(self, number: float) -> Column:
        return F.col(self.column) <= number if self.upper else F.col(self.column) >= number


class Area:
    """West, south, east and north in degrees, comma-joined, not over the date line; rows without a position go."""

    def read(self, given: str) -> tuple[float, ...] | None:
        return tuple(map(float, given.split(","))) if given else None

    def wrong(self, sides: tuple[float, ...]) -> bool:
        return len(sides) != 4 or not (-180 <= sides[0] <= sides[2] <= 180 and -90 <= sides[1] <= sides[3] <= 90)

    def keeps(self, sides: tuple[float, ...]) -> Column:
        inside = F.col("lon").between(sides[0], sides[2]) & F.col("lat").between(sides[1], sides[3])
        return F.coalesce(inside, F.lit(False))


#: What can be asked for, by the name of the parameter.
FIELDS = {
    "class": OneOf(CLASSES, lambda: F.col("cls")),
    "tier": OneOf(TIERS, lambda: F.col("alert_tier")),
    "review_status": OneOf(STATUSES, status),
    "flags": AnyOf(FLAGS, lambda: F.col("quality_flags")),
    "min_conf": Bound("confidence", upper=False),
    "max_conf": Bound("confidence", upper=True),
    "bbox": Area(),
}


@dataclass(frozen=True)
class Wanted:
    """Restrictions by field, all of which must hold, whether rejected detections count, and the order."""

    held: dict[str, object] = field(default_factory=dict)
    rejected: bool = True
    sort: str = "-confidence"

    @classmethod
    def of(cls, sort: str | None = None, include_rejected: bool = True, **given: object) -> Wanted:
        """From request parameters (`classes` or `class`). None and empty lists restrict nothing; what no field allows is refused."""
        held = {}
        for name, value in given.items():
            name = "class" if name == "classes" else name
            if name not in FIELDS:
                raise Refused(f"there is no field {name}")
            try:
                read = None if value is None else FIELDS[name].read(value)
            except ValueError:
                raise Refused(f"{name}: {value!r} cannot be read") from None
            if read is not None:
                if FIELDS[name].wrong(read):
                    raise Refused(f"{name}: {value!r} is outside of its domain")
                held[name] = read
        if held.get("min_conf", 0.0) > held.get("max_conf", 100.0):
            raise Refused("no confidence lies between min_conf and max_conf")
        if sort and sort not in SORTS:
            raise Refused(f"sort: {sort!r} is no order")
        return cls(held, include_rejected, sort or cls.sort)

    @classmethod
    def of_url(cls, text: str) -> Wanted:
        """From a URL's search parameters: unknown fields and names, areas and orders that are none are ignored, numbers are held in their bounds."""
        given: dict[str, object] = {}
        for name, value in parse_qsl(text.lstrip("?")):
            kind = FIELDS.get(name)
            try:
                read = kind.read(value) if kind else None
            except ValueError:
                continue
            if isinstance(kind, Bound):
                given[name] = min(kind.high, max(kind.low, read))
            elif isinstance(kind, OneOf):
                given[name] = ",".join(x for x in read or () if x in kind.known)
            elif kind and read and not kind.wrong(read):
                given[name] = value
        sort = dict(parse_qsl(text.lstrip("?"))).get("sort")
        return cls.of(sort=sort if sort in SORTS else None, **given)

    def url(self) -> str:
        """The search parameters that of_url() reads back."""
        text = lambda v: ",".join(map(str, v)) if isinstance(v, tuple) else f"{v:g}"
        return urlencode({**{k: text(v) for k, v in self.held.items()}, **({"sort": self.sort} if self.sort != type(self).sort else {})})

    def but(self, **changes: object) -> Wanted:
        return replace(self, **changes)

    def condition(self) -> Column:
        """The predicate over columns cls, confidence, alert_tier, review_status, quality_flags (array), lat, lon."""
        own = [FIELDS[name].keeps(value) for name, value in self.held.items()]
        return reduce(Column.__and__, own, F.lit(True) if self.rejected else status() != "rejected")


def ordering(sort: str) -> list[Column]:
    """Missing area and ping count as 0; ties go by detection_id upwards."""
    value = {"class": F.col("cls"), "confidence": F.col("confidence"), "area": F.coalesce("area_m2", F.lit(0.0)), "ping": F.coalesce("ping_start", F.lit(0))}[sort.lstrip("-")]
    return [value.desc() if sort.startswith("-") else value.asc(), F.col("detection_id").asc()]


def filtered(detections: DataFrame, q: Wanted) -> DataFrame:
    return detections.where(q.condition())


def page(detections: DataFrame, q: Wanted, offset: int = 0, limit: int = 100) -> DataFrame:
    """The rows from offset on in the order of q; a limited sort keeps offset + limit rows a task, not all."""
    if offset < 0 or limit not in range(1, MOST_ROWS + 1):
        raise Refused(f"a page starts at 0 or later and has 1 to {MOST_ROWS} rows")
    return filtered(detections, q).orderBy(*ordering(q.sort)).offset(offset).limit(limit)


#: What an export holds, by its scope; `filtered` is what its query asks for.
SCOPED: dict[str, Callable[[Wanted], Column]] = {
    "all": lambda q: F.lit(True),
    "filtered": lambda q: q.but(rejected=True).condition(),
    "hazards": lambda q: F.col("alert_tier") == "hazard",
    "confirmed": lambda q: status().isin("confirmed", "reclassified"),
}


def scoped(detections: DataFrame, scope: str, q: Wanted | None = None, include_rejected: bool = False) -> DataFrame:
    """The detections of an export: all, those of q, hazards, or confirmed and reclassified ones; rejected ones only on demand."""
    if scope not in SCOPED:
        raise Refused(f"there is no scope {scope}")
    rows = detections.where(SCOPED[scope](q or Wanted()))
    return rows if include_rejected else rows.where(status() != "rejected")


def client_filtered(detections: DataFrame, classes: tuple[str, ...] = CLASSES, tiers: tuple[str, ...] = TIERS[:3], low: float = 30, high: float = 100, statuses: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """The dashboard's filter: an empty class or tier list matches nothing, an empty status or flag list anything."""
    out = detections.where(F.col("cls").isin(*classes) & F.col("alert_tier").isin(*tiers) & F.col("confidence").between(low, high))
    if statuses:
        out = out.where(F.coalesce("review_status", F.lit("pending")).isin(*statuses))
    return out.where(F.arrays_overlap("quality_flags", F.array(*map(F.lit, flags)))) if flags else out


def day_bounds(start: str | None, end: str | None) -> tuple[datetime | None, datetime | None]:
    """[from, before): a bare date is its whole day, a time is its second; naive means UTC."""

    def parsed(text: str, name: str) -> tuple[datetime, bool]:
        try:
            return (datetime.combine(date.fromisoformat(text), datetime.min.time()), True) if len(text) == 10 else (datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None), False)
        except ValueError:
            raise Refused(f"{name} is no date") from None

    low = parsed(start, "from")[0] if start else None
    high = None
    if end:
        at, whole = parsed(end, "to")
        high = at + (timedelta(days=1) if whole else timedelta(seconds=1))
    if low and high and low >= high:
        raise Refused("from must lie before to")
    return low, high


def literal_pattern(text: str) -> str:
    """A LIKE pattern that finds text itself: its wildcards are escaped."""
    return "%" + text.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def history(surveys: DataFrame, files: DataFrame, text: str | None = None, project: int | None = None, statuses: tuple[str, ...] = (), start: str | None = None, end: str | None = None) -> DataFrame:
    """Surveys whose name, or a file name of theirs, contains text, with the other restrictions; the files are a semi-join."""
    out = surveys
    if text:
        like = literal_pattern(text)
        hits = files.where(F.lower("filename").like(like)).select("survey_key").distinct().withColumn("file_hit", F.lit(True))
        out = out.join(hits, "survey_key", "left").where(F.lower("name").like(like) | F.col("file_hit")).drop("file_hit")
    if project is not None:
        out = out.where(F.col("project_id") == project)
    if statuses:
        out = out.where(F.col("status").isin(*statuses))
    low, high = day_bounds(start, end)
    if low:
        out = out.where(F.col("created_utc") >= F.lit(low))
    if high:
        out = out.where(F.col("created_utc") < F.lit(high))
    return out


def pipe_texture(confidence_in_band: Column, length: Column, width: Column, angle: Column) -> Column:
    """Surface-return rule: at least half in the band, four times as long as wide, within 15 degrees of the track."""
    folded = F.pmod(angle, F.lit(180.0))
    return (confidence_in_band >= 0.5) & (length >= 4 * width) & (F.least(folded, 180 - folded) <= 15)
