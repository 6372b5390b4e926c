"""Time windows: parsing, the minimum duration, and the quarantined baseline before an incident."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SECONDS, QUARANTINE, BASELINE, LOG_CONTEXT = 120, timedelta(minutes=5), timedelta(minutes=10), timedelta(minutes=5)

_ISO = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z)"
# The phrasings of a range, tried in this order.
RANGE_PATTERNS = (rf"from\s+{_ISO}\s+to\s+{_ISO}", rf"between\s+{_ISO}\s+and\s+{_ISO}", rf"{_ISO}\s+to\s+{_ISO}", rf"during\s+{_ISO}\s+to\s+{_ISO}")
LOOSE_PATTERN = r"(?i)(?:from|时间范围:|during|between)\s*([\w\-\:\.T]+Z?)\s*(?:to|到|and)\s*([\w\-\:\.T]+Z?)"


#: What is tried where a time is not in ISO form.
TIME_FORMATS = ("%Y/%m/%d %H:%M:%S", "%Y/%m/%d %H:%M", "%d %b %Y %H:%M:%S", "%b %d, %Y %H:%M:%S", "%a, %d %b %Y %H:%M:%S %Z", "%m/%d/%Y %H:%M:%S", "%Y/%m/%d", "%m/%d/%Y")


def _tried(text: str, form: str) -> datetime | None:
    try:
        return datetime.strptime(text, form)
    except ValueError:
        return None


def parse_time(text: str) -> datetime:
    """UTC; a time without a zone counts as UTC."""
    text = text.strip()
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        at = next((t for f in TIME_FORMATS if (t := _tried(text, f))), None)
        if at is None:
            raise
    return (at if at.tzinfo else at.replace(tzinfo=UTC)).astimezone(UTC)


def find_range(text: str) -> tuple[str | None, str | None]:
    for pattern in RANGE_PATTERNS:
        if found := re.search(pattern, text or ""):
            return found[1], found[2]
    return None, None


def find_loose_range(text: str) -> tuple[str | None, str | None]:
    """A range in looser words; its ends are any run of letters, digits, dashes, colons and dots."""
    found = re.search(LOOSE_PATTERN, text or "")
    return (found[1], found[2]) if found else (None, None)


def range_columns(text: Column, patterns: tuple[str, ...] = RANGE_PATTERNS) -> tuple[Column, Column]:
    """(start, end) strings of the first pattern that matches, else null."""
    start, end = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in reversed(patterns):
        hit = F.regexp_extract(text, p, 1)
        start, end = F.when(hit != "", hit).otherwise(start), F.when(hit != "", F.regexp_extract(text, p, 2)).otherwise(end)
    return start, end


@dataclass(frozen=True)
class WindowSpec:
    """The baseline is half-open, the anomaly window closed."""

    baseline_start: datetime
    baseline_end: datetime
    start: datetime
    end: datetime

    @classmethod
    def incident(cls, start: str | datetime, end: str | datetime, quarantine: timedelta = QUARANTINE, baseline: timedelta = BASELINE, before: bool = False) -> WindowSpec:
        """A window under two minutes is lengthened at its end; before: moved ahead of its start instead (compatibility with the service metrics' rule)."""
        a, b = (parse_time(x) if isinstance(x, str) else x for x in (start, end))
        if (b - a).total_seconds() < MIN_SECONDS:
            a -= timedelta(seconds=MIN_SECONDS if before else 0)
            b = a + timedelta(seconds=MIN_SECONDS)
        return cls(a - quarantine - baseline, a - quarantine, a, b)

    @classmethod
    def logs(cls, start: str | datetime, end: str | datetime) -> WindowSpec:
        """Logs compare with the five minutes that end at the window's start."""
        own = cls.incident(start, end)
        return cls(own.start - LOG_CONTEXT, own.start, own.start, own.end)

    @property
    def minutes(self) -> float:
        return (self.end - self.start).total_seconds() / 60 or 1.0

    def bound(self, at: datetime, kind: str = "timestamp_ntz") -> Column:
        """A literal of the time column's own type, so that the filter reaches the scan."""
        text = at.strftime("%Y-%m-%d %H:%M:%S.%f")
        return F.lit(text + ("+00:00" if kind == "timestamp" and at.tzinfo else "")).cast(kind)

    def in_baseline(self, time: str, kind: str = "timestamp_ntz") -> Column:
        return (F.col(time) >= self.bound(self.baseline_start, kind)) & (F.col(time) < self.bound(self.baseline_end, kind))

    def in_anomaly(self, time: str, kind: str = "timestamp_ntz") -> Column:
        return F.col(time).between(self.bound(self.start, kind), self.bound(self.end, kind))


def incident_table(cases: DataFrame, start: str = "start", end: str = "end", quarantine: timedelta = QUARANTINE, baseline: timedelta = BASELINE, before: bool = False) -> DataFrame:
    """cases with the window of each (baseline_start, baseline_end, start, end), by the rules of WindowSpec.incident."""
    a, b = F.col(start), F.col(end)
    least = F.make_dt_interval(secs=F.lit(MIN_SECONDS))
    short = b < a + least
    a = F.when(short, a - least).otherwise(a) if before else a
    b = F.when(short, a + least).otherwise(b)
    return cases.select(*[c for c in cases.columns if c not in (start, end)], (a - F.lit(quarantine + baseline)).alias("baseline_start"), (a - F.lit(quarantine)).alias("baseline_end"), a.alias("start"), b.alias("end"))


def log_table(cases: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """As incident_table, by the rules of WindowSpec.logs."""
    own = incident_table(cases, start, end)
    return own.withColumns({"baseline_start": F.col("start") - F.lit(LOG_CONTEXT), "baseline_end": F.col("start")})


#: Seconds of the time buckets by which rows and windows meet, and windows' buckets that are broadcast at most.
BUCKET_SECONDS, BROADCAST_BUCKETS = 600, 200_000


def in_windows(rows: DataFrame, windows: DataFrame, time: str = "time") -> DataFrame:
    """rows with `window`, for each window whose baseline (half-open) or anomaly part (closed) holds the row's time, and the flags __base and __anomaly.

    One scan serves all windows, which may overlap: rows and windows meet by time buckets. The scan is bounded by the first and the last time of all.
    """
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (BUCKET_SECONDS * 1_000_000))
    part = lambda a, b: F.sequence(bucket(F.col(a)), bucket(F.col(b)))
    fine = windows.where((F.col("baseline_start") <= F.col("baseline_end")) & (F.col("start") <= F.col("end")))
    held = fine.select(F.struct(*windows.columns).alias("window"), F.explode(F.array_distinct(F.concat(part("baseline_start", "baseline_end"), part("start", "end")))).alias("__bucket"))
    ends = fine.agg(F.min(F.least("baseline_start", "start")).cast("string").alias("low"), F.max(F.greatest("baseline_end", "end")).cast("string").alias("high"), F.sum(F.size(part("baseline_start", "baseline_end")) + F.size(part("start", "end"))).alias("n")).first()
    kind = rows.schema[time].dataType
    own = rows.where(F.col(time).between(F.lit(ends["low"]).cast(kind), F.lit(ends["high"]).cast(kind))).withColumn("__bucket", bucket(F.col(time)))
    met = own.join(F.broadcast(held) if (ends["n"] or 0) <= BROADCAST_BUCKETS else held, "__bucket").drop("__bucket")
    base = (F.col(time) >= F.col("window.baseline_start")) & (F.col(time) < F.col("window.baseline_end"))
    return met.withColumns({"__base": base, "__anomaly": F.col(time).between(F.col("window.start"), F.col("window.end"))}).where("__base or __anomaly")
