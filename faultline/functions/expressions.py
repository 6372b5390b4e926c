"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITY = ("critical", "major", "minor")
NEAR_ZERO = 1e-8


def near_zero(x: Column) -> Column:
    return F.abs(x) <= NEAR_ZERO


def usable(x: Column) -> Column:
    """Null for null, '' and the text 'null'."""
    return F.when((x != "") & (x != "null"), x)


def severity_rank(severity: Column) -> Column:
    return reduce(lambda acc, k: acc.when(severity == SEVERITY[k], k), range(1, len(SEVERITY)), F.when(severity == SEVERITY[0], 0)).otherwise(99)


def change_percentage(now: Column, base: Column) -> Column:
    return F.when(near_zero(base) & (now > 0.001), 99999.0).when(near_zero(base), 0.0).otherwise((now - base) / base * 100)


def byte_unit(x: Column) -> tuple[Column, Column]:
    """(scaled value, unit): B, KB, MB or GB; null stays null with the unit N/A."""
    size = F.abs(x)
    unit = F.when(x.isNull() | F.isnan(x), "N/A").when(size < 1024, "B").when(size < 1024**2, "KB").when(size < 1024**3, "MB").otherwise("GB")
    scale = F.when(size < 1024, 1.0).when(size < 1024**2, 1024.0).when(size < 1024**3, 1024.0**2).otherwise(1024.0**3)
    return x / scale, unit


def format_bytes(x: Column) -> Column:
    value, unit = byte_unit(x)
    return F.when(unit == "N/A", unit).otherwise(F.concat(F.format_string("%.2f ", value), unit))


def comparable_name(name: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), F.lit(""))


def service_of(pod: Column) -> Column:
    return F.regexp_replace(pod, "-[^-]*$", "")


def is_pod(name: Column) -> Column:
    return name.rlike("-[0-9]+$")


def clock(time: Column) -> Column:
    return F.date_format(time, "HH:mm:ss'Z'")


def spike(top: Column, p99: Column, std: Column, above: Column) -> Column:
    """The top exceeds p99 + 2 std, passes the absolute test, and is 20 % over p99 unless that is 0."""
    return (top > p99 + 2 * std) & above & ((p99 <= 1e-6) | ((top - p99) / p99 > 0.2))


def usage_severity(x: Column, otherwise: str) -> Column:
    """Rates come as shares or as percents; over 1.1 they are percents."""
    large = x > 1.1
    return F.when(x > F.when(large, 90.0).otherwise(0.90), "critical").when(x > F.when(large, 80.0).otherwise(0.80), "major").otherwise(otherwise)


def rises(now: Column, base: Column, std: Column) -> Column:
    zero = near_zero(base)
    flat = F.when(zero, ~near_zero(now)).otherwise(((now - base) / base > 0.5) & (F.abs(now - base) > 0.01))
    return F.when(zero & near_zero(now), False).when(std < 1e-6, flat).otherwise(now > base + 3 * std)


def falls(now: Column, base: Column, std: Column) -> Column:
    return F.when(std < 1e-6, ~near_zero(base) & ((base - now) / base > 0.5)).otherwise(now < base - 3 * std)


def departs(now: Column, base: Column, std: Column) -> Column:
    """Two-sided."""
    flat = F.when(near_zero(base), ~near_zero(now)).otherwise(F.abs(now - base) / F.abs(base) > 0.5)
    return F.when(std < 1e-6, flat).otherwise((now > base + 3 * std) | (now < base - 3 * std))


# Text patterns of the log levels, most severe first.
LOG_LEVELS = {
    "system_critical": ("oomkilled", "out of memory", "no space left on device", "read-only file system", "crashloopbackoff"),
    "application_fatal": ("panic", "fatal", "agent failed to start"),
    "business_impact_error": ("failed to charge card", "could not retrieve products", "failed to get cart", "failed to get recommendations", "failed to get ads", "payment failed", "shipping failed"),
    "connectivity_error": ("unable to connect to", "connection refused", "unavailable", "grpc", "timeout", "pd server timeout", "region is unavailable", "failed to connect to all addresses"),
    "application_warning": ("exception", "liveness probe failed", "readiness probe failed", "error"),
}


def log_level(template: Column, levels: dict[str, tuple[str, ...]] = LOG_LEVELS) -> Column:
    text = F.lower(template)
    out = None
    for level, words in levels.items():
        hit = reduce(lambda a, b: a | b, [text.contains(w) for w in words])
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out.otherwise("unknown")


# Reasons by pattern, the first that is found counts.
REASONS = (
    ("error|exception|panic|fail|timeout", "Application Error"),
    ("jvm|memory|oom", "Service JVM Issue"),
    ("i/o|disk|storage|io", "Node Disk I/O Consumption High"),
    ("database|tidb|qps|sql", "Database Error"),
    ("config", "Configuration Error"),
    ("code", "Code Error"),
    ("network|latency|rrt", "Pod Network Latency"),
)


def standard_reason(text: Column, reasons: tuple[tuple[str, str], ...] = REASONS) -> Column:
    out = F.when(F.lower(text).rlike(reasons[0][0]), reasons[0][1])
    for pattern, name in reasons[1:]:
        out = out.when(F.lower(text).rlike(pattern), name)
    return out.otherwise(F.trim(F.substring_index(F.substring_index(text, ":", 1), ".", 1)))


# What is taken out of a message, in this order.
TEMPLATE_STEPS = (
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[.,]\d+Z?", ""),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", " <IP> "),
    (r"\b[0-9a-fA-F]{8,}\b", " <HASH> "),
    (r"\b\d+\b", " <NUM> "),
    (r"https?://\S+", " <URL> "),
    (r"\s+", " "),
)


def plain_template(message: Column) -> Column:
    """A message without its times, addresses, hashes, numbers and URLs; 120 characters at most."""
    for pattern, new in TEMPLATE_STEPS:
        message = F.regexp_replace(message, pattern, new)
    return F.substring(F.trim(message), 1, 120)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def log_template(message: Column, depth: int = 3) -> Column:
    """JSON objects: the template of their text `message`, else their sorted keys; other messages: plain_template. Null: a constant. A message is parsed once."""

    def of_object(o: Column) -> Column:
        inner = F.try_element_at(o, F.lit("message"))
        is_text = F.coalesce(F.schema_of_variant(inner) == "STRING", F.lit(False))
        text = F.try_variant_get(inner, "$", "string")
        nested = log_template(text, depth - 1) if depth > 1 else plain_template(text)
        return F.when(o.isNull(), plain_template(message)).when(is_text, nested).otherwise(F.array_join(F.array_sort(F.map_keys(o)), "_"))

    return F.when(message.isNull(), "non-string log message").otherwise(_once(F.try_variant_get(F.try_parse_json(message), "$", "map<string,variant>"), of_object))
