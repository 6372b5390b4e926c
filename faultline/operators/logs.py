"""Logs: keyword filter, templates, activity against the baseline, patterns of components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.functions.expressions import log_level, usable
from faultline.plans.windows import WindowSpec, in_windows

# The default keywords.
KEYWORDS = ("error", "exception", "failed", "timeout", "refused", "unavailable", "critical", "panic", "fatal", "traceback", "deadlock", "corrupt", "denied")


def has_keyword(message: Column, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """Keywords are regular expressions, in any case; null has none."""
    return F.coalesce(message.rlike("(?i)(" + "|".join(keywords) + ")"), F.lit(False))


def of_components(logs: DataFrame, components: list[str] | None) -> DataFrame:
    return logs.where(F.col("pod").isin(components) | F.col("node").isin(components)) if components else logs


def _states(counts: DataFrame, keys: list[str], minutes: Column, silent_too: bool) -> DataFrame:
    """(keys, rate, mean, std, state) from the lines of each minute in the baseline (b) and in the anomaly window (a)."""
    per_minute = F.when(F.col("b") > 0, F.col("b")).cast("double")
    stats = counts.groupBy(*keys).agg(
        (F.sum("a") / minutes).alias("rate"),
        F.coalesce(F.avg(per_minute), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_samp(per_minute), F.lit(0.0)).alias("std"),
    )
    surge = (F.col("rate") > F.col("mean") + 3 * F.greatest("std", F.lit(0.1))) & (F.col("rate") > 5)
    state = F.when(surge, "surge").when((F.col("mean") < 1) & (F.col("rate") > 10), "wakes").when((F.col("mean") > 5) & (F.col("rate") < 1), "falls_silent")
    return (stats if silent_too else stats.where("rate > 0")).withColumn("state", state)


def activity(logs: DataFrame, spec: WindowSpec, component: str = "component", time: str = "time", kind: str = "timestamp_ntz", silent_too: bool = True) -> DataFrame:
    """(component, rate, mean, std, state): lines a minute against the baseline's minutes that have lines.

    silent_too: components without a line in the anomaly window have the rate 0; else they are left out. Two levels of counts, one shuffle by component and minute and one by component.
    """
    base, anomaly = spec.in_baseline(time, kind), spec.in_anomaly(time, kind)
    minute = F.date_trunc("minute", F.col(time))
    counts = logs.where((base | anomaly) & F.col(component).isNotNull()).groupBy(component, minute.alias("minute")).agg(F.count_if(base).alias("b"), F.count_if(anomaly).alias("a"))
    return _states(counts, [component], F.lit(spec.minutes), silent_too)


def activity_windows(logs: DataFrame, windows: DataFrame, ids: list[str], component: str = "component", time: str = "time", silent_too: bool = True) -> DataFrame:
    """activity() for every window of a table (see windows.log_table) by one scan; ids: the columns that name a window."""
    met = in_windows(logs.where(F.col(component).isNotNull()), windows, time)
    minutes = (F.unix_micros(F.col("window.end").cast("timestamp")) - F.unix_micros(F.col("window.start").cast("timestamp"))) / 60e6
    minute = F.date_trunc("minute", F.col(time))
    counts = met.groupBy(*[F.col(f"window.`{i}`").alias(i) for i in ids], component, minute.alias("minute")).agg(F.count_if("__base").alias("b"), F.count_if("__anomaly").alias("a"), F.any_value(minutes).alias("minutes"))
    return _states(counts, [*ids, component], F.max("minutes"), silent_too)


def error_patterns(logs: DataFrame, template: Column, pod: str = "pod", node: str = "node", time: str = "time", message: str = "message") -> DataFrame:
    """(pod, template, count, first_time, node, details): node and message of the earliest line that has one (ties: the smallest)."""
    known = logs.withColumn("template", template).where(F.col(pod).isNotNull())
    clean = usable(F.col(node))
    return known.groupBy(pod, "template").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(time).alias("first_time"),
        F.coalesce(F.min(F.when(clean.isNotNull(), F.struct(F.col(time), clean.alias("n"))))["n"], F.lit("N/A")).alias("node"),
        F.min(F.struct(F.col(time), F.col(message).alias("m")))["m"].alias("details"),
    )


def component_rollup(patterns: DataFrame, pod: str = "pod", limit: int = 10) -> DataFrame:
    """The `limit` components with most lines: total, node, patterns (most frequent first), the top one with its details, its level, and the first time."""
    pattern = F.struct("count", "first_time", "template", "details")
    top = F.max_by(pattern, F.struct("count", "first_time", "template"))
    rolled = patterns.groupBy(pod).agg(
        F.sum("count").alias("total"),
        F.count(F.lit(1)).alias("n_patterns"),
        F.min_by("node", "template").alias("node"),
        top.alias("top"),
        F.min("first_time").alias("first_time"),
        F.sort_array(F.collect_list(pattern), asc=False).alias("patterns"),  # a row for each template of a component
    )
    rolled = rolled.select(pod, "total", "n_patterns", "node", F.col("top.template").alias("top_template"), F.col("top.count").alias("top_count"), F.col("top.details").alias("top_details"), "first_time", "patterns")
    return rolled.withColumns({"level": log_level(F.col("top_template")), "storm": F.col("total") > 100}).orderBy(F.desc("total"), pod).limit(limit)


def contextual(logs: DataFrame, template: Column, states: DataFrame, pod: str = "pod", limit: int = 5) -> DataFrame:
    """(pod, node, total, patterns, state): what the `limit` busiest components log where no line tells of an error, with their activity (pod, state) against the baseline."""
    mix = pattern_mix(logs, template, pod)
    one = F.struct("rank", "template", "count", "percentage", "first_time", "last_time")
    listed = mix.groupBy(pod).agg(F.sort_array(F.collect_list(one)).alias("patterns"))
    totals = logs.where(F.col(pod).isNotNull()).groupBy(pod).agg(F.count(F.lit(1)).alias("total"))
    busiest = totals.orderBy(F.desc("total"), pod).limit(limit)
    met = F.broadcast(busiest).join(listed, pod).join(usual_node(logs, pod), pod, "left").join(states.select(pod, "state"), pod, "left")  # `limit` rows
    return met.select(pod, F.coalesce("node", F.lit("N/A")).alias("node"), "total", "patterns", "state").orderBy(F.desc("total"), pod)


def pattern_mix(logs: DataFrame, template: Column, pod: str = "pod", time: str = "time", top: int = 3) -> DataFrame:
    """(pod, template, count, percentage, rank, first_time, last_time): each pod's most frequent templates."""
    counts = logs.where(F.col(pod).isNotNull()).groupBy(pod, template.alias("template")).agg(F.count(F.lit(1)).alias("count"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    w = W.partitionBy(pod)
    return counts.withColumn("percentage", F.col("count") * 100.0 / F.sum("count").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("count"), "template"))).where(F.col("rank") <= top)


def usual_node(logs: DataFrame, pod: str = "pod", node: str = "node") -> DataFrame:
    """(pod, node): the commonest node, of equals the smallest."""
    return logs.where(usable(F.col(node)).isNotNull()).groupBy(pod).agg(F.mode(node, True).alias("node"))


def structured_info(message: Column) -> list[Column]:
    """Address and port, gRPC code and text, trace and span id of a message, and of a JSON object the value under the last key with `error` and those under keys with `trace` or `span`; null where absent."""
    found = lambda p, g=1: F.when(F.regexp_extract(message, p, g) != "", F.regexp_extract(message, p, g))
    # The forms of addresses and of gRPC errors.
    address = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}):(\d+)"
    rpc = r"(?i)code = (\w+)\s+desc = (.*?)(?:\s*,|\"\}|\"$)"
    fields = F.from_json(message, "map<string,string>")
    named = lambda *words: F.map_filter(fields, lambda k, v: reduce(lambda a, b: a | b, [F.lower(k).contains(w) for w in words]))
    errors, ids = F.map_values(named("error")), named("trace", "span")
    return [
        found(address).alias("target_ip"),
        found(address, 2).alias("target_port"),
        found(rpc).alias("grpc_code"),
        found(rpc, 2).alias("grpc_description"),
        found(r"traceID=(\w+)").alias("trace_id"),
        found(r"spanID=(\w+)").alias("span_id"),
        F.when(F.size(errors) > 0, F.element_at(errors, -1)).alias("error_message"),
        F.when(F.size(ids) > 0, F.to_json(ids)).alias("trace_fields"),
    ]
