"""Service metrics: rules on errors, timeouts and latency; failures of whole services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.functions.expressions import is_pod, service_of, severity_rank, spike
from faultline.operators.compare import compare, grouped
from faultline.plans.windows import WindowSpec

# Metric columns of a wide row, and names that are not components.
METRICS = ("request", "response", "rrt", "rrt_max", "error", "client_error", "server_error", "timeout", "error_ratio", "client_error_ratio", "server_error_ratio")
NOT_COMPONENTS = ("hipstershop",)
IDS = ("time", "object_id", "object_type")
KEYS = ["object_id", "object_type", "metric"]


def wide_to_long(wide: DataFrame, ids: tuple[str, ...] = IDS, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(ids, metric, value): the metrics that the table has; text that is no number, and null, is 0."""
    have = [m for m in metrics if m in wide.columns]
    if not have or any(i not in wide.columns for i in ids):
        return wide.sparkSession.createDataFrame([], "time timestamp, object_id string, object_type string, metric string, value double")
    numbers = wide.select(*ids, *[F.coalesce(F.expr(f"try_cast(`{m}` AS double)"), F.lit(0.0)).alias(m) for m in have])
    return numbers.unpivot(list(ids), have, "metric", "value")


def anomalies(long: DataFrame, spec: WindowSpec, kind: str = "timestamp_ntz", need_baseline: bool = True) -> DataFrame:
    """(object_id, object_type, metric, severity, value, bound, first_time) of what stands out; only error, timeout and rrt are judged."""
    known = long.where(~F.col("object_id").isin(*NOT_COMPONENTS))
    judged = known.where(F.col("metric").isin("error", "timeout", "rrt"))
    # the whole long table tells whether there is a baseline, not the judged metrics alone
    stats = compare(judged, KEYS, spec, kind=kind, first_above={"first_positive": 0.0})
    if need_baseline:
        stats = stats.join(F.broadcast(known.where(spec.in_baseline("time", kind)).limit(1).select(F.lit(1).alias("one"))), F.lit(True), "left_semi")
    top, p99, std = F.col("anomaly_max"), F.col("baseline_p99"), F.col("baseline_std")
    bound = p99 + 2 * std
    events = F.col("metric").isin("error", "timeout")
    is_spike = (F.col("metric") == "rrt") & spike(top, p99, std, top * 1000 > 100)
    of_events = F.when(F.col("anomaly_sum") > 100, "critical").when(F.col("anomaly_sum") > 10, "major").otherwise("minor")
    of_spike = F.when(top > 10, "critical").when((top > 2 * bound) & (top > 1), "major").otherwise("minor")
    found = stats.where((events & (F.col("anomaly_sum") > F.col("baseline_value"))) | is_spike).select(
        *KEYS,
        F.when(events, of_events).otherwise(of_spike).alias("severity"),
        F.when(events, F.col("anomaly_sum")).otherwise(top).alias("value"),
        F.when(events, F.col("baseline_value")).otherwise(bound).alias("bound"),
        "first_positive",
    )
    # a spike's first time is when the rows first pass its own bound
    late = judged.where((F.col("metric") == "rrt") & spec.in_anomaly("time", kind)).join(found.where("metric = 'rrt'").select(*KEYS, "bound"), KEYS).where("value > bound").groupBy(*KEYS).agg(F.min("time").alias("first_spike"))
    return found.join(late, KEYS, "left").withColumn("first_time", F.when(F.col("metric") == "rrt", F.col("first_spike")).otherwise(F.col("first_positive"))).drop("first_spike", "first_positive")


def ranked(found: DataFrame, name: str = "object_id", tie: tuple[str, ...] = ("metric",)) -> DataFrame:
    """With each component's worst severity, and in the order of a report: component by worst, then its findings by severity."""
    w = W.partitionBy(name)
    return found.withColumn("severity_rank", severity_rank(F.col("severity"))).withColumn("component_rank", F.min("severity_rank").over(w)).orderBy("component_rank", name, "severity_rank", *tie)


def widespread_failures(found: DataFrame, name: str = "object_id") -> DataFrame:
    """(service, n_pods): services with more than one anomalous pod."""
    return found.where(is_pod(F.col(name))).groupBy(service_of(F.col(name)).alias("service")).agg(F.countDistinct(name).alias("n_pods")).where("n_pods > 1")


def static_dynamic_anomalies(long: DataFrame, spec: WindowSpec, kind: str = "timestamp_ntz", limits: dict[str, float] | None = None) -> DataFrame:
    """(object_id, object_type, metric, rule, value, bound): fixed limits of the window's maximum, and latency over the baseline's p95 + 2 std."""
    limits = limits or {"error_ratio": 0.01, "server_error_ratio": 0.01, "timeout": 1.0}
    base, anomaly, v = spec.in_baseline("time", kind), spec.in_anomaly("time", kind), F.col("value")
    rows = long.where((base | anomaly) & F.col("metric").isin(*limits, "rrt"))
    stats = grouped(rows, KEYS, [F.max(F.when(anomaly, v)).alias("value"), F.stddev_samp(F.when(base, v)).alias("std")], {"p95": (F.when(base, v), 0.95)})
    fixed = F.lit(None).cast("double")
    for m, x in limits.items():
        fixed = F.when(F.col("metric") == m, F.lit(x)).otherwise(fixed)
    bound = F.when(F.col("metric") == "rrt", F.col("p95") + 2 * F.coalesce("std", F.lit(0.0))).otherwise(fixed)
    return stats.withColumn("bound", bound).where("value > bound").select(*KEYS, F.when(F.col("metric") == "rrt", "dynamic").otherwise("static").alias("rule"), "value", "bound")


def pods_at_service_times(services: DataFrame, pods: DataFrame) -> DataFrame:
    """Pod rows whose name begins with an anomalous service's and which are anomalous at the same time: an equi-join on time and service."""
    return pods.withColumn("service", service_of(F.col("object_id"))).join(services.select(F.col("object_id").alias("service"), "time").distinct(), ["service", "time"], "left_semi")


def slowest(long: DataFrame, k: int, metric: str = "rrt") -> DataFrame:
    """(object_id, top): the k components with the highest value of a metric; ties by name."""
    return long.where(F.col("metric") == metric).groupBy("object_id").agg(F.max("value").alias("top")).orderBy(F.desc("top"), "object_id").limit(k)


def latency_and_errors(long: DataFrame) -> DataFrame:
    """(object_id, p99, errors): the exact 99th percentile of latency (null without latency), and how many rows tell of errors."""
    rrt = F.when(F.col("metric") == "rrt", F.col("value"))
    return grouped(long, ["object_id"], [F.count_if((F.col("metric") == "error") & (F.col("value") > 0)).alias("errors")], {"p99": (rrt, 0.99)}).select("object_id", "p99", "errors")
