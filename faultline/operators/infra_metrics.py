"""Infrastructure and database metrics: identity, categories, rules and patterns over several components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.expressions import departs, falls, near_zero, rises, spike, usable, usage_severity
from faultline.plans.windows import WindowSpec

# Metrics by component type and category.
INFRA_CATEGORIES = {
    "node": {
        "cpu": ("node_cpu_usage_rate",),
        "memory": ("node_memory_usage_rate", "node_memory_MemAvailable_bytes", "node_memory_MemTotal_bytes"),
        "disk": ("node_disk_read_bytes_total", "node_disk_written_bytes_total", "node_disk_read_time_seconds_total", "node_disk_write_time_seconds_total", "node_filesystem_free_bytes", "node_filesystem_size_bytes", "node_filesystem_usage_rate"),
        "network": ("node_network_receive_bytes_total", "node_network_transmit_bytes_total", "node_network_receive_packets_total", "node_network_transmit_packets_total", "node_sockstat_TCP_inuse"),
    },
    "pod": {
        "cpu": ("pod_cpu_usage",),
        "memory": ("pod_memory_working_set_bytes",),
        "disk": ("pod_fs_reads_bytes_total", "pod_fs_writes_bytes_total"),
        "network": ("pod_network_receive_bytes_total", "pod_network_transmit_bytes_total", "pod_network_receive_packets_total", "pod_network_transmit_packets_total"),
        "process": ("pod_processes",),
    },
}
DATABASE_CATEGORIES = {
    "tidb": {
        "latency": ("duration_99th", "duration_95th", "duration_avg", "slow_query"),
        "throughput": ("qps", "failed_query_ops"),
        "resource": ("cpu_usage", "memory_usage"),
        "internal": ("connection_count", "block_cache_size", "transaction_retry", "top_sql_cpu"),
        "health": ("server_is_up", "uptime"),
    },
    "tikv": {
        "latency": ("raft_propose_wait", "raft_apply_wait", "grpc_qps"),
        "storage_io": ("read_mbps", "write_wal_mbps", "io_util"),
        "resource": ("cpu_usage", "memory_usage", "threadpool_readpool_cpu"),
        "raft_state": ("region_pending", "snapshot_apply_count"),
        "storage_engine": ("rocksdb_write_stall",),
        "storage_capacity": ("store_size", "available_size", "capacity_size"),
        "health": ("server_is_up",),
    },
    "pd": {
        "cluster_state": ("store_up_count", "store_down_count", "store_unhealth_count", "store_low_space_count", "store_slow_count", "witness_count"),
        "region_state": ("abnormal_region_count", "region_health", "region_count", "leader_count", "learner_count"),
        "storage": ("storage_capacity", "storage_size", "storage_used_ratio"),
        "resource": ("cpu_usage", "memory_usage"),
        "health": ("leader_primary",),
    },
}
ZERO_TOLERANCE = ("rocksdb_write_stall", "store_down_count", "store_unhealth_count", "store_slow_count", "transaction_retry", "server_is_up")
BENIGN_REGIONS = ("miss-peer-region-count", "pending-peer-region-count", "learner-peer-region-count")
DATABASE_SPIKY = ("qps", "failed_query_ops_per_second", "cpu_usage", "connection_count", "transaction_retry_per_second", "top_sql_cpu", "slow_query_per_second", "raft_propose_wait", "raft_apply_wait", "grpc_qps", "read_mbps", "write_wal_mbps", "io_util", "threadpool_readpool_cpu", "region_pending", "snapshot_apply_count_per_second")
FORBIDDEN = ("tidb", "tikv", "pd")


# Metrics that are judged by their peaks.
INFRA_SPIKY = (
    "node_cpu_usage_rate",
    "pod_cpu_usage",
    "node_disk_read_bytes_per_second",
    "node_disk_written_bytes_per_second",
    "node_disk_read_time_seconds_per_second",
    "node_disk_write_time_seconds_per_second",
    "node_network_receive_bytes_per_second",
    "node_network_transmit_bytes_per_second",
    "node_network_receive_packets_per_second",
    "node_network_transmit_packets_per_second",
    "pod_fs_reads_bytes_per_second",
    "pod_fs_writes_bytes_per_second",
    "pod_network_receive_bytes_per_second",
    "pod_network_transmit_bytes_per_second",
    "pod_network_receive_packets_per_second",
    "pod_network_transmit_packets_per_second",
)


def rate_name(metric: Column) -> Column:
    return F.regexp_replace(metric, "_total$", "_per_second")


def categories(spark: SparkSession, table: dict[str, dict[str, tuple[str, ...]]], compat: bool = False) -> DataFrame:
    """(component_type, kpi_key, category); a counter also under its rate's name, unless compat."""
    rows = [(t, m, c) for t, kinds in table.items() for c, metrics in kinds.items() for m in metrics]
    if not compat:
        rows += [(t, m.replace("_total", "_per_second"), c) for t, m, c in rows if m.endswith("_total")]
    return spark.createDataFrame(rows, "component_type string, kpi_key string, category string")


def forbidden(components: list[str] | None) -> list[str]:
    return sorted(set(components or ()) & set(FORBIDDEN))


def kpi_of_file(name: Column, prefixes: tuple[str, ...] = ("infra_pod_", "infra_node_", "infra_tidb_", "infra_tikv_", "infra_pd_")) -> Column:
    bare = F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), r"_?[0-9]{4}-[0-9]{2}-[0-9]{2}$", "")
    return F.regexp_replace(bare, "^(" + "|".join(prefixes) + ")", "")


def type_of_file(name: Column) -> Column:
    return F.regexp_extract(name, "^infra_(pod|node|tidb|tikv|pd)_", 1)


def component_id(pod: Column, node: Column, instance: Column) -> Column:
    return F.coalesce(usable(pod), usable(node), instance)


def node_fields(instance: Column, node: Column, pod_ip: Column | None = None) -> tuple[Column, Column]:
    """(ip_address, kubernetes_node) filled from the instance."""
    host = F.substring_index(instance, ":", 1)
    return (F.coalesce(pod_ip, host) if pod_ip is not None else host), F.coalesce(F.when(node != "null", node), instance)


def database_identity(df: DataFrame) -> DataFrame:
    """Cleans instance, pod, kubernetes_node and type; adds related_node. Columns that are missing count as null."""
    for c in ("instance", "pod", "kubernetes_node", "type"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    clean = df.withColumns({c: F.when(F.col(c) != "null", F.col(c)) for c in ("instance", "pod", "kubernetes_node")})
    clean = clean.withColumn("instance", F.when((F.col("kpi_key") == "io_util") & F.col("kubernetes_node").isNotNull(), F.col("kubernetes_node")).otherwise(F.col("instance")))
    return clean.withColumn("related_node", F.coalesce("kubernetes_node", "instance", "pod")).withColumns({"pod": F.coalesce("pod", F.lit("N/A_cluster_level")), "type": F.coalesce("type", F.lit("N/A"))})


def infra_anomalies(compared: DataFrame, category_table: DataFrame, key: str = "kpi_key", type_col: str = "component_type") -> DataFrame:
    """compared with category, severity and kind (spike, increase, decrease) of what stands out."""
    now, base, std, p99, top = (F.col(c) for c in ("anomaly_value", "baseline_value", "baseline_std", "baseline_p99", "anomaly_max"))
    m = F.col(key)
    spiky = m.isin(*INFRA_SPIKY)
    hit = spiky & spike(top, p99, std, (top > 0.01) | (m == "pod_cpu_usage"))
    up, down = ~spiky & rises(now, base, std), ~spiky & falls(now, base, std)
    kind = F.when(hit, "spike").when(up, "increase").when(down, "decrease")
    usage = m.contains("usage_rate")
    severity = (
        F.when(hit & usage, usage_severity(top, "major"))
        .when(hit & (m == "pod_cpu_usage") & (top > 1.0), "critical")
        .when(hit, "major")
        .when(up & usage, usage_severity(now, "minor"))
        .when(up & (F.col("change_percentage") > 200), "major")
        .when(up, "minor")
        .when(down, "major")
    )
    named = category_table.withColumnsRenamed({"component_type": type_col, "kpi_key": key})
    return compared.join(F.broadcast(named), [type_col, key]).withColumns({"kind": kind, "severity": severity}).where("kind is not null")


def database_anomalies(compared: DataFrame, category_table: DataFrame, key: str = "kpi_key", type_col: str = "component_type") -> DataFrame:
    """As infra_anomalies, with the database's own rules; kind names the rule."""
    now, base, std, p99, top, low = (F.col(c) for c in ("anomaly_value", "baseline_value", "baseline_std", "baseline_p99", "anomaly_max", "anomaly_min"))
    m = F.col(key)
    clean = F.replace(m, F.lit("_per_second"), F.lit(""))
    zero = clean.isin(*ZERO_TOLERANCE)
    reset = (m == "uptime") & (low < base) & ~near_zero(base)
    alert = (m != "uptime") & zero & (((clean == "server_is_up") & (top < 1) & (base >= 1)) | ((clean != "server_is_up") & (top > 0)))
    region = ~zero & (m == "abnormal_region_count") & (top > 0)
    hit = ~zero & m.isin(*DATABASE_SPIKY) & spike(top, p99, std, top > 0.01)
    rule = F.when(reset, "reset").when(alert, "zero_tolerance").when(region, "region").when(hit, "spike").when(departs(now, base, std), "departure")
    severity = (
        F.when(reset, "major")
        .when(alert, "critical")
        .when(region, F.when(F.col("type").isin(*BENIGN_REGIONS), "minor").otherwise("major"))
        .when(hit & (m.contains("usage") | m.contains("util")) & (top > 0.9), "critical")
        .otherwise("major")
    )
    named = category_table.withColumnRenamed("component_type", type_col).withColumnRenamed("kpi_key", "metric_name")
    return compared.withColumn("metric_name", clean).join(F.broadcast(named), [type_col, "metric_name"]).withColumns({"kind": rule, "severity": severity}).where("kind is not null")


def io_bottlenecks(found: DataFrame, group: list[str], metric: str = "metric_name", value: str = "anomaly_max") -> DataFrame:
    """Components whose findings show disk utilisation over 0.8 and log application waits over 0.1 together."""
    of = lambda name: F.max(F.when(F.col(metric) == name, F.col(value)))
    return found.groupBy(*group).agg(of("io_util").alias("io_util"), of("raft_apply_wait").alias("apply_wait")).where("io_util > 0.8 and apply_wait > 0.1").withColumn("severity", F.lit("critical"))


def noisy_neighbours(found: DataFrame, node_maxima: DataFrame, saturation: float = 0.9) -> DataFrame:
    """(node, n_pods): nodes with several pods that have cpu or memory findings, and saturated themselves. node_maxima: (node, maximum); a maximum over 1.1 is a percent."""
    pods = found.where(F.col("category").isin("cpu", "memory")).groupBy("node").agg(F.countDistinct("pod").alias("n_pods")).where("n_pods > 1")
    share = F.when(F.col("maximum") > 1.1, F.col("maximum") / 100).otherwise(F.col("maximum"))
    full = node_maxima.groupBy("node").agg(F.max(share).alias("saturation")).where(F.col("saturation") > saturation)
    return pods.join(full, "node").select("node", "n_pods", "saturation")


def io_saturation(long: DataFrame, metrics: list[str], node: str = "node", limit: float = 0.8) -> DataFrame:
    return long.where(F.col("kpi_key").isin(metrics)).groupBy(node).agg(F.max("value").alias("io_time")).where(F.col("io_time") >= limit)


def missing_components(requested: DataFrame, found: DataFrame, name: str) -> DataFrame:
    return requested.select(name).distinct().join(found.select(name), name, "left_anti")


def component_type(component: Column, object_type: Column) -> Column:
    """pod or node as given; else by the names of nodes."""
    given = F.lower(object_type)
    return F.when(given.isin("pod", "node"), given).when(F.lower(component).contains("aiops-k8s") | F.lower(component).contains("k8s-master"), "node").otherwise("pod")


def instance_nodes(df: DataFrame) -> DataFrame:
    """(instance, kubernetes_node): a node for each instance, of several the smallest."""
    known = df.where(usable(F.col("instance")).isNotNull() & usable(F.col("kubernetes_node")).isNotNull())
    return known.groupBy("instance").agg(F.min("kubernetes_node").alias("kubernetes_node"))


def component_info(long: DataFrame, spec: WindowSpec, time: str = "time", kind: str = "timestamp") -> DataFrame:
    """(component_id, ip_address, kubernetes_node) from each component's first row in the anomaly window."""
    own = F.struct("ip_address", "kubernetes_node")
    rows = long.where(spec.in_anomaly(time, kind) & F.col("component_id").isNotNull())
    return rows.groupBy("component_id").agg(F.min_by(own, F.struct(F.col(time), own)).alias("o")).select("component_id", "o.*")


def first_component_column(df: DataFrame, columns: tuple[str, ...] = ("component_id", "pod", "instance", "kubernetes_node", "object_id", "node")) -> Column:
    """The first of the columns that the table has and that is not null in the row."""
    return F.coalesce(*[F.col(c) for c in columns if c in df.columns], F.lit(None).cast("string"))


def name_parts(mine: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """(key, part) for each distinct name of `mine`: `both` if the others have it as well, else `mine`. One exchange, and names are made distinct before it; null is a name."""
    told = mine.select(key, F.lit(True).alias("__mine"), F.lit(False).alias("__others")).unionByName(others.select(key, F.lit(False).alias("__mine"), F.lit(True).alias("__others")))
    met = told.groupBy(key).agg(F.bool_or("__mine").alias("__mine"), F.bool_or("__others").alias("__others")).where("__mine")
    return met.select(key, F.when(F.col("__others"), "both").otherwise("mine").alias("part"))
