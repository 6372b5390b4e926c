"""Readers of a telemetry lake: <root>/<local date>/<kind>/<file>, with entity, metric, date and hour in file names.

Files are chosen by the local (UTC+8) dates or hours that a UTC window spans, listed through
Spark's own file system, so any store that Spark reads will do. Rows are then filtered by time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators.infra_metrics import component_id, database_identity, kpi_of_file, node_fields, type_of_file
from faultline.operators.service_metrics import wide_to_long
from faultline.operators.traces import export_rows

LOCAL = timedelta(hours=8)

# Where files of each kind lie under a date folder.
SERVICE_PATTERNS = ("metric-parquet/apm/pod/pod_*.parquet", "metric-parquet/apm/service/service_*.parquet", "metric-parquet/apm/pod_ns_hipstershop_*.parquet")
INFRA_PATTERNS = ("metric-parquet/infra/infra_node/*.parquet", "metric-parquet/infra/infra_pod/*.parquet")
DATABASE_PATTERNS = {"tidb": "metric-parquet/infra/infra_tidb/infra_tidb_*.parquet", "tikv": "metric-parquet/other/infra_tikv_*.parquet", "pd": "metric-parquet/other/infra_pd_*.parquet"}

TAG = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]))
SPAN = T.StructType(
    [
        T.StructField("traceID", T.StringType()),
        T.StructField("spanID", T.StringType()),
        T.StructField("flags", T.DoubleType()),
        T.StructField("operationName", T.StringType()),
        T.StructField("references", T.ArrayType(T.StructType([T.StructField("refType", T.StringType()), T.StructField("spanID", T.StringType())]))),
        T.StructField("startTime", T.LongType()),
        T.StructField("startTimeMillis", T.LongType()),
        T.StructField("duration", T.LongType()),
        T.StructField("tags", TAG),
        T.StructField("logs", T.ArrayType(T.StructType([T.StructField("fields", TAG), T.StructField("timestamp", T.LongType())]))),
        T.StructField("process", T.StructType([T.StructField("serviceName", T.StringType()), T.StructField("tags", TAG)])),
    ]
)

# The columns that analyses of each kind of file need; metric files of infrastructure and databases need all they have.
COLUMNS = {
    "service": ("time", "error", "error_ratio", "object_id", "object_type", "server_error", "server_error_ratio", "client_error", "client_error_ratio", "request", "response", "rrt", "rrt_max", "timeout"),
    "logs": ("k8_namespace", "@timestamp", "k8_pod", "message", "k8_node_name", "agent_name", "log_level"),
    "spans": ("traceID", "spanID", "operationName", "startTime", "startTimeMillis", "duration", "process", "tags", "references", "logs"),
}


def relevant(df: DataFrame, kind: str) -> DataFrame:
    """Those of the kind's COLUMNS that df has, in their order (scans read no others); all of them for a kind without a list."""
    return df.select(*[F.col(f"`{c}`") for c in COLUMNS[kind] if c in df.columns]) if kind in COLUMNS else df


def local_dates(start: datetime, end: datetime) -> list[str]:
    first, last = (start + LOCAL).date(), (end + LOCAL).date()
    return [str(first + timedelta(days=i)) for i in range((last - first).days + 1)]


def local_hours(start: datetime, end: datetime) -> list[tuple[str, str]]:
    """(date, hour) of each local hour."""
    at = (start + LOCAL).replace(minute=0, second=0, microsecond=0)
    out = []
    while at <= end + LOCAL:
        out.append((at.strftime("%Y-%m-%d"), at.strftime("%H")))
        at += timedelta(hours=1)
    return out


def existing(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Files that match the globs, in order; none for a folder that is not there."""
    found = set()
    for pattern in patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or ():
            found.add(status.getPath().toString())
    return sorted(found)


def service_files(spark: SparkSession, root: str, start: datetime, end: datetime) -> list[str]:
    return existing(spark, [f"{root}/{d}/{p}" for d in local_dates(start, end) for p in SERVICE_PATTERNS])


def infra_files(spark: SparkSession, root: str, start: datetime, end: datetime) -> list[str]:
    return existing(spark, [f"{root}/{d}/{p}" for d in local_dates(start, end) for p in INFRA_PATTERNS])


def database_files(spark: SparkSession, root: str, start: datetime, end: datetime, components: list[str] | None = None) -> list[str]:
    return existing(spark, [f"{root}/{d}/{DATABASE_PATTERNS[c]}" for d in local_dates(start, end) for c in components or DATABASE_PATTERNS])


def log_files(spark: SparkSession, root: str, start: datetime, end: datetime) -> list[str]:
    return existing(spark, [f"{root}/{d}/log-parquet/*_{d}_{h}-*.parquet" for d, h in local_hours(start, end)])


def trace_files(spark: SparkSession, root: str, start: datetime, end: datetime) -> list[str]:
    return existing(spark, [f"{root}/{d}/trace-parquet/trace_jaeger-span_{d}_{h}-*.parquet" for d, h in local_hours(start, end)])


def as_utc(df: DataFrame, column: str) -> DataFrame:
    """The time column as a UTC timestamp: text by ISO form, integers as micro- or (if named Millis) milliseconds."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        return df.withColumn(column, F.try_to_timestamp(c))
    if isinstance(kind, T.NumericType):
        return df.withColumn(column, F.timestamp_millis(c.cast("long")) if "Millis" in column else F.timestamp_micros(c.cast("long")))
    return df.withColumn(column, c.cast("timestamp"))


def in_time(df: DataFrame, column: str, start: datetime, end: datetime) -> DataFrame:
    """Closed on both sides. The bounds are put in the column's own type, so that the scan can use them."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.NumericType):
        unit = 1_000 if "Millis" in column else 1_000_000
        return as_utc(df.where(c.between(int(start.timestamp() * unit), int(end.timestamp() * unit))), column)
    if isinstance(kind, T.TimestampNTZType):
        low, high = (F.lit(x.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz") for x in (start, end))
        return as_utc(df.where(c.between(low, high)), column)
    if isinstance(kind, T.StringType):
        # ISO text sorts as its times do but for the zone, so a day's margin on both sides is safe, and the scan can use it
        df = df.where(c.between(str((start - timedelta(days=1)).date()), str((end + timedelta(days=2)).date())))
    return as_utc(df, column).where(c.between(F.lit(start), F.lit(end)))


def read_files(spark: SparkSession, files: list[str], schema: T.StructType | None = None) -> DataFrame | None:
    """Rows of the files that can be read; skipped_files names the others."""
    if not files:
        return None
    reader = spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true")
    return (reader.schema(schema) if schema else reader).parquet(*files).withColumn("source_file", F.col("_metadata.file_name"))


def skipped_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, bytes, reason): the Parquet files among these that read_files leaves out, and why.

    Tasks read each file whole (at most 2 GB, Spark's bound for a binary value), its footer and every row group. Empty for no files.
    """
    if not files:
        return spark.createDataFrame([], "file string, bytes long, reason string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reasons = [unreadable(c) for c in b.column("content")]
            bad = pa.array([r is not None for r in reasons])
            yield pa.record_batch([b.column("path").filter(bad), b.column("length").filter(bad), pa.array(reasons, pa.string()).filter(bad)], ["file", "bytes", "reason"])

    schema = "file string, bytes long, reason string"
    empty = []  # Spark's readers pass over files without a byte, so the listing tells of them
    for f in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if status.isFile() and not status.getLen() and name.endswith(".parquet"):
                empty.append((status.getPath().toString(), 0, "no bytes"))
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(files).select("path", "length", "content").mapInArrow(run, schema)
    return read.unionByName(spark.createDataFrame(empty, schema))


def unreadable(content: pa.BinaryScalar) -> str | None:
    """Why a file's bytes are no whole Parquet file; null if they are one."""
    try:
        held = pq.ParquetFile(pa.BufferReader(content.as_buffer()))
        for i in range(held.num_row_groups):
            held.read_row_group(i)
    except (pa.ArrowException, OSError, ValueError) as e:
        return f"{type(e).__name__}: {str(e)[:200]}"
    return None


def service_metrics(spark: SparkSession, root: str, start: datetime, end: datetime) -> DataFrame | None:
    """Service and pod metrics in long form; files without a time, or without the columns that name an object, give no row."""
    wide = read_files(spark, service_files(spark, root, start, end))
    if wide is None:
        return None
    return wide_to_long(in_time(wide, "time", start, end) if "time" in wide.columns else wide)


def tall_metrics(spark: SparkSession, files: list[str], start: datetime, end: datetime, value_column: bool = True) -> DataFrame | None:
    """Files of one metric each: the column named after the metric (or `value`) becomes value; kpi_key and component_type come from the file's name.

    One scan reads all metrics, as a column that a file lacks is null in its rows. Files without a column for their metric give no row. Where a column's type differs
    from metric to metric, each type of files is read on its own. None if no file has its column.
    """
    named = spark.createDataFrame([(f, f.rsplit("/", 1)[-1]) for f in files], "f string, n string") if files else None
    kpis: dict[str, list[str]] = {}
    for r in named.select("f", kpi_of_file(F.col("n")).alias("kpi")).collect() if files else ():
        kpis.setdefault(r["kpi"], []).append(r["f"])
    try:
        parts = [_tall(read_files(spark, files), kpis, start, end, value_column)] if files else []
    except Py4JJavaError as e:
        if "CANNOT_MERGE" not in str(e):
            raise
        parts = [_tall(read_files(spark, own), {kpi: own}, start, end, value_column) for kpi, own in sorted(kpis.items())]
    found = [p for p in parts if p is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None


def _tall(df: DataFrame, kpis: Iterable[str], start: datetime, end: datetime, value_column: bool) -> DataFrame | None:
    own = [k for k in sorted(kpis) if k in df.columns]
    plain = sorted(set(kpis) - set(own)) if value_column and "value" in df.columns else []
    if not own and not plain:
        return None
    # a metric's table may be a folder of files, whose name counts then
    name = F.regexp_extract("source_path", "/(infra_[^/]*[.]parquet)(/[^/]*)?$", 1)
    kpi = F.col("kpi_key")
    value = reduce(lambda w, k: w.when(kpi == k, F.expr(f"try_cast(`{k}` AS double)")), own, F)
    value = (value.otherwise(F.expr("try_cast(`value` AS double)")) if own else F.expr("try_cast(`value` AS double)")) if plain else value
    timed = in_time(df.withColumn("source_path", F.col("_metadata.file_path")), "time", start, end).withColumns({"kpi_key": kpi_of_file(name), "component_type": type_of_file(name)})
    return timed.where(kpi.isin([*own, *plain])).withColumn("value", value).drop("source_path", *[k for k in own if k != "value"])


def infra_metrics(spark: SparkSession, root: str, start: datetime, end: datetime) -> DataFrame | None:
    df = tall_metrics(spark, infra_files(spark, root, start, end), start, end)
    if df is None:
        return None
    for c in ("pod", "kubernetes_node", "instance"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    ip, node = node_fields(F.col("instance"), F.col("kubernetes_node"), F.col("pod_ip") if "pod_ip" in df.columns else None)
    return df.withColumn("component_id", component_id(F.col("pod"), F.col("kubernetes_node"), F.col("instance"))).withColumns({"ip_address": ip, "kubernetes_node": node}).dropna(subset=["time", "value", "component_id"])


def database_metrics(spark: SparkSession, root: str, start: datetime, end: datetime, components: list[str] | None = None) -> DataFrame | None:
    df = tall_metrics(spark, database_files(spark, root, start, end, components), start, end, value_column=False)
    return database_identity(df.withColumn("value", F.coalesce("value", F.lit(0.0)))) if df is not None else None


def logs(spark: SparkSession, root: str, start: datetime, end: datetime) -> DataFrame | None:
    """Log lines with time, pod, node and message; files that have `body` for the text, or for some lines, are read alike."""
    df = read_files(spark, log_files(spark, root, start, end))
    if df is None:
        return None
    texts = [c for c in ("message", "body") if c in df.columns]
    if "body" in texts:
        df = df.withColumn("message", F.coalesce(*texts)).drop("body")
    return in_time(df, "@timestamp", start, end).withColumnsRenamed({"@timestamp": "time", "k8_pod": "pod", "k8_node_name": "node"})


def spans(spark: SparkSession, root: str, start: datetime, end: datetime) -> DataFrame | None:
    df = read_files(spark, trace_files(spark, root, start, end), SPAN)
    if df is None:
        return None
    low, high = (int(x.timestamp() * 1_000_000) for x in (start, end))
    return df.where(F.col("startTime").between(low, high))


def cases(spark: SparkSession, path: str) -> list[dict]:
    """Incident cases of a JSON list: uuid and description."""
    return [{"uuid": r["uuid"], "description": r["Anomaly Description"]} for r in spark.read.option("multiLine", "true").json(path).select("uuid", "Anomaly Description").collect()]


def chart_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file's rows as JSON records; nulls are kept."""
    df = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def export_traces(spark: SparkSession, root: str, start: datetime, end: datetime, path: str) -> DataFrame | None:
    """Flattened spans as CSV, a folder for each file they came from; returns what was written."""
    df = spans(spark, root, start, end)
    if df is None:
        return None
    rows = export_rows(df, "source_file")
    rows.write.mode("overwrite").partitionBy("source_file").option("header", "true").csv(path)
    return rows


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
