"""From findings to an answer: which analyses to run, which finding anchors the incident, what caused it; and batches of cases."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.expressions import is_pod, log_template, service_of, severity_rank
from faultline.operators import infra_metrics as infra
from faultline.operators import logs as log_ops
from faultline.operators import service_metrics as svc
from faultline.operators import traces as tr
from faultline.operators.compare import compare, counter_rates
from faultline.operators.graph import marks_ahead, numbered_graph, sources_behind
from faultline.plans import topology
from faultline.plans.windows import LOG_CONTEXT, WindowSpec, find_loose_range, find_range
from faultline.sources import telemetry
from faultline.sources.scratch import saved


@dataclass
class Result:
    """What an analysis gives: a table of findings, tables that explain them, and a line of text; error if it could not run."""

    name: str
    findings: DataFrame | None = None
    summary: str = ""
    error: str | None = None
    insights: dict[str, DataFrame] = field(default_factory=dict)

    def report(self, limit: int = 10) -> dict:
        """The findings as nested values: the first `limit` components in their order, each with its findings, and each insight's first `limit` rows."""
        if self.error or self.findings is None:
            return {"summary": self.error or self.summary, "anomalous_components": []}
        name, have = COMPONENT[self.name], self.findings.columns
        place = F.col("component_rank") if "component_rank" in have else -F.col("total") if "total" in have else -F.col("score")
        rows = self.findings.withColumn("finding", F.struct(*[c for c in have if c not in (name, "component_rank")])).withColumn("place", place)
        by = [c for c in ("severity_rank",) if c in self.findings.columns]
        grouped = rows.groupBy(name).agg(F.min("place").alias("place"), F.sort_array(F.collect_list(F.struct(*by, F.to_json("finding").alias("finding")))).alias("findings"))
        first = grouped.orderBy("place", name).limit(limit).select(F.col(name).alias("component"), "findings.finding").collect()
        parts = [{"component": r["component"], "anomalies": [json.loads(x) for x in r["finding"]]} for r in first]
        extra = {k: [json.loads(r[0]) for r in v.select(F.to_json(F.struct("*"))).limit(limit).collect()] for k, v in self.insights.items()}
        return {"summary": self._said(parts, extra), "anomalous_components": parts, **extra}

    def _said(self, parts: list[dict], extra: dict[str, list[dict]]) -> str:
        said = [self.summary]
        if parts:
            worst = parts[0]["anomalies"][0]
            what = next((worst[c] for c in ("metric", "kpi_key", "level", "state", "callee") if worst.get(c)), "its calls")
            said.append(f"{len(parts)} component(s); first {parts[0]['component']}: {worst.get('severity', 'notable')} {what}")
        said += [f"{k.replace('_', ' ')}: {', '.join(str(next(iter(r.values()), '')) for r in rows)}" for k, rows in extra.items() if rows]
        return "; ".join(said)


#: The column that names the component in the findings of each analysis.
COMPONENT = {"service": "object_id", "infra": "component_id", "database": "pod", "logs": "pod", "traces": "culprit"}


@dataclass
class Report:
    uuid: str
    component: str = ""
    reason: str = ""
    time: str = ""
    reasoning_trace: list[dict] = field(default_factory=list)


def route(request: str, components: list[str] | None = None) -> list[tuple[str, list[str]]]:
    """(analysis, components): database names go to the database analysis alone, services to their pods, calls of one analysis are merged; what names no analysis gets infra and logs."""
    text = request.lower()
    named = components or [c for c in topology.known_components() if c in text]
    named = [c for c in named if components or not any(c != d and c in d for d in named)]  # the longest name counts
    database = [c for c in named if c.startswith("tidb")]
    others = [c for c in named if not c.startswith("tidb")]
    out: list[tuple[str, list[str]]] = []
    if database:
        out.append(("database", sorted({c.split("-")[-1] for c in database})))
    full = [p for c in others for p in (topology.pods_of(c) if c in topology.CALLS or c in topology.SINGLE else [c])]
    wanted = [a for a, words in (("service", ("apm", "latency", "rrt", "service metric")), ("infra", ("cpu", "memory", "disk", "network", "infra")), ("logs", ("log",)), ("traces", ("trace", "span", "call"))) if any(w in text for w in words)]
    if not wanted and (others or not database):
        wanted = ["infra", "logs"]
    return out + [(a, list(dict.fromkeys(full))) for a in wanted]


def service_analysis(spark: SparkSession, root: str, start: str, end: str) -> Result:
    spec = WindowSpec.incident(start, end)
    long = telemetry.service_metrics(spark, root, spec.baseline_start, spec.end)
    if long is None:
        return Result("service", summary="no service metrics for this time")
    found = saved(svc.anomalies(long, spec, "timestamp"), "service-findings")
    return Result("service", svc.ranked(found), "service metrics compared", insights={"widespread_failures": svc.widespread_failures(found)})


def infra_analysis(spark: SparkSession, root: str, start: str, end: str, components: list[str] | None = None) -> Result:
    if bad := infra.forbidden(components):
        return Result("infra", error=f"{', '.join(bad)}: use the database analysis")
    spec = WindowSpec.incident(start, end)
    long = telemetry.infra_metrics(spark, root, spec.baseline_start, spec.end)
    if long is None:
        return Result("infra", summary="no infrastructure metrics for this time")
    insights = {}
    if components:
        requested = spark.createDataFrame([(c,) for c in components], "component_id string")
        insights["missing_components"] = infra.missing_components(requested, long, "component_id")
    rated = counter_rates(long, ["component_id", "component_type"], F.col("kpi_key").endswith("_total"), infra.rate_name(F.col("kpi_key")), spec, kind="timestamp")
    compared = saved(compare(rated, ["component_id", "kpi_key", "component_type"], spec, kind="timestamp"), "infra-compared")
    mine = compared.where(F.col("component_id").isin(components)) if components else compared
    found = infra.infra_anomalies(mine, infra.categories(spark, infra.INFRA_CATEGORIES))
    found = saved(found.join(infra.component_info(long, spec), "component_id", "left"), "infra-findings")
    # nodes count whichever components were asked for
    maxima = compared.where(F.col("kpi_key").isin("node_cpu_usage_rate", "node_memory_usage_rate")).select(F.col("component_id").alias("node"), F.col("anomaly_max").alias("maximum"))
    pods = found.where("component_type = 'pod'").select(F.col("kubernetes_node").alias("node"), F.col("component_id").alias("pod"), "category")
    insights["noisy_neighbours"] = infra.noisy_neighbours(pods, maxima)
    return Result("infra", svc.ranked(found, "component_id", ("kpi_key",)), "infrastructure metrics compared", insights=insights)


def database_analysis(spark: SparkSession, root: str, start: str, end: str, components: list[str] | None = None) -> Result:
    spec = WindowSpec.incident(start, end)
    long = telemetry.database_metrics(spark, root, spec.baseline_start, spec.end, components)
    if long is None:
        return Result("database", summary="no database metrics for this time")
    counters = F.col("kpi_key").isin("failed_query_ops", "transaction_retry", "slow_query", "snapshot_apply_count")
    rated = counter_rates(long, ["pod", "related_node", "type", "component_type"], counters, F.concat("kpi_key", F.lit("_per_second")), spec, kind="timestamp")
    compared = compare(rated, ["pod", "related_node", "kpi_key", "component_type", "type"], spec, kind="timestamp")
    found = saved(infra.database_anomalies(compared, infra.categories(spark, infra.DATABASE_CATEGORIES)), "database-findings")
    group = ["pod", "related_node"]
    bottlenecks = infra.io_bottlenecks(found.where("component_type = 'tikv'"), group)
    hypothesis = bottlenecks.select(*group, F.lit("io_bottleneck").alias("kpi_key"), F.lit("io_bottleneck_hypothesis").alias("metric_name"), F.lit("tikv").alias("component_type"), F.lit("N/A").alias("type"), F.lit("io_bottleneck").alias("category"), F.lit("io_bottleneck").alias("kind"), "severity")
    all_ = found.unionByName(hypothesis, allowMissingColumns=True)
    return Result("database", svc.ranked(all_, "pod", ("kpi_key", "type")), "database metrics compared", insights={"io_bottlenecks": bottlenecks})


def log_analysis(spark: SparkSession, root: str, start: str, end: str, components: list[str] | None = None, keywords: tuple[str, ...] = log_ops.KEYWORDS, **unknown: object) -> Result:
    if unknown:
        return Result("logs", error=f"logs do not know {', '.join(sorted(unknown))}; use keywords")
    spec = WindowSpec.logs(start, end)
    lines = telemetry.logs(spark, root, spec.start - LOG_CONTEXT, spec.end)
    if lines is None:
        return Result("logs", summary="no logs for this time")
    lines = log_ops.of_components(lines, components)
    window = lines.where(spec.in_anomaly("time", "timestamp"))
    errors = window.where(log_ops.has_keyword(F.col("message"), keywords))
    states = saved(log_ops.activity(lines, spec, "pod", kind="timestamp").where("state is not null"), "log-activity")
    patterns = saved(log_ops.error_patterns(errors, log_template(F.col("message"))), "log-patterns")
    if patterns.isEmpty() and errors.isEmpty():
        return Result("logs", log_ops.contextual(window, log_template(F.col("message")), states), "no error lines; what components log, and how much", insights={"activity": states})
    insights = {"activity": states}
    if components:
        requested = spark.createDataFrame([(c,) for c in components], "pod string")
        # a node is reported by its own name
        reported = patterns.select("pod").union(patterns.select("node"))
        insights["components_without_anomalies"] = infra.missing_components(requested, reported, "pod")
    return Result("logs", log_ops.component_rollup(patterns), "error patterns found", insights=insights)


def trace_analysis(spark: SparkSession, root: str, start: str, end: str, component: str) -> Result:
    spec = WindowSpec.incident(start, end)
    before = telemetry.spans(spark, root, spec.baseline_start, spec.baseline_end)
    now = telemetry.spans(spark, root, spec.start, spec.end)
    if now is None or before is None:
        return Result("traces", summary="no traces for this time")
    flat = tr.flatten(now)
    mine = tr.one_span_each(tr.of_traces(flat, tr.relevant(flat, component)), [F.col("start_us"), F.col("duration")])
    found = saved(tr.span_anomalies(tr.with_family(mine), tr.latency_thresholds(tr.flatten(before))), "span-anomalies")
    return Result("traces", tr.hotspots(found, component), "traces of the component analysed")


def anchors(findings: DataFrame) -> DataFrame:
    """Ranks findings (source, component, kind, severity, time): direct downstream error logs before crash signals before failing business logs; other findings after them; infrastructure never anchors."""
    rank = F.when((F.col("source") == "logs") & (F.col("kind") == "connectivity_error"), 0).when((F.col("source") == "logs") & F.col("kind").isin("system_critical", "application_fatal"), 1).when((F.col("source") == "logs") & (F.col("kind") == "business_impact_error"), 2).when(F.col("source") == "infra", 99).otherwise(3)
    return findings.withColumn("anchor_rank", rank).orderBy("anchor_rank", severity_rank(F.col("severity")), "time", "component")


def resource_causes(findings: DataFrame, calls: DataFrame) -> DataFrame:
    """Saturated components at the end of a call chain that explain an anomalous caller: (dst, n_callers)."""
    ends = calls.select("dst").distinct().join(calls.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti")
    full = findings.where((F.col("source") == "infra") & (F.col("severity") == "critical")).select(F.col("component").alias("dst")).distinct()
    callers = calls.join(findings.where("source <> 'infra'").select(F.col("component").alias("src")).distinct(), "src", "left_semi")
    return full.join(ends, "dst", "left_semi").join(callers, "dst").groupBy("dst").agg(F.countDistinct("src").alias("n_callers"))


def chain_causes(findings: DataFrame, calls: DataFrame, most: int | None = None) -> DataFrame:
    """(dst, n_anchors, nearest): saturated components that explain anomalies of components which call them, over at most `most` calls (none: any number).

    A cause is the end of its chain: nothing that it reaches itself is saturated or anomalous, but for itself. nearest: the fewest calls to an anomalous component.
    """
    full = findings.where((F.col("source") == "infra") & (F.col("severity") == "critical")).select(F.col("component").alias("node"), F.lit(True).alias("full"))
    odd = findings.where(F.col("source") != "infra").select(F.col("component").alias("node"), F.lit(False).alias("full"))
    marks = saved(full.unionByName(odd).where("node is not null").groupBy("node").agg(F.bool_or("full").alias("full"), F.bool_or(~F.col("full")).alias("odd")), "marks")
    nodes, edges = numbered_graph(calls, marks)
    marks = saved(marks.join(nodes, "node"), "marks")
    ahead = marks_ahead(marks, edges, most)
    ends = saved(marks.where("full").join(ahead.where("low = id and high = id"), "id", "left_semi"), "ends")
    # what leads to no mark leads to no cause; an end explains no other one, as it reaches none
    leading = edges.join(ahead.select(F.col("id").alias("dst")), "dst", "left_semi")
    behind = sources_behind(marks.where("odd").join(ends, "id", "left_anti"), leading, most)
    return ends.join(behind, "id").select(F.col("node").alias("dst"), F.col("n").alias("n_anchors"), F.col("hops").alias("nearest"))


def _as_findings(result: Result) -> DataFrame | None:
    """(source, component, kind, severity, time) of a result."""
    f, name = result.findings, result.name
    if f is None or name == "traces" and f.isEmpty():
        return None
    component, none = F.col(COMPONENT[name]).alias("component"), F.lit(None).cast("string").alias("time")
    if name == "service":
        cols = [F.col("metric").alias("kind"), F.col("severity"), F.col("first_time").cast("string").alias("time")]
    elif name == "logs" and "level" in f.columns:
        cols = [F.col("level").alias("kind"), F.when(F.col("storm"), "critical").otherwise("major").alias("severity"), F.col("first_time").cast("string").alias("time")]
    elif name == "logs":
        cols, f = [F.col("state").alias("kind"), F.lit("minor").alias("severity"), none], f.where("state is not null")
    elif name == "traces":
        cols = [F.when(F.col("errors") > 0, "call errors").otherwise("call latency").alias("kind"), F.when(F.col("errors") > 0, "major").otherwise("minor").alias("severity"), F.timestamp_millis("first_ms").cast("string").alias("time")]
    else:
        cols = [F.col("kpi_key").alias("kind"), F.col("severity"), none]
    return f.select(F.lit(name).alias("source"), component, *cols)


def diagnose(spark: SparkSession, root: str, case: dict) -> Report:
    """Service metrics, logs, infrastructure, the database, and the calls of the worst service; the best anchor names the component, its description the reason."""
    start, end = find_range(case["description"])
    if not start:
        start, end = find_loose_range(case["description"])
    report = Report(case["uuid"])
    if not start:
        report.reason = "no time range"
        return report
    runs: list[tuple[str, Callable[[], Result]]] = [
        ("service", lambda: service_analysis(spark, root, start, end)),
        ("logs", lambda: log_analysis(spark, root, start, end)),
        ("infra", lambda: infra_analysis(spark, root, start, end)),
        ("database", lambda: database_analysis(spark, root, start, end)),
    ]
    parts: list[DataFrame] = []
    worst = None
    for name, run in runs:
        result = run()
        report.reasoning_trace.append({"step": len(report.reasoning_trace) + 1, "action": name, "observation": result.report(3)["summary"]})
        found = _as_findings(result)
        parts += [found] if found is not None else []
        if name == "service" and result.findings is not None:
            worst = result.findings.select(F.when(is_pod(F.col("object_id")), service_of(F.col("object_id"))).otherwise(F.col("object_id")).alias("s")).first()
    if worst:
        result = trace_analysis(spark, root, start, end, worst["s"])
        report.reasoning_trace.append({"step": len(report.reasoning_trace) + 1, "action": "traces", "observation": result.report(3)["summary"]})
        found = _as_findings(result)
        parts += [found] if found is not None else []
    if parts:
        best = anchors(reduce(DataFrame.unionByName, parts)).first()
        if best:
            report.component, report.reason, report.time = best["component"], f"{best['source']}: {best['kind']}", best["time"] or start
    return report


def run_batch(cases: list[dict], out_dir: str, answer: Callable[[dict], Report]) -> dict:
    """A result file for each case; cases that have one are left as they are. Returns the summary, which is written as well: totals, and a row for each case.

    A row has uuid, status (`completed`, `kept`: had a result already, `failed`), success, the result's path, and the error of a case that failed.
    """
    os.makedirs(out_dir, exist_ok=True)
    rows = []
    for case in cases:
        path = os.path.join(out_dir, f"{case['uuid']}.json")
        row = {"uuid": case["uuid"], "success": True, "status": "kept", "path": path}
        try:
            if not os.path.exists(path):
                with open(path + ".part", "w", encoding="utf-8") as f:
                    json.dump(asdict(answer(case)), f, ensure_ascii=False, indent=2)
                os.replace(path + ".part", path)
                row["status"] = "completed"
        except Exception as e:  # a case that fails is counted and the batch goes on
            row |= {"success": False, "status": "failed", "path": None, "error": str(e)}
        rows.append(row)
    good = sum(r["success"] for r in rows)
    done = {"total": len(cases), "success": good, "failure": len(cases) - good, "cases": rows}
    with open(os.path.join(out_dir, "summary.json"), "w", encoding="utf-8") as f:
        json.dump(done, f, ensure_ascii=False, indent=2)
    return done


def progress(steps: DataFrame, by: str, success: Column) -> DataFrame:
    """(by, total, success, failure): how many steps of each plan, batch or status there are and succeeded; null is no success."""
    good = F.coalesce(success, F.lit(False))
    return steps.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("success"), F.count_if(~good).alias("failure"))
