"""Traces: flattening nested spans, thresholds, parents and children, culprits and hotspots."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.functions.expressions import comparable_name
from faultline.operators.compare import grouped
from faultline.sources.scratch import saved


def tag(tags: Column, *keys: str) -> Column:
    """The value of the first tag with the first key that any tag has."""
    named = lambda key: F.get(F.filter(tags, lambda t: t["key"] == key), F.lit(0))["value"]
    return F.coalesce(*[named(k) for k in keys])


def parent_id(references: Column) -> Column:
    first = F.get(references, F.lit(0))
    return F.coalesce(F.when(first["refType"] == "CHILD_OF", first["spanID"]), F.lit("root"))


def log_error(logs: Column) -> Column:
    """The reason in the first log entry that tells of an error. Of repeated fields the last counts."""
    field = lambda log, k: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(log["fields"], lambda f: f["key"] == k), lambda f: f["value"])), -1)
    reason = lambda log: (
        F.when(field(log, "event") == "exception", F.concat(F.lit("exception: "), F.coalesce(field(log, "exception.message"), F.lit("Unknown exception"))))
        .when((field(log, "event") == "error") | (field(log, "message.event") == "error"), F.concat(F.lit("error event: "), F.coalesce(field(log, "message"), F.lit("undescribed error"))))
    )
    return F.get(F.filter(F.transform(logs, reason), lambda r: r.isNotNull()), F.lit(0))


def flatten(spans: DataFrame) -> DataFrame:
    """One flat row for each span, in one projection."""
    tags, process = F.col("tags"), F.col("process")
    return spans.select(
        F.col("traceID").alias("trace_id"),
        F.col("spanID").alias("span_id"),
        parent_id(F.col("references")).alias("parent_id"),
        F.col("operationName").alias("operation"),
        process["serviceName"].alias("service"),
        tag(process["tags"], "name").alias("pod"),
        tag(process["tags"], "node_name").alias("node"),
        F.col("startTime").alias("start_us"),
        F.col("startTimeMillis").alias("start_ms"),
        F.col("duration"),
        tag(tags, "rpc.grpc.status_code", "http.status_code").alias("status_code"),
        tag(tags, "error").alias("error_tag"),
        tag(tags, "rpc.grpc.status_message").alias("status_message"),
        tag(tags, "peer.service").alias("peer_service"),
        tag(tags, "span.kind").alias("span_kind"),
        tag(tags, "net.peer.ip").alias("peer_ip"),
        log_error(F.col("logs")).alias("log_error"),
    )


def export_rows(spans: DataFrame, *more: str) -> DataFrame:
    """Rows for files, with `more` columns of the spans: only the HTTP status (0 if there is none), the store's service under its full name, ordered by trace and start."""
    tags, process = F.col("tags"), F.col("process")
    pod = tag(process["tags"], "name", "podName")
    service = F.coalesce(process["serviceName"], F.regexp_replace(pod, "-[0-9]+$", ""))
    return spans.select(
        "traceID",
        "spanID",
        parent_id(F.col("references")).alias("ParentspanID"),
        "operationName",
        F.when(service == "redis", "redis-cart").otherwise(service).alias("service"),
        "startTime",
        "startTimeMillis",
        "duration",
        pod.alias("pod_name"),
        tag(process["tags"], "node_name", "nodeName").alias("node_name"),
        F.coalesce(F.expr("try_cast(get(filter(tags, t -> t.key = 'http.status_code'), 0).value AS int)"), F.lit(0)).alias("status_code"),
        *more,
    ).orderBy("traceID", "startTime")


#: The columns in which a span names a component.
NAMED_IN = ("pod", "service", "operation", "peer_service", "peer_ip")


def relevant_to(flat: DataFrame, components: list[str]) -> DataFrame:
    """(component, trace_id) of traces with a span that names the component in its pod, service, operation or peer.

    One scan for all components: an automaton over their names goes once through what a span holds.
    """
    import ahocorasick

    wanted: dict[str, list[str]] = {}
    for c in components:
        plain = re.sub("[^a-z0-9]", "", ("redis" if c == "redis-cart" else c).lower())
        wanted.setdefault(plain, []).append(c)
    everywhere = wanted.pop("", [])  # a name without letters or digits is in every text
    automaton = ahocorasick.Automaton()
    for plain, own in wanted.items():
        automaton.add_word(plain, tuple(own))
    automaton.make_automaton()

    @F.pandas_udf("array<string>")
    def named(texts: pd.Series) -> pd.Series:
        search = automaton.iter if len(automaton) else lambda _: ()
        return texts.map(lambda t: sorted({c for _, own in search(t) for c in own}.union(everywhere if t else ())))

    held = F.concat_ws("\n", *[comparable_name(F.col(c)) for c in NAMED_IN])  # the mark is in no name
    known = flat.where(F.coalesce(*NAMED_IN).isNotNull())
    return known.select("trace_id", F.explode(named(F.concat(held, F.lit("\n")))).alias("component")).distinct().select("component", "trace_id")


def relevant(flat: DataFrame, component: str) -> DataFrame:
    """(trace_id) of the traces relevant to one component."""
    wanted = comparable_name(F.lit("redis" if component == "redis-cart" else component))
    hit = reduce(lambda a, b: a | b, [comparable_name(F.col(c)).contains(wanted) for c in NAMED_IN])
    return flat.where(hit).select("trace_id").distinct()


def of_traces(flat: DataFrame, ids: DataFrame) -> DataFrame:
    return flat.join(ids.select("trace_id"), "trace_id", "left_semi")


def latency_thresholds(flat: DataFrame, by: tuple[str, str] = ("service", "operation"), least_rows: int = 5, floor: int = 1000) -> DataFrame:
    """(by, threshold): the 95th percentile, 1000 at least, where there are five spans."""
    known = flat.where(F.col(by[0]).isNotNull() & F.col(by[1]).isNotNull())
    return grouped(known, list(by), [F.count("duration").alias("n")], {"p95": (F.col("duration"), 0.95)}).where(F.col("n") >= least_rows).select(*by, F.greatest(F.floor(F.round("p95", 6)), F.lit(floor)).cast("long").alias("threshold"))


def one_span_each(flat: DataFrame, order: list[Column]) -> DataFrame:
    """Of spans that share trace and id the last in the given order."""
    w = W.partitionBy("trace_id", "span_id").orderBy(*[c.desc() for c in order])
    return flat.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def with_family(flat: DataFrame) -> DataFrame:
    """flat with parent_service, grandparent_service, has_parent and children_us.

    The flat spans are written once; the joins read the few columns that they need from there. Each is keyed by trace and span, so the spans of one large trace are dealt out as well.
    """
    spans = saved(flat, "spans")
    up = lambda n, c: spans.select("trace_id", F.col("span_id").alias(n), F.col("service").alias(f"{c}_service"), F.col("parent_id").alias(f"{c}_parent"))
    children = spans.groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.sum("duration").alias("children_us"))
    out = spans.join(up("parent_id", "parent"), ["trace_id", "parent_id"], "left")
    out = out.join(up("parent_parent", "grandparent").drop("grandparent_parent"), ["trace_id", "parent_parent"], "left")
    return out.join(children, ["trace_id", "span_id"], "left").withColumns({"has_parent": F.col("parent_parent").isNotNull(), "children_us": F.coalesce("children_us", F.lit(0))})


def is_error() -> Column:
    code = F.expr("try_cast(try_cast(status_code AS double) AS int)")
    return F.coalesce(F.lower(F.col("error_tag")) == "true", F.lit(False)) | F.col("log_error").isNotNull() | F.coalesce(((code > 0) & (code < 20)) | (code >= 400), F.lit(False))


def span_anomalies(family: DataFrame, thresholds: DataFrame, by: tuple[str, str] = ("service", "operation")) -> DataFrame:
    """(trace_id, span_id, kind, caller, callee, culprit, duration_ms, start_ms): a row for an error and one for own latency."""
    met = family.join(thresholds, list(by), "left")
    slow = F.coalesce((F.col("duration") > F.col("threshold")) & (F.col("duration") - F.col("children_us") > 0.5 * F.col("threshold")), F.lit(False))
    caller = F.when(~F.col("has_parent"), "entrypoint").when(F.col("parent_service") == F.col("service"), F.coalesce("grandparent_service", F.lit("entrypoint"))).otherwise(F.col("parent_service"))
    callee = F.coalesce(F.when(F.col("peer_service") != "", F.col("peer_service")), F.col("service"))
    culprit = F.when(F.col("span_kind") == "client", callee).otherwise(F.col("service"))
    kinds = F.filter(F.array(F.when(is_error(), "error"), F.when(slow, "latency")), lambda k: k.isNotNull())
    store = callee == "redis"
    return met.withColumn("kind", F.explode(kinds)).select(
        "trace_id", "span_id", "kind", caller.alias("caller"), F.when(store, "redis-cart").otherwise(callee).alias("callee"), F.when(store, "redis-cart").otherwise(culprit).alias("culprit"), F.round(F.col("duration") / 1000, 2).alias("duration_ms"), "start_ms"
    )


def hotspots(found: DataFrame, component: str | None = None) -> DataFrame:
    """(culprit, total_ms, errors, calls, first_ms, score), highest score first."""
    mine = found.where((F.col("caller") == component) | (F.col("culprit") == component)) if component else found
    stats = mine.where(F.col("culprit").isNotNull()).groupBy("culprit").agg(F.sum("duration_ms").alias("total_ms"), F.count_if(F.col("kind") == "error").alias("errors"), F.count(F.lit(1)).alias("calls"), F.min("start_ms").alias("first_ms"))
    tops = stats.agg(F.max("errors").alias("e"), F.max("total_ms").alias("d"))
    share = lambda x, top: F.when(F.col(top) > 0, F.col(x) / F.col(top)).otherwise(0.0)
    scored = stats.join(F.broadcast(tops), F.lit(True)).withColumn("score", 0.7 * share("errors", "e") + 0.3 * share("total_ms", "d"))  # the right side is one row
    return scored.drop("e", "d").orderBy(F.desc("score"), "culprit")


def slowest_traces(flat: DataFrame, k: int) -> DataFrame:
    return flat.where("parent_id = 'root'").orderBy(F.desc("duration"), "trace_id", "span_id").limit(k).select("trace_id").distinct()


def error_traces(flat: DataFrame) -> DataFrame:
    return flat.where(F.lower(F.col("error_tag")) == "true").select("trace_id").distinct()


def profile(flat: DataFrame) -> DataFrame:
    """(measure, item, n): spans, roots, children, spans per trace, statuses, services, and each column's percentage of nulls.

    One aggregate over the table, by trace, by status, by service and over all, which is written; what is told comes from its rows. No spans: no counts.
    """
    status = F.coalesce(F.expr("try_cast(status_code AS int)"), F.lit(0)).cast("string")
    root = F.col("parent_id") == "root"
    told = flat.withColumn("__status", status)
    keys = ["trace_id", "__status", "service"]
    counts = {"spans": F.count(F.lit(1)), "roots": F.count_if(root), "children": F.count_if(~root), "no_pod": F.count_if(F.col("pod").isNull())}
    # grouping columns are null in the rows of other sets, so their nulls are counted from copies
    copies = told.withColumns({f"__of_{c}": F.col(c) for c in keys if c in flat.columns})
    nulls = {f"__null_{c}": F.count_if(F.col(f"__of_{c}" if c in keys else c).isNull()) for c in flat.columns}
    sets = copies.groupingSets([[keys[0]], [keys[1]], [keys[2]], []], *keys).agg(F.grouping_id().alias("__set"), *[c.alias(n) for n, c in (counts | nulls).items()])
    sets = saved(sets, "profile")
    by = lambda i: sets.where(F.col("__set") == 7 - (1 << (2 - i)))
    whole = sets.where("__set = 7").select(*[F.col(c).cast("double").alias(c) for c in counts], *[(F.col(f"__null_{c}") * 100.0 / F.col("spans")).alias(f"__null_{c}") for c in flat.columns])
    totals = whole.unpivot([], list(counts), "measure", "n").select("measure", F.lit("").alias("item"), "n")
    shares = whole.unpivot([], list(nulls), "item", "n").select(F.lit("null_percent").alias("measure"), F.substring("item", len("__null_") + 1, 1000).alias("item"), "n")
    sizes = by(0).agg(F.avg("spans").alias("mean_spans"), F.max("spans").cast("double").alias("max_spans"), F.min("spans").cast("double").alias("min_spans"))
    per_trace = sizes.unpivot([], ["mean_spans", "max_spans", "min_spans"], "measure", "n").select("measure", F.lit("").alias("item"), "n")
    by_status = by(1).select(F.lit("status").alias("measure"), F.col("__status").alias("item"), F.col("spans").cast("double").alias("n"))
    top = by(2).where("service is not null").select(F.lit("service").alias("measure"), F.col("service").alias("item"), F.col("spans").cast("double").alias("n")).orderBy(F.desc("n"), "item").limit(10)
    return totals.unionByName(per_trace).unionByName(by_status).unionByName(top).unionByName(shares)


def ids_in_range(spans: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """The distinct trace ids of spans that start within the bounds (microseconds, both included)."""
    return spans.where(F.col("startTime").between(start_us, end_us)).select("traceID").distinct()


def slow_spans(flat: DataFrame, thresholds: DataFrame, by: tuple[str, str] = ("pod", "operation")) -> DataFrame:
    """Spans over their own threshold: (trace_id, span_id, by, duration, threshold, start_ms)."""
    return flat.join(thresholds, list(by)).where(F.col("duration") > F.col("threshold")).select("trace_id", "span_id", *by, "duration", "threshold", "start_ms")


def failed_spans(flat: DataFrame, least: int = 400) -> DataFrame:
    """Spans with a status of `least` and more; text that is no number counts as 0."""
    code = F.coalesce(F.expr("try_cast(status_code AS double)"), F.lit(0.0))
    return flat.where(code >= least).select("trace_id", "span_id", F.coalesce("pod", F.lit("unknown_pod")).alias("pod"), F.coalesce("operation", F.lit("unknown_operation")).alias("operation"), code.alias("code"), "start_ms")
