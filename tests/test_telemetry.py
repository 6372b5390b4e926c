"""A small lake on disk, from the files to the answer."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from faultline.operators import service_metrics as svc
from faultline.operators import traces as tr
from faultline.plans import diagnosis, topology
from faultline.plans.windows import WindowSpec
from faultline.sources import telemetry
from faultline.streaming.windows import metric_windows

START, END = "2025-06-05T17:00:00Z", "2025-06-05T17:10:00Z"
AT = datetime(2025, 6, 5, 17, tzinfo=UTC)
DAY = "2025-06-06"  # the local date


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    minutes = [AT + timedelta(minutes=m) for m in (*range(-15, -5), *range(11))]
    bad = lambda t: t >= AT
    write = lambda rows, path: spark.createDataFrame(rows).coalesce(1).write.parquet(f"{root}/{path}")
    write([Row(time=t, object_id="cartservice-0", object_type="pod", rrt=0.2 + 5 * bad(t), error=float(3 * bad(t)), request="12") for t in minutes], f"{DAY}/metric-parquet/apm/pod/pod_cart_{DAY}.parquet")
    tall = lambda kpi, base, peak, **ids: [Row(time=t, kpi_key=kpi, instance="10.0.0.1:9100", **ids, **{kpi: base + (peak - base) * bad(t) + 0.001 * (t.minute % 3)}) for t in minutes]
    write(tall("node_cpu_usage_rate", 20.0, 95.0, pod="null", kubernetes_node="aiops-k8s-01"), f"{DAY}/metric-parquet/infra/infra_node/infra_node_node_cpu_usage_rate_{DAY}.parquet")
    write(tall("io_util", 0.1, 0.95, pod="null", kubernetes_node="null"), f"{DAY}/metric-parquet/other/infra_tikv_io_util_{DAY}.parquet")
    iso = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S.000Z")
    lines = [Row(**{"k8_pod": "cartservice-0", "@timestamp": iso(t), "message": "rpc error: connection refused 10.1.1.1:6379" if bad(t) else "ok", "k8_node_name": "aiops-k8s-01"}) for t in minutes]
    write(lines, f"{DAY}/log-parquet/log_filebeat-server_{DAY}_01-00-00.parquet")
    us = lambda t: int(t.timestamp() * 1_000_000)
    tags = lambda **kv: [{"key": k, "type": "string", "value": v} for k, v in kv.items()]
    spans = []
    for i, t in enumerate(minutes):
        for k, (svc_name, kind) in enumerate((("frontend", "server"), ("cartservice", "client"))):
            own = tags(**{"span.kind": kind, **({"peer.service": "redis", "rpc.grpc.status_code": "14" if bad(t) else "0"} if k else {})})
            spans.append((f"t{i}", f"s{k}", 1.0, f"op{k}", [{"refType": "CHILD_OF", "spanID": "s0"}] if k else [], us(t), us(t) // 1000, 2000, own, [], {"serviceName": svc_name, "tags": tags(name=f"{svc_name}-0", node_name="n")}))
    for hour, part in (("00", [s for s in spans if s[5] < us(AT)]), ("01", [s for s in spans if s[5] >= us(AT)])):
        spark.createDataFrame(part, telemetry.SPAN).coalesce(1).write.parquet(f"{root}/{DAY}/trace-parquet/trace_jaeger-span_{DAY}_{hour}-59-00.parquet")
    return root


def test_dates_and_hours():
    assert telemetry.local_dates(AT - timedelta(hours=2), AT) == ["2025-06-05", "2025-06-06"]
    assert telemetry.local_hours(AT - timedelta(minutes=10), AT) == [(DAY, "00"), (DAY, "01")]


def test_analyses(spark, lake):
    found = diagnosis.service_analysis(spark, lake, START, END).findings.collect()
    assert [(r["object_id"], r["metric"], r["severity"]) for r in found] == [("cartservice-0", "error", "major"), ("cartservice-0", "rrt", "major")]
    assert found[1]["first_time"].minute == 0
    node = diagnosis.infra_analysis(spark, lake, START, END).findings.first()
    assert (node["component_id"], node["kind"], node["severity"]) == ("aiops-k8s-01", "spike", "critical")
    assert diagnosis.infra_analysis(spark, lake, START, END, ["tidb"]).error
    disk = diagnosis.database_analysis(spark, lake, START, END).findings.first()
    assert (disk["kpi_key"], disk["severity"], disk["pod"], disk["related_node"]) == ("io_util", "critical", "N/A_cluster_level", "10.0.0.1:9100")
    log = diagnosis.log_analysis(spark, lake, START, END).findings.first()
    assert (log["pod"], log["total"], log["level"]) == ("cartservice-0", 11, "connectivity_error")
    assert (log["node"], log["top_count"], log["top_details"]) == ("aiops-k8s-01", 11, "rpc error: connection refused 10.1.1.1:6379")
    hot = diagnosis.trace_analysis(spark, lake, START, END, "frontend").findings.first()  # the caller is the parent span's service
    assert (hot["culprit"], hot["errors"], hot["calls"]) == ("redis-cart", 11, 11)
    assert diagnosis.log_analysis(spark, lake, "2020-01-01T00:00:00Z", "2020-01-01T01:00:00Z").findings is None


def test_quiet_logs_compare_activity(spark, lake):
    found = diagnosis.log_analysis(spark, lake, START, END, keywords=("nowhere",))
    row = found.findings.collect()
    assert [(r["pod"], r["node"], r["total"], r["state"]) for r in row] == [("cartservice-0", "aiops-k8s-01", 11, None)]
    assert [(p["template"], p["count"], p["percentage"]) for p in row[0]["patterns"]] == [("rpc error: connection refused <IP> : <NUM>", 11, 100.0)]
    assert found.insights["activity"].count() == 0


def test_reports(spark, lake):
    service = diagnosis.service_analysis(spark, lake, START, END).report()
    assert [(c["component"], [a["metric"] for a in c["anomalies"]]) for c in service["anomalous_components"]] == [("cartservice-0", ["error", "rrt"])]
    assert service["widespread_failures"] == [] and "cartservice-0: major error" in service["summary"]
    infra = diagnosis.infra_analysis(spark, lake, START, END, ["aiops-k8s-01", "nowhere-0"]).report()
    assert infra["missing_components"] == [{"component_id": "nowhere-0"}] and infra["noisy_neighbours"] == []
    assert infra["anomalous_components"][0]["anomalies"][0]["ip_address"] == "10.0.0.1"
    logs = diagnosis.log_analysis(spark, lake, START, END, ["cartservice-0", "adservice-1"]).report()
    assert logs["components_without_anomalies"] == [{"pod": "adservice-1"}] and "adservice-1" in logs["summary"]
    assert diagnosis.log_analysis(spark, lake, START, END, error_level="x").error
    assert diagnosis.trace_analysis(spark, lake, START, END, "frontend").report()["anomalous_components"][0]["component"] == "redis-cart"
    assert diagnosis.database_analysis(spark, lake, "2020-01-01T00:00:00Z", "2020-01-01T01:00:00Z").report()["anomalous_components"] == []


def test_neighbours_and_bottlenecks_reach_the_analyses(spark, tmp_path):
    minutes = [AT + timedelta(minutes=m) for m in (*range(-15, -5), *range(11))]

    def write(folder, name, kpi, base, peak, ids):
        rows = [Row(time=t, kpi_key=kpi, **i, **{kpi: base + (peak - base) * (t >= AT) + 0.001 * (t.minute % 3)}) for t in minutes for i in ids]
        spark.createDataFrame(rows).coalesce(1).write.parquet(f"{tmp_path}/{DAY}/metric-parquet/{folder}/{name}_{kpi}_{DAY}.parquet")

    pods = [{"pod": f"cartservice-{i}", "kubernetes_node": "aiops-k8s-01", "instance": "10.0.0.1:9100"} for i in range(2)]
    write("infra/infra_pod", "infra_pod", "pod_cpu_usage", 0.1, 2.0, pods)
    write("infra/infra_node", "infra_node", "node_cpu_usage_rate", 20.0, 95.0, [{"pod": "null", "kubernetes_node": "aiops-k8s-01", "instance": "10.0.0.1:9100"}])
    store = [{"pod": "tikv-0", "kubernetes_node": "null", "instance": "10.0.0.9:20180"}]
    write("other", "infra_tikv", "io_util", 0.1, 0.95, store)
    write("other", "infra_tikv", "raft_apply_wait", 0.01, 0.5, store)
    near = diagnosis.infra_analysis(spark, str(tmp_path), START, END).insights["noisy_neighbours"].collect()
    assert [(r["node"], r["n_pods"]) for r in near] == [("aiops-k8s-01", 2)]
    disk = diagnosis.database_analysis(spark, str(tmp_path), START, END).findings.where("kind = 'io_bottleneck'").collect()
    assert [(r["pod"], r["severity"]) for r in disk] == [("tikv-0", "critical")]


def test_case_to_answer_and_resume(spark, lake, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"uuid": "a", "Anomaly Description": f"from {START} to {END}"}, {"uuid": "b", "Anomaly Description": "?"}]))
    cases = telemetry.cases(spark, str(tmp_path / "cases.json"))
    out = str(tmp_path / "out")
    done = diagnosis.run_batch(cases, out, lambda c: diagnosis.diagnose(spark, lake, c))
    assert (done["total"], done["success"], done["failure"]) == (2, 2, 0) and [r["status"] for r in done["cases"]] == ["completed", "completed"]
    answer = json.loads((tmp_path / "out" / "a.json").read_text())
    assert (answer["component"], answer["reason"]) == ("cartservice-0", "logs: connectivity_error") and [r["action"] for r in answer["reasoning_trace"]] == ["service", "logs", "infra", "database", "traces"]
    again = diagnosis.run_batch([*cases, {"uuid": "c"}], out, lambda c: 1 / 0)
    assert (again["success"], again["failure"]) == (2, 1)
    assert [(r["uuid"], r["status"], r["success"]) for r in again["cases"]] == [("a", "kept", True), ("b", "kept", True), ("c", "failed", False)] and "zero" in again["cases"][2]["error"]
    assert json.loads((tmp_path / "out" / "summary.json").read_text()) == again


def test_routes():
    assert diagnosis.route("check tidb-pd") == [("database", ["pd"])]
    assert diagnosis.route("cpu of cartservice and redis-cart") == [("infra", ["cartservice-0", "cartservice-1", "cartservice-2", "redis-cart-0"])]
    assert [a for a, _ in diagnosis.route("what happened")] == ["infra", "logs"]


def test_topology(spark):
    assert topology.pods(spark).where("service = 'redis-cart'").count() == 1 and topology.edges(spark).count() == 16


def test_wide_rows_keep_bad_text_as_zero(spark):
    wide = spark.createDataFrame([(AT, "a", "pod", "x", 1.5)], "time timestamp, object_id string, object_type string, request string, rrt double")
    assert {(r["metric"], r["value"]) for r in svc.wide_to_long(wide).collect()} == {("request", 0.0), ("rrt", 1.5)}
    assert svc.wide_to_long(wide.drop("object_id")).count() == 0


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    telemetry.write_csv(df, str(tmp_path / "c"))
    assert sorted(r["record"] for r in telemetry.chart_rows(spark, str(tmp_path / "c")).collect()) == ['{"n":1,"s":"a"}', '{"n":2,"s":null}']
    telemetry.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_traces_go_to_a_folder_for_each_file(spark, lake, tmp_path):
    rows = telemetry.export_traces(spark, lake, AT - timedelta(minutes=30), AT + timedelta(minutes=10), str(tmp_path / "csv"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert back.count() == rows.count() == 42 and back.select("source_file").distinct().count() == 2
    assert telemetry.export_traces(spark, lake, AT - timedelta(days=9), AT - timedelta(days=8), str(tmp_path / "none")) is None


def test_stream(spark, tmp_path):
    rows = [(AT + timedelta(seconds=s), "a", "rrt", float(s)) for s in (0, 30, 70)]
    df = spark.createDataFrame(rows, "time timestamp, object_id string, metric string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = metric_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["n"], r["top"]) for r in spark.table("windows").orderBy("start").collect()] == [(2, 30.0), (1, 70.0)]
    assert F.col("n") is not None


def test_skipped_files_have_reasons(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id as string) as s").coalesce(1).write.parquet(str(tmp_path / "day"))
    whole = next((tmp_path / "day").glob("*.parquet"))
    data = whole.read_bytes()
    rotten = bytearray(data)
    rotten[len(data) // 4 : len(data) // 2] = b"\xff" * (len(data) // 2 - len(data) // 4)
    for name, content in {"torn": data[: len(data) // 2], "empty": b"", "rotten": bytes(rotten), "text": b"no parquet at all", "copy": data}.items():
        (tmp_path / f"{name}.parquet").write_bytes(content)
    files = [str(p) for p in tmp_path.iterdir()]
    got = {r.file.rsplit("/", 1)[-1]: r for r in telemetry.skipped_files(spark, files).collect()}
    assert set(got) == {"torn.parquet", "empty.parquet", "rotten.parquet", "text.parquet"}
    assert all(r.reason for r in got.values()) and got["torn.parquet"].bytes == len(data) // 2
    assert telemetry.skipped_files(spark, []).count() == 0


def scans(df):
    """How many file scans a plan has."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_metrics_of_many_files_come_by_one_scan(spark, tmp_path):
    folder = f"{DAY}/metric-parquet/infra/infra_pod"
    row = lambda m, v, **more: Row(time=AT + timedelta(minutes=m), pod=f"p-{m}", kubernetes_node="n", instance="10.0.0.1:9100", **v, **more)
    made = {
        "pod_cpu_usage": [row(m, {"pod_cpu_usage": m / 2}) for m in range(5)],
        "pod_processes": [row(m, {"pod_processes": m}) for m in range(5)],  # whole numbers
        "pod_memory": [row(m, {"value": float(m)}, pod_cpu_usage=9.0) for m in range(5)],  # no column of its own, but a foreign one
        "pod_disk": [row(m, {"other": 1.0}) for m in range(5)],
    }
    for kpi, rows in made.items():
        spark.createDataFrame(rows).write.parquet(f"{tmp_path}/{folder}/infra_pod_{kpi}_{DAY}.parquet")
    got = telemetry.infra_metrics(spark, str(tmp_path), AT, AT + timedelta(minutes=3))
    want = {(k, f"p-{m}", float(m / 2 if k == "pod_cpu_usage" else m)) for k in ("pod_cpu_usage", "pod_processes", "pod_memory") for m in range(4)}
    assert {(r["kpi_key"], r["pod"], r["value"]) for r in got.collect()} == want and got.count() == len(want)
    assert scans(got) == 1 and "pod_cpu_usage" not in got.columns
    # whole and broken numbers in one column: metric by metric
    spark.createDataFrame([row(1, {"value": 7})]).write.parquet(f"{tmp_path}/{folder}/infra_pod_pod_fs_{DAY}.parquet")
    both = telemetry.infra_metrics(spark, str(tmp_path), AT, AT + timedelta(minutes=3))
    assert {(r["kpi_key"], r["pod"], r["value"]) for r in both.collect()} == want | {("pod_fs", "p-1", 7.0)}
    assert telemetry.infra_metrics(spark, str(tmp_path), AT + timedelta(days=9), AT + timedelta(days=9)) is None


def test_log_text_in_either_column(spark, tmp_path):
    at = "2025-06-05T17:00:00.000Z"
    for hour, row in (("00", {"body": "b"}), ("01", {"message": "m"}), ("02", {"message": None, "body": "b2"})):
        schema = "`@timestamp` string, k8_pod string, k8_node_name string, " + ", ".join(f"{c} string" for c in row)
        spark.createDataFrame([(at, "p", "n", *row.values())], schema).write.parquet(f"{tmp_path}/{DAY}/log-parquet/log_filebeat-server_{DAY}_{hour}-00-00.parquet")
    got = telemetry.logs(spark, str(tmp_path), AT - timedelta(hours=1), AT + timedelta(hours=1))
    assert sorted(r["message"] for r in got.collect()) == ["b", "b2", "m"] and "body" not in got.columns


def test_families_and_profiles_read_the_spans_once(spark, lake):
    flat = tr.flatten(telemetry.spans(spark, lake, AT - timedelta(minutes=30), AT + timedelta(minutes=10)))
    family = tr.with_family(flat)
    assert not [f for f in family.inputFiles() if lake in f] and not [f for f in tr.profile(flat).inputFiles() if lake in f]
    child = family.where("span_id = 's1'").first()
    assert (child["has_parent"], child["parent_service"], child["grandparent_service"], child["children_us"]) == (True, "frontend", None, 0)
    assert family.where("span_id = 's0'").first()["children_us"] == 2000


def test_callers_within_a_service_and_severities_of_latency(spark):
    columns = "trace_id string, span_id string, parent_id string, operation string, service string, status_code string, error_tag string, log_error string, peer_service string, span_kind string, duration long, start_ms long"
    span = lambda i, parent, service, error=None: ("t", i, parent, "op", service, None, error, None, None, "server", 2000, 1)
    flat = spark.createDataFrame([span("a", "root", "front", "true"), span("b", "a", "cart", "true"), span("c", "b", "cart", "true"), span("d", "c", "cart", "true"), span("x", "gone", "mail", "true"), (None, "a", "root", *span("", "", "lost", "true")[3:])], columns)
    none = spark.createDataFrame([], "service string, operation string, threshold long")
    got = {(r["trace_id"], r["span_id"]): r["caller"] for r in tr.span_anomalies(tr.with_family(flat), none).collect()}
    # a caller of the same service gives way to its own caller; spans without a parent in the trace are entered from outside
    assert got == {("t", "a"): "entrypoint", ("t", "b"): "front", ("t", "c"): "front", ("t", "d"): "cart", ("t", "x"): "entrypoint", (None, "a"): "entrypoint"}

    times = [AT + timedelta(minutes=m) for m in (*range(-15, -5), *range(11))]
    rows = [(t, name, "pod", "rrt", 0.2 + (top - 0.2) * (t >= AT)) for name, top in (("p-0", 12.0), ("p-1", 3.0), ("p-2", 0.6), ("p-3", 0.2)) for t in times]
    long = spark.createDataFrame(rows, "time timestamp, object_id string, object_type string, metric string, value double")
    found = svc.anomalies(long, WindowSpec.incident(START, END), "timestamp").collect()
    assert {r["object_id"]: r["severity"] for r in found} == {"p-0": "critical", "p-1": "major", "p-2": "minor"}


def test_relevant_columns_reach_the_scan(spark, lake):
    df = telemetry.read_files(spark, telemetry.trace_files(spark, lake, AT, AT), telemetry.SPAN)
    slim = telemetry.relevant(df, "spans")
    assert slim.columns == list(telemetry.COLUMNS["spans"]) and "flags" not in slim.columns
    plan = slim._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "flags" not in plan.split("ReadSchema")[1]
    lines = telemetry.read_files(spark, telemetry.log_files(spark, lake, AT, AT))
    assert telemetry.relevant(lines, "logs").columns == ["@timestamp", "k8_pod", "message", "k8_node_name"]
    assert telemetry.relevant(lines, "infra").columns == lines.columns


def test_service_files_without_a_time_give_no_row(spark, tmp_path):
    spark.createDataFrame([("cartservice-0", "pod", 1.0)], "object_id string, object_type string, rrt double").write.parquet(f"{tmp_path}/{DAY}/metric-parquet/apm/pod/pod_cart_{DAY}.parquet")
    got = telemetry.service_metrics(spark, str(tmp_path), AT, AT + timedelta(minutes=5))
    assert got.columns == ["time", "object_id", "object_type", "metric", "value"] and got.count() == 0
    assert telemetry.service_metrics(spark, str(tmp_path / "none"), AT, AT) is None
