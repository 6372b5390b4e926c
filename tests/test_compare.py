"""Comparison of windows, percentiles by counted values, and how often plans read their table."""

import math
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline import queries as q
from faultline.operators.compare import compare, counter_rates, percentiles, systematic_sample
from faultline.operators.series import series
from faultline.plans.windows import WindowSpec, in_windows, incident_table

SF = "/root/testdata/sf0.01"


def scans(df, table):
    """How often the executed plan reads the table."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(rf"FileScan parquet [^\n]*{table}\.parquet", plan))


@pytest.mark.parametrize("rows", [1 << 20, 7])
def test_percentiles_equal_numpy(spark, rows):
    rng = np.random.default_rng(6)
    data = [("ties", float(v)) for v in rng.integers(0, 3, 200)] + [("mixed", float(v)) for v in rng.normal(size=101)] + [("one", 4.0), ("none", None), (None, 1.0), (None, 3.0), ("ends", float("inf")), ("ends", 1.0), ("ends", -float("inf"))]
    at = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r[0]: r for r in percentiles(spark.createDataFrame(data, "k string, v double"), "k", "v", at, rows).collect()}
    assert set(got) == {"ties", "mixed", "one", None, "ends"}
    for k in ("ties", "mixed", "one", None):
        values = [v for g, v in data if g == k]
        np.testing.assert_allclose(list(got[k])[1:], np.quantile(values, list(at.values())), atol=1e-12)
    assert got["ends"].p50 == 1.0 and got["ends"].p100 == math.inf and got["ends"].p0 == -math.inf


@pytest.mark.parametrize("limit", [1, 40])
def test_large_groups_compare_alike(spark, limit):
    long = q.metric_long(spark, SF)
    keys = ["object_id", "metric"]
    rows = [sorted(map(str, compare(long, keys, q.SPEC, limit=n).select(*keys, F.round("baseline_p99", 9), F.round("anomaly_value", 9)).collect())) for n in (1 << 20, limit)]
    assert rows[0] and rows[0] == rows[1]


def test_rates_and_samples_in_parts(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("event_type").alias("kpi_key"), F.col("ts").alias("time"), "event_id", "value")
    for drop in (False, True):
        found = [counter_rates(e, ["user_id"], F.col("kpi_key") != "view", F.lit("rate"), q.SPEC, tie="event_id", drop_first=drop, limit=n) for n in (1 << 20, 20)]
        assert len(found[0].columns) == 5
        a, b = (sorted(map(str, f.select("event_id", "kpi_key", F.round("value", 6)).collect())) for f in found)
        assert a == b
    picked = [sorted(r[0] for r in systematic_sample(e, n, "time", "event_id", rows=r).select("event_id").collect()) for n in (999, 7000) for r in (1 << 20, 300)]
    assert picked[0] == picked[1] and picked[2] == picked[3] and len(picked[0]) == 1000 - 1 and len(picked[2]) == 7000


def test_the_series_of_all_events_is_cut(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_id")
    s = series(e, [], ["ts", "event_id"], q.SMALL_PARTS)
    sizes = [r["count"] for r in s.rows.groupBy("__part").count().collect()]
    assert s.split and len(sizes) == 5 and max(sizes) < 2 * q.SMALL_PARTS


def test_one_scan_for_all_windows(spark):
    assert scans(q.incidents_compared(spark, SF), "events") == 1
    assert scans(q.incidents_log_activity(spark, SF), "events") == 1


def test_windows_equal_single_incidents(spark):
    """Each window of a table gives what WindowSpec.incident gives; ends touch, one is short, one lies within another, one is reversed."""
    t = datetime(2024, 1, 5)
    cases = [(0, t, t + timedelta(hours=2)), (1, t + timedelta(hours=1), t + timedelta(hours=1, seconds=5)), (2, t + timedelta(hours=2), t + timedelta(days=4)), (3, t, t + timedelta(hours=2)), (4, None, t)]
    table = incident_table(spark.createDataFrame(cases, "id int, start timestamp_ntz, end timestamp_ntz"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = {(r.id, r.event_id, r["__base"]) for r in in_windows(events, table, "ts").select("window.id", "event_id", "__base").collect()}
    want = set()
    for i, a, b in cases[:4]:
        spec = WindowSpec.incident(a, b)
        want |= {(i, r.event_id, True) for r in events.where(spec.in_baseline("ts")).collect()} | {(i, r.event_id, False) for r in events.where(spec.in_anomaly("ts")).collect()}
    assert got == want and len(want) > 1000
    assert in_windows(events, table.where("id = 4"), "ts").count() == 0
