from datetime import UTC, datetime, timedelta

from faultline.functions import expressions as ex
from faultline.functions.html import html_text
from faultline.plans.windows import WindowSpec, find_range, parse_time, range_columns
from pyspark.sql import functions as F


def test_incident_windows():
    s = WindowSpec.incident("2025-06-05T16:00:00Z", "2025-06-05T16:10:00Z")
    assert (s.baseline_start, s.baseline_end) == (datetime(2025, 6, 5, 15, 45, tzinfo=UTC), datetime(2025, 6, 5, 15, 55, tzinfo=UTC)) and s.minutes == 10
    short = WindowSpec.incident("2025-06-05T16:00:00Z", "2025-06-05T16:00:30Z")
    assert short.end - short.start == timedelta(seconds=120) and short.start.minute == 0
    early = WindowSpec.incident("2025-06-05T16:00:00Z", "2025-06-05T16:00:30Z", before=True)
    assert (early.start, early.end) == (datetime(2025, 6, 5, 15, 58, tzinfo=UTC), datetime(2025, 6, 5, 16, 0, tzinfo=UTC))
    assert WindowSpec.logs("2025-06-05T16:00:00Z", "2025-06-05T16:10:00Z").baseline_end == datetime(2025, 6, 5, 16, 0, tzinfo=UTC)
    assert parse_time("2025-06-05 16:00:00+08:00") == datetime(2025, 6, 5, 8, tzinfo=UTC)


def test_ranges_in_text(spark):
    a, b = "2025-06-05T16:00:00Z", "2025-06-05T16:10:00Z"
    texts = [f"x from {a} to {b}", f"between {a} and {b}", f"{a} to {b}", f"during {a} to {b}", "none"]
    want = [(a, b)] * 4 + [(None, None)]
    assert [find_range(t) for t in texts] == want
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [(r[0], r[1]) for r in df.orderBy("i").select(*range_columns(F.col("t"))).collect()] == want


def one(spark, column, **values):
    cols = [F.lit(v).cast("double").alias(k) if isinstance(v, (int, float)) and not isinstance(v, bool) else F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("x")).first()["x"]


def test_rules_at_their_bounds(spark):
    c = {k: F.col(k) for k in "abst"}
    spike = ex.spike(c["a"], c["b"], c["s"], c["a"] > 0.01)
    assert [one(spark, spike, a=a, b=1, s=0.05) for a in (1.1, 1.2, 1.21)] == [False, False, True]
    assert one(spark, spike, a=0.02, b=0, s=0) is True and one(spark, spike, a=0.01, b=0, s=0) is False
    rises = ex.rises(c["a"], c["b"], c["s"])
    assert [one(spark, rises, a=a, b=b, s=s) for a, b, s in ((0, 0, 0), (1, 0, 0), (1.5, 1, 0), (1.51, 1, 0), (4, 1, 1), (4.1, 1, 1), (0.016, 0.01, 0))] == [False, True, False, True, False, True, False]
    falls = ex.falls(c["a"], c["b"], c["s"])
    assert [one(spark, falls, a=a, b=b, s=s) for a, b, s in ((0.5, 1, 0), (0.49, 1, 0), (0, 0, 0), (-2, 1, 1), (-2.1, 1, 1))] == [False, True, False, False, True]
    assert [one(spark, ex.usage_severity(c["a"], "minor"), a=a) for a in (0.85, 0.95, 85, 95, 0.5, 1.1)] == ["major", "critical", "major", "critical", "minor", "critical"]
    assert [one(spark, ex.change_percentage(c["a"], c["b"]), a=a, b=b) for a, b in ((1, 0), (0.001, 0), (3, 2))] == [99999.0, 0.0, 50.0]
    assert [one(spark, ex.format_bytes(c["a"]), a=a) for a in (1.0, 2048, 3 * 1024**2, 5 * 1024**3)] == ["1.00 B", "2.00 KB", "3.00 MB", "5.00 GB"]


def test_templates(spark):
    cases = {
        "plain": "plain",
        "at 10.0.0.1 id deadbeef99 n 42 https://a.b/c": "at <IP> id <HASH> n <NUM> <URL>",
        '{"b": 1, "a": 2}': "a_b",
        '{"message": "code 5", "x": 1}': "code <NUM>",
        '{"message": 7, "x": 1}': "message_x",
        '{"message": "{\\"message\\": \\"deep 3\\"}"}': "deep <NUM>",
        "[1, 2]": "[ <NUM> , <NUM> ]",
        "x" * 200: "x" * 120,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "m string")
    got = {r["m"]: r["t"] for r in df.select("m", ex.log_template(F.col("m")).alias("t")).collect()}
    assert got == cases | {None: "non-string log message"}


def test_html(spark):
    html = "<html><head><style>p{}</style><script>x<y</script></head><body><nav>menu</nav><p>A &amp;\n B</p><footer>f</footer></body></html>"
    assert one(spark, html_text(F.col("h")), h=html) == "A & B"


def test_percentiles_and_ranks_of_skewed_groups(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from faultline.operators.compare import numbered, percentiles, systematic_sample

    rng = np.random.default_rng(2)
    rows = [("hot", float(np.round(x, 1))) for x in rng.pareto(1.2, 3000)] + [("one", 5.0), ("two", 1.0), ("two", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, y double").repartition(5)
    got = {r["g"]: (r["a"], r["b"]) for r in percentiles(df, "g", "y", {"a": 0.25, "b": 0.9}).collect()}
    for g in ("hot", "one", "two"):
        own = [y for h, y in rows if h == g]
        np.testing.assert_allclose(got[g], np.quantile(own, [0.25, 0.9]))
    assert "none" not in got
    ranks = numbered(df.where("y is not null"), F.col("y"), [F.col("y")], ["g"]).where("g = 'hot'").select("__rank").collect()
    assert sorted(r[0] for r in ranks) == list(range(1, 3001))
    times = spark.range(1000).select(F.timestamp_seconds(F.col("id") * 7 % 1000).alias("time"), "id").repartition(3)
    kept = systematic_sample(times, 100, "time")
    assert sorted(r["id"] * 7 % 1000 for r in kept.collect()) == list(range(0, 1000, 10))
    assert systematic_sample(times, 600, "time").count() == 600 and systematic_sample(times.limit(0), 5, "time").count() == 0
