"""Abnormal trends, and which insights a chart shows."""

import numpy as np
import pandas as pd
import pytest

from faultline.operators import insights as ins
from faultline.operators.insights import trend_break


def plain(x, y, least=3):
    def sse(i, j):
        design = np.stack([x[i:j], np.ones(j - i)], 1)
        return np.square(y[i:j] - design @ np.linalg.lstsq(design, y[i:j], rcond=None)[0]).sum()

    two, at = min((sse(0, i) + sse(i, len(x)), x[i]) for i in range(least, len(x) - least + 1))
    return at, 1 - two / sse(0, len(x))


@pytest.mark.parametrize("rows", [1 << 20, 25])
def test_breaks(spark, rows):
    rng = np.random.default_rng(0)
    x = np.arange(100.0) + 1e6
    noise = rng.normal(size=100)
    made = {"bent": np.where(x < 1e6 + 40, x, 2e6 + 80 - x) + noise, "step": np.where(x < 1e6 + 70, 5.0, 500.0) + noise, "line": 3 * x + noise}
    data = [(k, float(a), float(b)) for k, ys in made.items() for a, b in zip(x, ys)]
    data += [("flat", float(i), 7.0) for i in range(20)] + [("short", float(i), float(i % 2)) for i in range(5)] + [("gaps", None, 1.0), ("gaps", 1.0, None)]
    got = {r.k: r for r in trend_break(spark.createDataFrame(data, "k string, x double, y double"), "k", "x", "y", rows=rows).collect()}
    assert set(got) == set(made)
    for k, ys in made.items():
        since, explained = plain(x - 1e6, ys - ys.mean())
        assert got[k].since == since + 1e6
        np.testing.assert_allclose(got[k].explained, explained, rtol=1e-5)
    assert got["bent"].abnormal and got["step"].abnormal and not got["line"].abnormal
    assert got["bent"].slope_before > 0.9 and got["bent"].slope_after < -0.9


def test_choice_of_insights(spark):
    steps = [("step", i, 100.0 * (i >= 10) + i % 2) for i in range(20)]
    flat = [("flat", i, 5.0) for i in range(20)]
    one = [("one", 0, 3.0), ("none", None, 1.0)]
    df = spark.createDataFrame(steps + flat + one, "g string, x int, y double")
    all_ = ins.scored(df, "g", "x", "y")
    got = {g: [r for r in ins.best(all_, "g").orderBy("place").collect() if r["g"] == g] for g in ("step", "flat", "one", "none")}
    assert len(got["step"]) == 6 and [r["place"] for r in got["step"]] == [1, 2, 3, 4, 5, 6]
    kinds = [r["insight"] for r in got["step"]]
    assert len(set(kinds)) == 6 and len({"pearson", "spearman"} & set(kinds)) == 1
    assert all(0 <= r["strength"] <= 1 for r in all_.collect())
    jump = next(r for r in got["step"] if r["insight"] == "abnormal_trend")
    assert jump["at"] == 10.0 and jump["strength"] > 0.99
    assert {r["insight"] for r in got["flat"]} == {"volatility"} and got["flat"][0]["strength"] == 0  # a line at rest has no other
    assert [r["insight"] for r in got["one"]] == ["majority"] and got["none"] == []
    assert ins.best(ins.scored(df.limit(0), "g", "x", "y"), "g").count() == 0
    ties = spark.createDataFrame([("a", k, x, 0.5) for k in ("b", "a", "pearson", "spearman") for x in (2.0, 1.0)], "g string, insight string, at double, strength double")
    assert [(r["insight"], r["at"]) for r in ins.best(ties, "g").orderBy("place").collect()] == [("a", 1.0), ("b", 1.0), ("pearson", 1.0)]


def test_series_at_rest_and_sums_of_zero(spark):
    df = spark.createDataFrame([("rest", i, 5.0) for i in range(4)] + [("zero", i, v) for i, v in enumerate((-1.0, 1.0, -2.0, 2.0))] + [("null", 1, None), ("null", 2, None)], "g string, x int, y double")
    value = lambda d, c: {r["g"]: r[c] for r in d.collect()}
    assert value(ins.pearson(df, "g", "x", "y"), "pearson")["rest"] is None and value(ins.spearman(df, "g", "x", "y"), "spearman")["rest"] is None
    assert value(ins.statistics(df, "g", "y"), "volatility")["zero"] is None
    assert ins.majority(df, "g", "y", "x").count() == 0
    assert ins.difference_outliers(df.where("g = 'rest'"), "g", "x", "y").count() == 0 and ins.page_hinkley(df, "g", "x", "y").count() == 0


@pytest.mark.parametrize("few, swapped", [(100_000, False), (3, False), (3, True)])
def test_spearman_of_ties_and_nulls(spark, monkeypatch, few, swapped):
    """Whichever column has few values, or none has."""
    monkeypatch.setattr(ins, "FEW_VALUES", few)
    rng = np.random.default_rng(3)
    made = [(g, int(a), None if i % 50 == 0 else float(b)) for i, (g, a, b) in enumerate(zip(["a", "b", None] * 300, rng.integers(0, 7, 900), rng.normal(size=900).round(2)))]
    df = spark.createDataFrame(made, "g string, x int, y double")
    got = {r.g: r.spearman for r in ins.spearman(df, "g", *(("y", "x") if swapped else ("x", "y")), rows=40).collect()}
    p = pd.DataFrame(made, columns=["g", "x", "y"])
    p["g"], p["y"] = p.g.fillna("none"), p.y.fillna(-1e9)
    for g, rows in p.groupby("g"):
        np.testing.assert_allclose(got[None if g == "none" else g], rows.x.rank().corr(rows.y.rank()), rtol=1e-12)
    assert len(got) == 3
