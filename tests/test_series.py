"""Windows over split series equal those over whole ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.operators.series import series


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 3000
    hot = rng.random(n) < 0.7
    rows = [(None if i % 97 == 0 else "hot" if h else f"k{i % 5}", None if i == 3 else int(t), i, None if i % 11 == 0 else float(v)) for i, (h, t, v) in enumerate(zip(hot, rng.integers(0, 900, n), rng.normal(size=n)))]
    return spark.createDataFrame(rows, "k string, t int, id int, v double").cache()


@pytest.fixture(scope="module")
def sorted_rows(frame):
    p = frame.toPandas()
    p["t"] = p.t.fillna(-1)
    p["k"] = p.k.fillna("none")
    return p.sort_values(["k", "t", "id"]).reset_index(drop=True)


@pytest.mark.parametrize("rows", [10_000, 130])
def test_running_and_shifted(frame, sorted_rows, rows):
    s = series(frame, ["k"], ["t", "id"], rows)
    assert s.split == (rows < 1000)
    s = s.running({"total": ("sum", F.col("v")), "n": ("count", F.lit(1)), "low": ("min", F.col("v")), "bits": ("xor", F.col("id"))})
    s = s.shifted({"was": F.col("v")}).shifted({"next": F.col("v")}, ahead=True).whole({"all": F.count(F.lit(1))})
    if s.split:
        assert s.rows.select("__part").distinct().count() >= 20
    got = s.plain.toPandas().sort_values("id").reset_index(drop=True)
    assert len(got) == 3000
    p, by = sorted_rows.copy(), sorted_rows.groupby("k")
    p["total"] = by.v.transform(lambda x: x.fillna(0).cumsum())
    p["n"] = by.cumcount() + 1
    p["low"] = by.v.transform(lambda x: x.cummin().ffill())
    p["bits"] = by.id.transform(lambda x: np.bitwise_xor.accumulate(x.to_numpy()))
    p["was"], p["next"], p["all"] = by.v.shift(1), by.v.shift(-1), by.id.transform("size")
    p = p.sort_values("id").reset_index(drop=True)
    for c in ("n", "bits", "all"):
        assert (got[c] == p[c]).all(), c
    for c in ("low", "was", "next"):
        pd.testing.assert_series_equal(got[c], p[c], check_names=False)
    seen = got.total.notna()
    np.testing.assert_allclose(got.total[seen], p.total[seen], atol=1e-9)


def test_one_series_without_keys_and_empty(spark, frame):
    s = series(frame, [], ["id"], 100).running({"n": ("count", F.lit(1))})
    assert [r[0] for r in s.plain.orderBy("id").select("n").collect()] == list(range(1, 3001))
    assert series(frame.limit(0), ["k"], ["id"]).running({"n": ("count", F.lit(1))}).plain.count() == 0


def test_parts_do_not_grow_with_rows(spark, frame, monkeypatch):
    monkeypatch.setattr("faultline.operators.series.SMALL_PARTS", 40)
    s = series(frame, [], ["id"], 2).running({"n": ("count", F.lit(1))})
    assert s.split and 10 < s.rows.select("__part").distinct().count() <= 40
    assert [r[0] for r in s.plain.orderBy("id").select("n").collect()] == list(range(1, 3001))
    monkeypatch.setattr("faultline.operators.series.PART_ROWS", 50)
    assert series(frame, [], ["id"], 2).rows.select("__part").distinct().count() > 40
