import numpy as np
import pytest

from faultline.llm.mixing import apply_rates, fit_rates, soft_mixture
from faultline.llm.queries import TARGETS, labelled_domains
from faultline.llm.shared import table

SF = "/root/testdata/sf0.01"


def brute_rates(n, p, target, scale, low, steps=20_000):
    """Plain projected gradient, to the end."""
    r = np.full(len(n), max(1.0, low))
    for _ in range(steps):
        r = np.maximum(low, r - p @ (((n * r) @ p - target) / scale))
    return r


@pytest.mark.parametrize("low", [0.0, 0.4])
def test_rates_match_brute_force(spark, low):
    """The bound of 0.4 puts the targets out of reach; then the totals are unique, the rates are not."""
    rng = np.random.default_rng(4)
    n = rng.integers(0, 200, 60)
    p = rng.dirichlet([0.2, 0.2, 0.2], 60)
    weights = [0.6, 0.3, 0.1]
    frame = spark.createDataFrame([(int(a), 1, [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, n_rows long, p array<double>").coalesce(1)
    got = np.array([r["rate"] for r in fit_rates(frame, weights, budget=float(n.sum()), min_rate=low).collect()])
    want = brute_rates(n, p, n.sum() * np.array(weights), n @ p, low)
    np.testing.assert_allclose((n * got) @ p, (n * want) @ p, rtol=2e-3)
    if low == 0:
        np.testing.assert_allclose(got, want, atol=1e-3)
    assert got.min() >= low


def test_expected_totals_match_targets(spark):
    out = soft_mixture(table(spark, SF, "documents"), labelled_domains(spark, SF), TARGETS).toPandas()
    lang = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    domains = sorted(TARGETS)
    p = out[[f"p_{d}" for d in domains]].to_numpy()
    np.testing.assert_allclose(p.sum(1), 1, atol=1e-9)
    mass = (out.n_tokens * out.n_rows * out.rate).to_numpy() @ p
    np.testing.assert_allclose(mass / mass.sum(), [TARGETS[d] for d in domains], atol=2e-3)
    right = [domains[k] == lang[d] for k, d, n in zip(p.argmax(1), out.doc_id, out.n_tokens) if n >= 20]
    assert np.mean(right) > 0.95 and (out.rate >= 0).all()


def test_rates_take_effect(spark):
    docs = table(spark, SF, "documents")
    rates = soft_mixture(docs, labelled_domains(spark, SF), TARGETS, min_rate=1.0)
    mixed = apply_rates(docs, rates)
    assert mixed.columns == docs.columns
    count = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for r in rates.collect():
        assert 1 <= int(r["rate"]) <= count[r["doc_id"]] <= int(r["rate"]) + 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "der die das", "c"), (4, "the of and", "d"), (4, "the of and", "d"), (5, "x" * 100_000, "e")], "doc_id long, text string, rate string")
    labelled = spark.createDataFrame([(4, "en"), (9, "de"), (5, None)], "doc_id long, domain string")
    out = soft_mixture(docs, labelled, {"en": 0.5, "de": 0.5, "zz": None}).collect()
    assert sorted((r["doc_id"] or 0, r["n_rows"], r["n_tokens"]) for r in out) == [(0, 1, 3), (1, 1, 0), (2, 1, 0), (4, 2, 3), (5, 1, 1)]
    assert apply_rates(docs, spark.createDataFrame(out).withColumn("rate", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1.0))).count() == 6
    assert soft_mixture(docs.limit(0), labelled, {"en": 1.0}).count() == 0
