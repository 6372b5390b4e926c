"""DBSCAN and the local outlier factor against brute force."""

import numpy as np
import pytest

from faultline.operators import density, graph
from faultline.operators.density import dbscan, local_outlier_factor
from faultline.operators.graph import connected, reachable
from faultline.plans.diagnosis import chain_causes


def plain_dbscan(ids, x, eps, least):
    near = np.square(x[:, None] - x[None]).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label = {}
    for i in np.flatnonzero(core):
        if i in label:
            continue
        todo, seen = [i], {i}
        while todo:
            p = todo.pop()
            for j in np.flatnonzero(near[p] & core):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(ids[j] for j in seen)
        label |= {j: low for j in seen}
    out = {}
    for i in range(len(x)):
        mine = [label[j] for j in np.flatnonzero(near[i] & core)]
        out[ids[i]] = (bool(core[i]), label[i] if core[i] else min(mine, default=None))
    return out


def plain_lof(x, k):
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(2))
    np.fill_diagonal(d, np.inf)
    kth = np.sort(d, 1)[:, min(k, len(x) - 1) - 1]
    near = d <= kth[:, None]
    reach = np.where(near, np.maximum(d, kth[None]), 0).sum(1) / near.sum(1)
    lrd = 1 / (reach + 1e-10)
    return (near * lrd).sum(1) / near.sum(1) / lrd


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(ids, x)], "id long, " + ", ".join(f"x{a} double" for a in range(x.shape[1])))


def blobs(rng, dim):
    centres = rng.normal(size=(4, dim)) * 6
    x = np.concatenate([c + rng.normal(size=(n, dim)) * s for c, n, s in zip(centres, (300, 60, 40, 20), (0.02, 0.3, 0.6, 2.0))])
    return np.concatenate([x, np.repeat(x[:2], 12, axis=0)])


@pytest.mark.parametrize("dim, tried", [(1, 4096), (2, 4096), (2, 20), (3, 100)])
def test_dbscan(spark, monkeypatch, dim, tried):
    monkeypatch.setattr(density, "TRIED", tried)
    rng = np.random.default_rng(dim)
    x = blobs(rng, dim)
    ids = rng.permutation(len(x)) * 3
    got = {r.id: (r.core, r.cluster) for r in dbscan(frame(spark, ids, x), "id", [f"x{a}" for a in range(dim)], 0.3, 6).collect()}
    want = plain_dbscan(ids.tolist(), x, 0.3, 6)
    assert got == want
    assert len({c for _, c in want.values()}) >= (2 if dim == 1 else 3)


@pytest.mark.parametrize("dim, k", [(1, 4), (2, 5), (3, 15)])
def test_local_outlier_factor(spark, dim, k):
    rng = np.random.default_rng(dim)
    x = blobs(rng, dim)
    got = {r.id: r.lof for r in local_outlier_factor(frame(spark, range(len(x)), x), "id", [f"x{a}" for a in range(dim)], k).collect()}
    want = plain_lof(x, k)
    assert len(got) == len(x)
    np.testing.assert_allclose([got[i] for i in range(len(x))], want, rtol=1e-6)
    assert want.max() > 2


def test_few_and_odd_points(spark):
    nan, inf = float("nan"), float("inf")
    odd = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, nan, 0.0), (4, inf, 0.0), (5, None, 1.0), (None, 0.0, 0.0), (6, 9.0, 9.0)], "id long, x0 double, x1 double")
    assert {tuple(r) for r in dbscan(odd, "id", ["x0", "x1"], 1.0, 2).collect()} == {(1, True, 1), (2, True, 1), (6, False, None)}
    assert {r.id for r in local_outlier_factor(odd, "id", ["x0", "x1"], 5).collect()} == {1, 2, 6}
    assert local_outlier_factor(odd.where("id = 6"), "id", ["x0", "x1"], 5).count() == 0
    for f in (lambda d: dbscan(d, "id", ["x0"], 1.0, 2), lambda d: local_outlier_factor(d, "id", ["x0"], 2)):
        assert f(odd.limit(0)).count() == 0


def test_graph(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (4, 4)], "a int, b int")
    assert {tuple(r) for r in connected(links).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (4, 4)}
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", None)], "src string, dst string")
    starts = spark.createDataFrame([("a",), ("d",), (None,), ("z",)], "start string")
    assert {tuple(r) for r in reachable(starts, calls).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("d", "d", 0), ("z", "z", 0)}


def plain_chain_causes(full, odd, calls, most):
    def ahead(start):
        hops, last = {start: 0}, [start]
        for n in range(1, most + 1):
            last = {b for a, b in calls if a in last} - hops.keys()
            hops |= dict.fromkeys(last, n)
        return hops

    of = {n: ahead(n) for n in full | odd}
    ends = [e for e in full if not (of[e].keys() & (full | odd)) - {e}]
    far = {e: [of[o][e] for o in odd if o != e and e in of[o]] for e in ends}
    return {(e, len(h), min(h)) for e, h in far.items() if h}


@pytest.mark.parametrize("most", [None, 60])
def test_long_chains_end_in_causes(spark, monkeypatch, most):
    """A chain of 70 calls with a way back and a loop at its end, and a random graph; with more sources than a row has bits."""
    monkeypatch.setattr(graph, "WORDS", 1)
    rng = np.random.default_rng(0)
    calls = {(f"c{i}", f"c{i + 1}") for i in range(70)} | {("c9", "c2"), ("c70", "c70")} | {(f"r{a}", f"r{b}") for a, b in rng.integers(0, 300, (330, 2))} | {("c1", f"r{i}") for i in range(40)} | {(f"x{i}", "hub") for i in range(100)}
    full = {"c70", "hub", "alone", "c0"} | {f"r{i}" for i in range(0, 300, 9)}
    odd = {"c0", "c3", "c30", "c70", "nowhere"} | {f"r{i}" for i in range(0, 300, 7)} | {f"x{i}" for i in range(100)}
    want = plain_chain_causes(full, odd, calls, most or 1000)
    assert ("c70", 1 if most else 3, 40) in want
    assert ("hub", 100, 1) in want and len(want) > 5
    found = spark.createDataFrame([("infra", c, "critical") for c in sorted(full)] + [("service", c, "minor") for c in sorted(odd)] + [("infra", "c5", "minor"), ("logs", None, "critical")], "source string, component string, severity string")
    table = spark.createDataFrame([*sorted(calls), *sorted(calls)[:9], ("c1", None), (None, "c1")], "src string, dst string")
    assert {tuple(r) for r in chain_causes(found, table, most).collect()} == want
