"""Mined negatives against brute force and SQL."""

import duckdb
import numpy as np
import pytest

from faultline.llm.hard_negatives import ORACLE, Block, _packed, hard_negatives, kth, rotation
from faultline.llm.shared import table

SF = "/root/testdata/sf0.01"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows):
    """rows: (vec_id, embedding, label), ids may repeat; integers without bounds."""
    own = [(i, (l + 1) % 10 if i % 7 == 0 else l, [int(np.floor(256 * float(x))) for x in v], n) for n, (i, v, l) in enumerate(rows) if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in own:
        if a[0] % 100:
            continue
        score = lambda c: sum(x * y for x, y in zip(a[2], c[2]))
        met = [(-score(c), c[0], c[1]) for c in own if c[3] != a[3] and len(c[2]) == len(a[2])]
        for s, i, _ in sorted(m for m in met if m[2] == a[1])[:5]:
            fits = sorted(m for m in met if m[2] != a[1] and 80 * -s <= 100 * -m[0] <= 100 * -s)[:5]
            out += [(a[0], i, r, m[1], -s, -m[0]) for r, m in enumerate(fits, 1)]
    return sorted(out)


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, 1, "x") for i, v, l in rows], "vec_id long, embedding array<double>, label int, row int, block string")


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.sql(ORACLE)
    assert want.columns == COLUMNS
    assert got(hard_negatives(table(spark, SF, "embeddings"))) == sorted(want.fetchall())


def test_groups_of_copies_and_ties(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(60, 12)) * 3, 20, axis=0)
    x[::2] += rng.normal(size=(600, 12)) * 0.01
    x[400:800] = x[400]  # a third are copies
    rows = [(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, rng.integers(0, 3, 1200)))]
    want = plain(rows)
    assert want and got(hard_negatives(frame(spark, rows))) == want


def test_odd_rows(spark):
    nan, inf, big = float("nan"), float("inf"), 1e300
    odd = [(0, None, 1), (100, [nan, 1], 1), (200, [inf, 1], 1), (300, [None, 1], 1), (None, [1, 1], 1), (400, [1, 1], None)]
    rows = [(500, [1, 1], 1), (1, [1, 1], 1), (1, [1, 1], 1), (2, [1, 0.9], 2), (3, [0.9, 0.9], 2), (4, [1, 1], 2), (600, [0, 0], 3), (5, [0, 0], 3), (6, [0, 0], 4), (900, [], 1), (8, [], 1), (9, [], 2), (800, [-1, 0], 5), (10, [1, 0.0], 5), (11, [-1, 0.0], 6), (500, [1, 1], 1)]
    assert got(hard_negatives(frame(spark, odd + rows))) == plain(rows)
    assert got(hard_negatives(frame(spark, [(1000, [big, big], 1), (1001, [big, 1], 1), *rows]))) == plain(rows)
    assert hard_negatives(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1, 2**18])
def test_stages_discard_and_keep_the_best(spark, scale):
    """Most rows go before their last component, whatever their size, and none of the best does."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 48)) * (0.8 ** np.arange(48)) * scale
    df = spark.createDataFrame([(i, i, 1, 0, [int(np.floor(256 * y)) for y in v]) for i, v in enumerate(x)], "row long, vec_id long, label long, block int, v array<long>")
    v = np.floor(256 * x).astype(np.int64)
    packed = _packed(df, spark.sparkContext.broadcast(rotation(v))).first().asDict()
    block = Block(packed, 48)
    left = 0
    for j in range(0, 900, 50):
        at = np.arange(900)
        at = block.survivors(block, j, at, block.y[:, :8] @ block.y[j, :8], lambda low, high: high >= kth(low, 5))
        best = np.lexsort((np.arange(900), -(v @ v[j])))[:5]
        assert set(best) <= set(at)
        assert block.scored(block, j, at)[0][:5].tolist() == best.tolist()
        left += len(at)
    assert left < 18 * 12
