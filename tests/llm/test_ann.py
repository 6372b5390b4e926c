import numpy as np

from faultline.llm.ann import Codebook, anisotropic_weight, exact_nearest, nearest
from faultline.llm.shared import table

SF = "/root/testdata/sf0.01"


def recall(got, want):
    a, b = ({(r.query_id, r.vec_id) for r in x.itertuples()} for x in (got, want))
    return len(a & b) / len(b)


def test_recall_against_brute_force(spark):
    vectors = table(spark, SF, "embeddings")
    rows = vectors.toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(np.float64)
    want = exact_nearest(ids, x, ids[ids % 50 == 0])
    got = nearest(vectors).toPandas().sort_values(["query_id", "rank"])
    assert len(got) == len(want) and recall(got, want) >= 0.95
    both = got.merge(want, on=["query_id", "vec_id"])
    np.testing.assert_allclose(both.score_x, both.score_y, atol=1e-12)


def test_copies_do_not_crowd_out(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16))
    x[100:800] = x[100]  # a large group of copies
    ids = np.arange(900) * 5
    frame = spark.createDataFrame([(int(i), [float(np.float32(y)) for y in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    want = exact_nearest(ids, x.astype(np.float32), ids[ids % 50 == 0])
    got = nearest(frame).toPandas().sort_values(["query_id", "rank"])
    assert recall(got, want) >= 0.95
    hot = got[(got.query_id > 500) & (got.query_id < 4000)]
    assert (hot.groupby("query_id").vec_id.apply(list) == hot.groupby("query_id").query_id.first().map(lambda q: [i for i in range(500, 540, 5) if i != q][:5])).all()


def test_a_dense_group_is_searched_whole(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    x[:1000] = x[0] + 1e-4 * rng.normal(size=(1000, 16))  # near copies that four bits cannot tell apart
    x[1000:2000] = x[1000] * rng.uniform(0.5, 2, 1000)[:, None]  # scaled copies
    x = x.astype(np.float32)
    ids = np.arange(3000)
    got = nearest(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")).toPandas()
    want = exact_nearest(ids, x, ids[ids % 50 == 0])
    near = lambda f: f[~f.query_id.between(1000, 1999)]
    assert recall(near(got), near(want)) >= 0.99
    scaled = got[got.query_id.between(1000, 1999)]  # all are ties but for the last bits
    assert len(scaled) == 100 and (scaled.score > 1 - 1e-6).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (50, None, 1), (100, [0.0, 0.0], 1), (150, [1.0, nan], 1), (200, [1.0, inf], 1), (250, [1.0, None], 1), (None, [1.0, 1.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 1.0], 1), (2, [1.0, 1.0], 1), (3, [1.0], 1), (4, [], 1), (300, [2.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in nearest(frame).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 2), (300, 1, 3)] and abs(got[1][3] - 0.5**0.5) < 1e-12
    assert nearest(frame.limit(0)).count() == 0


def test_rows_that_share_an_id_are_all_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.9, 0.5]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (0, [0.0, 2.0])]
    got = [tuple(r) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert [(r, v) for q, r, v, s in sorted(got) if q == 0] == [(1, 1), (1, 2), (2, 1), (2, 1), (3, 1), (3, 1), (4, 0), (4, 1), (5, 0), (5, 2)]
    assert sorted(round(s, 3) for _, r, _, s in got if r == 1) == [0.995, 1.0]


def test_sql_gives_the_same_rows(spark):
    import duckdb

    from faultline.llm.queries import op7_nearest, oracle_sql

    duckdb.sql(f"create or replace view embeddings as select * from '{SF}/embeddings.parquet'")
    want = duckdb.sql(oracle_sql()["op7_nearest"])
    got = op7_nearest(spark, SF)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


def test_the_loss_weighs_the_parallel_error():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    error = []
    for eta in (1.0, anisotropic_weight(32, 0.5)):
        book = Codebook(x, 16, eta)
        codes = book.assign(book.padded(x))
        back = np.concatenate([book.words[s][codes[:, s]] for s in range(16)], 1)
        error.append(np.square(((x - back) * x).sum(1)).mean())
    assert error[1] < 0.7 * error[0]
