import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from faultline.llm.quality import DIM, N_FEATURES, ROWS, fit, pooled, quality_scores, token_rows, train, with_quality, word_vectors
from faultline.llm.shared import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_fold(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r["doc_id"]: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in got}
    assert all(got[d]["held_out"] == held[d] for d in got)
    truth = [(r["quality"], got[r["doc_id"]]["score"]) for r in labels.collect() if held[r["doc_id"]]]
    low, high = [s for q, s in truth if q == 0], [s for q, s in truth if q == 1]
    assert np.mean([(a < b) + 0.5 * (a == b) for a in low for b in high]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "some words", "c"), (4, "word " * 50_000, "d"), (4, "word " * 50_000, "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (9, 1)], "doc_id long, quality int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == 5 and all(r["score"] == 0.5 for r in got)
    assert quality_scores(docs.limit(0), labels).count() == 0
    kept = with_quality(docs.withColumn("row", F.lit(1)).withColumn("a.b", F.lit(2)), labels)
    assert kept.columns == ["row", "score"] and kept.count() == 5
    assert kept.select("row.*").columns == ["doc_id", "text", "score", "row", "a.b"]


def test_a_doc_id_that_many_rows_share_is_learnt_once(spark):
    rows = [(k, f"text number {k} of many") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    vectors = np.random.default_rng(1).normal(size=(ROWS, DIM)).astype(np.float32)
    nets = [train(spark.createDataFrame(x, "doc_id long, text string"), labels, vectors) for x in (rows, rows + rows[:3] * 40)]
    np.testing.assert_array_equal(nets[0].w1, nets[1].w1)


def test_word_vectors_follow_the_contexts(spark):
    """A brute-force sum over the windows of every text gives the same table."""
    texts = ["a b c a", "b b c", "", "a"]
    from faultline.llm.quality import WINDOW, index_vectors

    index = index_vectors()
    dense = np.zeros((ROWS, DIM))
    for r in range(ROWS):
        for at, sign in index[r]:
            dense[r, at] += sign
    want = np.zeros((ROWS, DIM))
    for t in texts:
        rows = token_rows(pa.array([t]))[0]
        for i, r in enumerate(rows):
            for j in range(max(0, i - WINDOW), min(len(rows), i + WINDOW + 1)):
                if i != j:
                    want[r] += dense[rows[j]]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    got = word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    np.testing.assert_allclose(got, want / np.where(norm > 0, norm, 1), atol=1e-6)


def test_pooling_and_temperature():
    assert pooled(pa.array([], pa.string()), np.zeros((1, 1))).shape == (0, N_FEATURES)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, N_FEATURES))
    y = (x[:, 0] + 0.5 * rng.normal(size=800) > 0).astype(float)
    net = fit(x, y)
    p = net.scores(x)
    assert np.mean((p > 0.5) == y) > 0.8 and abs(p.mean() - y.mean()) < 0.1
