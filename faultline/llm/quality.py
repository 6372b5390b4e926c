"""Quality classifier (operator 10).

1. Random indexing: every word type (hashed into a fixed number of rows) has a sparse random
   index vector; a word's vector is the sum of the index vectors around it, over ALL documents.
   Forms that hardly occur twice (symbols, capitals throughout, a word that repeats the one before
   it, ...) share one type for each shape. Tasks sum into a table of fixed size and Spark adds the
   tables up, row by row.
2. A document is pooled: mean and spread of its words' vectors, nothing else.
3. A two-layer network in numpy learns from a bounded sample of labelled rows (`max_train`, the
   rows of smallest doc_id hash); a temperature is fitted on a part that the weights did not see.

Scores depend on the text alone. Held-out rows (crc32 of the doc_id as text, modulo 4, equal to
2) never reach the fit.

Defined results: null and empty texts get a score too (a pooled vector of zeros); labels that
are null or of unknown documents are ignored; repeated rows keep one result each; a null doc_id
is scored and counts as not held out but is never learnt from; without labels of both classes
every score is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.shared import texts_in_batches, whole_row
from faultline.llm.textkernel import U64, mix, slices, words

DIM, ROWS, NONZEROS, WINDOW = 32, 1 << 14, 2, 2
HELD_OUT = 2
SHAPES = ("all capitals", "mixed case", "symbols only", "symbol inside or after", "repeat", "bar", "long")


def token_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of each token's vector, texts' token offsets). Tokens end at white space; one that has a shape of SHAPES takes its row."""
    w = words(texts)
    raw, s, e = w.raw, w.starts, w.ends
    kinds = np.zeros((len(raw) + 1, 4), np.int32)
    upper, digit = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57)
    letter = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    plain = letter | digit | (raw == 0x2E) | (raw == 0x2C) | (raw <= 0x20)
    for k, m in enumerate((upper, digit, letter, ~plain)):
        np.cumsum(m, out=kinds[1:, k])
    up, dig, let, odd = (kinds[e] - kinds[s]).T
    first_up, bar = (upper[s], raw[s] == 0x7C) if len(s) else (np.zeros(0, bool), np.zeros(0, bool))
    h = w.hashes
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = h[1:] == h[:-1]
    same[w.offsets[:-1][w.counts > 0]] = False
    none = (let == 0) & (dig == 0)
    shape = np.select([same, none & bar, none, (let == 0), odd > 0, dig > 0, (up >= 2) & (up == let), (up > 1) | ((up == 1) & ~first_up), e - s > 24], [4, 5, 2, -1, 3, -1, 0, 1, 6], -1)
    row = (h >> U64(40)).astype(np.int64) % (ROWS - len(SHAPES))
    return np.where(shape >= 0, ROWS - len(SHAPES) + shape, row), w.offsets


def index_vectors() -> np.ndarray:
    """For each row, the positions and signs of its NONZEROS entries, as flat (position, sign)."""
    h = mix(np.arange(ROWS * NONZEROS, dtype=np.uint64) + U64(0x51ED270B))
    return np.stack([(h >> U64(8)).astype(np.int64) % DIM, 1 - 2 * (h & U64(1)).astype(np.int64)], 1).reshape(ROWS, NONZEROS, 2)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """ROWS x DIM word vectors of unit length (zero where a row met nothing), from all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros(ROWS * DIM, np.float64)
        for batch in batches:
            for i, j in slices(batch.column(0), 1 << 21):
                row, offs = token_rows(batch.column(0).slice(i, j - i))
                doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
                for d in range(1, WINDOW + 1):
                    if len(row) <= d:
                        break
                    near = doc[d:] == doc[:-d]
                    a, b = row[d:][near], row[:-d][near]
                    for at, other in ((a, b), (b, a)):
                        for z in range(NONZEROS):
                            total += np.bincount(at * DIM + index[other, z, 0], index[other, z, 1], ROWS * DIM)
        met = total.reshape(ROWS, DIM)
        kept = np.flatnonzero(np.abs(met).sum(1))
        yield pa.record_batch([pa.array(kept, pa.int32()), pa.array(list(met[kept].astype(np.int32)), pa.list_(pa.int32()))], ["row", "v"])

    parts = docs.select(F.col("text").cast("string")).mapInArrow(run, "row int, v array<int>")
    sums = parts.groupBy("row").agg(*[F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(DIM)])
    out = np.zeros((ROWS, DIM), np.float32)
    got = sums.toArrow()  # ROWS rows at most, whatever the input
    if got.num_rows:
        out[got.column("row").to_numpy()] = np.stack([got.column(f"v{k}").to_numpy() for k in range(DIM)], 1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


N_FEATURES = 2 * DIM


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row of features for each text: mean and spread of its tokens' vectors."""
    out = []
    for i, j in slices(texts, 1 << 19):
        row, offs = token_rows(texts.slice(i, j - i))
        n = np.diff(offs)
        f = np.zeros((j - i, N_FEATURES), np.float32)
        if len(row):
            # sums of each text by prefix sums over its tokens
            v = np.zeros((len(row) + 1, DIM), np.float64)
            np.cumsum(vectors[row], axis=0, dtype=np.float64, out=v[1:])
            mean = (v[offs[1:]] - v[offs[:-1]]) / np.maximum(n, 1)[:, None]
            np.cumsum(np.square(vectors[row]), axis=0, dtype=np.float64, out=v[1:])
            square = (v[offs[1:]] - v[offs[:-1]]) / np.maximum(n, 1)[:, None]
            f[:, :DIM], f[:, DIM:] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
        out.append(f)
    return np.concatenate(out) if out else np.zeros((0, N_FEATURES), np.float32)


@dataclass
class Network:
    """Two layers: tanh, then one logit; temperature divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 20, rate: float = 0.005, decay: float = 0.01, seed: int = 5) -> Network:
    """Adam on the cross entropy; every fifth row is kept back for the temperature."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    share = float(y.mean()) if len(y) else 0.5
    net = Network(x.mean(0) if len(y) else np.zeros(N_FEATURES), x.std(0) + 1e-3 if len(y) else np.ones(N_FEATURES), rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    if not len(y) or not 0 < share < 1:
        net.b2 = float(np.log((share * len(y) + 0.5) / ((1 - share) * len(y) + 0.5)))
        return net
    back = np.arange(len(y)) % 5 == 0
    if len(np.unique(y[back])) < 2 or len(np.unique(y[~back])) < 2:
        back = np.zeros(len(y), bool)
    z, t = (x[~back] - net.mean) / net.scale, y[~back]
    net.w2 = rng.normal(0, 1 / np.sqrt(hidden), hidden)
    parts = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for at in range(0, len(t), 256):
            i = order[at : at + 256]
            h = np.tanh(z[i] @ parts[0] + parts[1])
            g = (1 / (1 + np.exp(-np.clip(h @ parts[2] + parts[3], -40, 40))) - t[i]) / len(i)
            gh = np.outer(g, parts[2]) * (1 - h * h)
            step += 1
            for p, grad, m, v in zip(parts, (z[i].T @ gh + decay * parts[0], gh.sum(0), h.T @ g + decay * parts[2], g.sum(keepdims=True)), first, second, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = parts[0], parts[1], parts[2], float(parts[3][0])
    if back.any():
        logit, t = net.logits(x[back]), y[back]
        grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
        net.temperature = float(grid[np.argmin([np.mean(np.logaddexp(0, -np.where(t > 0, 1, -1) * logit / g)) for g in grid])])
    return net


def fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, max_train: int = 20_000) -> Network:
    """Learns from at most max_train labelled rows outside the held-out fold, those of smallest doc_id hash."""
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & (fold() != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    bound = F.broadcast(marked)  # max_train rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(list(pooled(b.column(2), vectors)), pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(bound, "doc_id")
    # a doc_id that many rows share is learnt once
    one = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<float>").toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0))
    x = np.stack(rows.column("x").to_pylist()).astype(np.float64)
    y, doc = rows.column("y").to_numpy(), rows.column("doc_id").to_numpy()
    order = np.lexsort((*x.T[:3], doc))  # the fit must not depend on the order in which rows arrive
    return fit(x[order], y[order])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    scored = with_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, max_train)
    return scored.select("row.doc_id", "score").select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def with_quality(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> DataFrame:
    """(row, score): row holds all columns of docs, under whatever names."""
    texts_in_batches(docs.sparkSession)
    vectors = word_vectors(docs)
    net = train(docs, labels, vectors, max_train)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))  # ROWS x DIM floats and the network: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(net.scores(pooled(_text_of(b.column(0)), vectors)), pa.float64())], ["row", "score"])

    source = docs.select(whole_row(docs))
    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())]))


def _text_of(rows: pa.StructArray) -> pa.Array:
    at = [rows.type.field(i).name for i in range(rows.type.num_fields)].index("text")
    return pc.cast(rows.field(at), pa.string())
