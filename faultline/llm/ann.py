"""Approximate nearest neighbours with score-aware anisotropic quantisation (operator 7).

Vectors are scaled to length 1, so that the largest inner product is the largest cosine.

1. Codebooks. `sub` subspaces (by default one for each component) with 16 codewords each, from a bounded sample
   (`max_train`, the vectors of smallest vec_id hash). The loss weighs the residual parallel to
   the vector ETA times as much as the rest, as errors along the vector are what moves large inner
   products: codewords solve the weighted least squares of their members, members choose
   codewords by coordinate descent over the whole residual.
2. Index. Every vector is encoded to `sub` four-bit codes, two to a byte, and kept in blocks with
   the vectors themselves. Equal vectors are coded once: of each, the k + 1 rows of smallest id are
   enough for any answer, since ties go to the smaller id.
3. Scan. Every query block meets every index block. Table entries for each byte of code add up to
   a score. A query keeps, of a block, the `rerank` best and whatever comes as near to its k-th best
   as MARGIN standard errors of the codes, ties included; so a dense group of near or scaled copies,
   which the codes cannot tell apart, is kept whole.
4. Rerank. What is kept is scored exactly in double precision on the original vectors, in the same
   task; the k best of each query and block go on, and of those the k best of each query.

The scan costs queries x vectors; a task holds one index block and one query block.

Result: query_id, rank, vec_id, score for the queries' k nearest.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take
no part, nor do rows without an id; each other row is a candidate of every query but itself, also
if it shares its id or its vector with other rows, and each row whose id is divisible is a query;
vectors meet those of their own dimension; fewer than k candidates give all of them; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.llm.shared import saved

CODES = 16
THRESHOLD = 0.2
MAX_TRAIN = 10_000
#: Components of the vectors of a block, and rows of a block at most.
BLOCK_VALUES, INDEX_BLOCK, QUERY_BLOCK = 1 << 21, 1 << 13, 1 << 13
#: Standard errors of a scan's score (the codes' residual along one direction).
MARGIN = 3.0


class Codebook:
    """Four-bit product codes under the anisotropic loss, for vectors of length 1."""

    def __init__(self, x: np.ndarray, sub: int, eta: float, rounds: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.width = -(-x.shape[1] // sub)
        self.sub, self.eta, self.dim = sub, eta, x.shape[1]
        x = self.padded(x)
        pick = [rng.permutation(len(x))[np.arange(CODES) % len(x)] for _ in range(sub)]
        self.words = np.stack([x[p, s] + 1e-3 * rng.normal(size=(CODES, self.width)) for s, p in enumerate(pick)])
        for _ in range(rounds):
            self.update(x, self.assign(x))

    def padded(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.sub * self.width))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), self.sub, self.width)

    def assign(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent, from the plainly nearest ones."""
        cost = [np.square(x[:, s, None] - self.words[s]).sum(2) for s in range(self.sub)]
        along = [np.square(x[:, s]).sum(1)[:, None] - x[:, s] @ self.words[s].T for s in range(self.sub)]  # <x_s - c, x_s>
        codes = np.stack([c.argmin(1) for c in cost], 1)
        rows = np.arange(len(x))
        total = sum(along[s][rows, codes[:, s]] for s in range(self.sub))
        for _ in range(sweeps):
            for s in range(self.sub):
                rest = total - along[s][rows, codes[:, s]]
                codes[:, s] = (cost[s] + (self.eta - 1) * np.square(rest[:, None] + along[s])).argmin(1)
                total = rest + along[s][rows, codes[:, s]]
        return codes

    def update(self, x: np.ndarray, codes: np.ndarray) -> None:
        rows = np.arange(len(x))
        part = np.stack([((x[:, s] - self.words[s][codes[:, s]]) * x[:, s]).sum(1) for s in range(self.sub)], 1)
        for s in range(self.sub):
            rest = part.sum(1) - part[:, s]
            for c in range(CODES):
                m = rows[codes[:, s] == c]
                if len(m):
                    v = x[m, s]
                    left = len(m) * np.eye(self.width) + (self.eta - 1) * v.T @ v
                    self.words[s, c] = np.linalg.solve(left, v.sum(0) + (self.eta - 1) * ((rest[m] + np.square(v).sum(1))[:, None] * v).sum(0))
            part[:, s] = ((x[:, s] - self.words[s][codes[:, s]]) * x[:, s]).sum(1)

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Two codes to a byte, and the standard error of a scan's score: the root mean square of a residual's component."""
        x = self.padded(x)
        codes = self.assign(x)
        error = x - np.stack([self.words[s][codes[:, s]] for s in range(self.sub)], 1)
        codes = codes.astype(np.uint8)
        if self.sub % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
        return codes[:, ::2] | (codes[:, 1::2] << 4), float(np.sqrt(np.square(error).sum((1, 2)).mean() / self.dim))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte of code, the inner products of its 256 values."""
        t = np.einsum("qsw,scw->qsc", self.padded(q), self.words).astype(np.float32)
        if self.sub % 2:
            t = np.concatenate([t, np.zeros((len(q), 1, CODES), np.float32)], 1)
        return (t[:, ::2, None, :] + t[:, 1::2, :, None]).reshape(len(q), -1, CODES * CODES)


def anisotropic_weight(dim: int, threshold: float = THRESHOLD) -> float:
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v array<double>, norm) of the vectors that take part; row tells rows apart once the table is written."""
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    whole = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & whole)
    fine = own.withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return fine.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", "norm")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.square(x).sum(1))[:, None]


def _in_blocks(rows: DataFrame, n: int, size: int) -> tuple[DataFrame, int]:
    """rows with `block`, a hash of the row: blocks of about `size` rows, and their number."""
    n_blocks = max(1, math.ceil(n / size))
    return rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")), n_blocks


def _kept(near: np.ndarray, k: int, rerank: int, margin: float) -> np.ndarray:
    """Which scan scores of each query go on to the exact score."""
    if near.shape[1] <= rerank:
        return np.ones(near.shape, bool)
    parts = np.partition(near, (near.shape[1] - rerank, near.shape[1] - k - 1), axis=1)
    return near >= np.minimum(parts[:, -rerank], parts[:, -k - 1] - margin)[:, None]


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products with q, component by component in order, as SQL adds them up."""
    out = np.zeros(len(x))
    for j in range(len(q)):
        out += x[:, j] * q[j]
    return out


def nearest(vectors: DataFrame, k: int = 5, query_every: int = 50, rerank: int = 150, sub: int | None = None, max_train: int = MAX_TRAIN) -> DataFrame:
    """Queries are the vectors whose id is divisible by query_every; candidates are all others."""
    spark = vectors.sparkSession
    all_ = saved(usable(vectors), "ann-vectors")
    sizes = sorted((r["dim"], r["count"]) for r in all_.groupBy(F.size("v").alias("dim")).count().collect())  # a row for each dimension
    found = [_nearest(all_.where(F.size("v") == dim), dim, n, k, query_every, rerank, sub, max_train) for dim, n in sizes]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest(all_: DataFrame, dim: int, n: int, k: int, query_every: int, rerank: int, sub: int | None, max_train: int) -> DataFrame:
    """nearest() for n vectors of one dimension."""
    sample = all_.orderBy(F.xxhash64("vec_id"), "row").limit(max_train).select("v").toArrow()  # max_train vectors at most
    book = Codebook(_unit(_matrix(sample.column("v"), dim)), sub or dim, anisotropic_weight(dim))
    shared = all_.sparkSession.sparkContext.broadcast(book)
    size = max(1, BLOCK_VALUES // dim)

    # of equal vectors those of smallest id; vectors of another length have the same scan score and are kept as ties
    same = W.partitionBy("h", "v").orderBy("vec_id", "row")
    least = all_.withColumn("h", F.xxhash64("v")).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).select("row", "vec_id", "v", "norm")
    index, _ = _in_blocks(least, n, min(INDEX_BLOCK, size))

    def pack(rows: pa.Table) -> pa.Table:
        """One index block as the bytes of its arrays, in order of id."""
        rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        x = _matrix(rows.column("v"), dim)
        codes, error = shared.value.encoded(_unit(x))
        cols = [rows.column(c).to_numpy().tobytes() for c in ("row", "vec_id", "norm")]
        return pa.table({c: pa.array([v], pa.binary()) for c, v in zip(("row", "vec_id", "norm", "v", "codes"), (*cols, x.tobytes(), codes.tobytes()), strict=True)} | {"error": pa.array([error])})

    packed = saved(index.groupBy("block").applyInArrow(pack, "row binary, vec_id binary, norm binary, v binary, codes binary, error double"), "ann-index")
    queries = all_.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    blocks, n_query = _in_blocks(queries, queries.count(), min(QUERY_BLOCK, size))

    def gather(rows: pa.Table) -> pa.Table:
        cols = [rows.column(c).to_numpy().tobytes() for c in ("row", "vec_id", "norm")]
        return pa.table({"qblock": rows.column("block").slice(0, 1)} | {c: pa.array([v], pa.binary()) for c, v in zip(("qrow", "qid", "qnorm", "q"), (*cols, _matrix(rows.column("v"), dim).tobytes()), strict=True)})

    asked = saved(blocks.groupBy("block").applyInArrow(gather, "qblock int, qrow binary, qid binary, qnorm binary, q binary"), "ann-queries")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for b in batches:
            for r in range(len(b)):
                held = {name: b.column(name)[r].as_py() for name in b.schema.names}
                rows, ids, qrows, qids = (np.frombuffer(held[c], np.int64) for c in ("row", "vec_id", "qrow", "qid"))
                norm, qnorm = (np.frombuffer(held[c]) for c in ("norm", "qnorm"))
                x, q = (np.frombuffer(held[c]).reshape(-1, dim) for c in ("v", "q"))
                codes = np.ascontiguousarray(np.frombuffer(held["codes"], np.uint8).reshape(len(ids), -1).T)
                got: list[tuple] = []
                for i in range(0, len(q), 64):
                    tables = book.tables(_unit(q[i : i + 64]))
                    near = np.zeros((len(tables), len(ids)), np.float32)
                    for s in range(codes.shape[0]):
                        near += np.take(tables[:, s], codes[s], axis=1)
                    for j, keep in enumerate(_kept(near, k, rerank, MARGIN * held["error"]), i):
                        at = np.flatnonzero(keep & (rows != qrows[j]))
                        score = _products(x[at], q[j]) / (norm[at] * qnorm[j])
                        best = np.argsort(-score, kind="stable")[:k]  # rows lie in order of id
                        got += [(qrows[j], qids[j], ids[at[t]], rows[at[t]], score[t]) for t in best.tolist()]
                cols = list(zip(*got, strict=True)) or [()] * 5
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True)], ["query_row", "query_id", "vec_id", "row", "score"])

    # each index block goes once to each query block; a pair is a task's work
    pairs = packed.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1)))).repartition("qblock", F.xxhash64("vec_id")).join(asked, "qblock")
    found = pairs.select("row", "vec_id", "norm", "v", "codes", "error", "qrow", "qid", "qnorm", "q").mapInArrow(scan, "query_row long, query_id long, vec_id long, row long, score double")
    final = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
 u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM d),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(c.v, q.v), lambda p: p[1] * p[2])) / (c.n * q.n) AS score
  FROM u q JOIN u c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id WHERE q.n > 0 AND c.n > 0)
 SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


def exact_nearest(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int = 5) -> pd.DataFrame:
    """Brute force, to measure recall on samples."""
    unit = _unit(x.astype(np.float64))
    rows = []
    for q in queries:
        score = unit @ unit[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        rows += [(int(q), r, int(ids[i]), float(score[i])) for r, i in enumerate(order, 1)]
    return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])
