"""Hard-negative mining by partial products after an orthogonal PCA rotation (operator 13).

1. Integers. Components become floor(256 x); scores are integer inner products.
2. Rotation. An orthogonal matrix from the second moments of a bounded sample (`max_train` vectors)
   puts the directions that hold most of all products first. It decides how early rows are discarded,
   never which rows are found.
3. Index. Rows lie in blocks with their integers, their rotated components and the norms of what
   remains after the first STAGES components.
4. Positives. Every block of anchors meets every index block. Partial products over the leading
   components grow stage by stage; the remainder is at most the product of the remaining norms, plus
   slack for rounding. Rows whose upper bound lies under the k-th lower bound go; survivors are scored
   by integer products, and of each block the k best go on.
5. Negatives. The same scan with rows of other labels, against the range of scores that each positive
   allows: rows that must lie outside of every range, or under k that must lie within, go early.

The scan costs anchors x rows; a task holds one index block and one block of anchors.

Result: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

Defined results: rows with a null label, vector or id, or a null or non-finite component, take no part,
nor do vectors whose integers have a squared length of 2**62 or more, as their scores need not fit a
long; zero and empty vectors do (score 0); vectors meet those of their own dimension; each row is one of its
own also where it shares its id or vector, and only the anchor's own row is not its positive; ties go to the smaller
vec_id; anchors without a positive or a negative give no row; an empty table gives none; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.llm.ann import BLOCK_VALUES, INDEX_BLOCK, QUERY_BLOCK, _in_blocks, _matrix
from faultline.llm.shared import Scratch, saved

MAX_TRAIN = 10_000
#: Leading components after which rows are discarded.
STAGES = (8, 16, 32, 64, 128, 256)
SCALE, LABELS, RELABEL_EVERY = 256, 10, 7
#: A negative's score in hundredths of the positive's.
LEAST, MOST = 80, 100
_AT_ONCE = 64


def participants(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, dim, v array<long>) of the rows that take part; empty vectors get one zero, dim tells them apart."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) * SCALE >= 2.0**31))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x")).where(fine)
    whole = own.select("vec_id", F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).alias("label"), F.size("x").alias("dim"), F.transform("x", lambda e: F.floor(e * SCALE)).alias("v"))
    kept = whole.where(F.aggregate("v", F.lit(0.0), lambda acc, e: acc + e.cast("double") * e.cast("double")) < 2.0**62)
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "dim", F.when(F.col("dim") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.col("v")).alias("v"))


def rotation(v: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose first columns are the directions of the largest second moments."""
    x = v / max(np.abs(v).max(initial=0), 1)
    return np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1])


def stages(dim: int) -> list[int]:
    return [*[s for s in STAGES if s < dim], dim]


def remaining(y: np.ndarray) -> np.ndarray:
    """For each row the norms of what follows each stage, the last one 0, and at the end the whole norm."""
    tails = [np.sqrt(np.square(y[:, s:]).sum(1)) for s in [*stages(y.shape[1]), 0]]
    return np.ascontiguousarray(np.stack(tails, 1))


def slack(dim: int) -> float:
    """Of the product of two norms: more than rotation, sums and norms can be off by rounding."""
    return 32 * (dim + 8) * 2.0**-52


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest; fewer: minus infinity."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def allowed(score: int) -> tuple[int, int]:
    """The least and the most score of negatives to a positive."""
    return -(-LEAST * score // 100), MOST * score // 100


class Block:
    """Arrays of an index block or a block of anchors."""

    def __init__(self, held: dict, dim: int, mark: str = ""):
        get = lambda c, kind: np.frombuffer(held[mark + c], kind)
        self.rows, self.ids, self.labels = (get(c, np.int64) for c in ("row", "vec_id", "label"))
        self.v, self.y, self.rest = get("v", np.int32).reshape(-1, dim), get("y", np.float64).reshape(-1, dim), get("rest", np.float64).reshape(len(self.rows), -1)
        self.stages, self.slack = stages(dim), slack(dim)

    def survivors(self, q: Block, j: int, at: np.ndarray, first: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The places in `at` that no stage discards; first: their partial products over the first stage. keep: which (lower, upper) bounds stay."""
        partial, done = first, self.stages[0]
        for s, upto in enumerate(self.stages):
            if upto > done:
                partial = partial + self.y[at, done:upto] @ q.y[j, done:upto]
                done = upto
            off = self.rest[at, s] * q.rest[j, s] + self.slack * self.rest[at, -1] * q.rest[j, -1]
            stays = keep(partial - off, partial + off)
            at, partial = at[stays], partial[stays]
        return at

    def scored(self, q: Block, j: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) in order of rank, by integer products."""
        score = self.v[at].astype(np.int64) @ q.v[j].astype(np.int64)
        order = np.lexsort((self.rows[at], self.ids[at], -score))
        return at[order], score[order]


ARRAYS = ("row", "vec_id", "label", "v", "y", "rest")


def _packed(blocks: DataFrame, turn: Broadcast, mark: str = "", extra: tuple[str, ...] = ()) -> DataFrame:
    """A row for each block: the bytes of its arrays; extra: lists of longs in each row, as one array with sizes."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        v = _matrix(rows.column("v"), len(rows.column("v")[0]))
        y = v @ turn.value
        out = {c: rows.column(c).to_numpy().tobytes() for c in ARRAYS[:3]} | {"v": v.astype(np.int32).tobytes(), "y": y.tobytes(), "rest": remaining(y).tobytes()}
        for c in extra:
            lists = rows.column(c).combine_chunks()
            out |= {c: lists.flatten().to_numpy().tobytes(), f"{c}_n": np.diff(lists.offsets.to_numpy()).astype(np.int64).tobytes()}
        return pa.table({f"{mark}block": rows.column("block").slice(0, 1)} | {mark + c: pa.array([x], pa.binary()) for c, x in out.items()})

    names = [*ARRAYS, *[x for c in extra for x in (c, f"{c}_n")]]
    return blocks.groupBy("block").applyInArrow(pack, f"{mark}block int, " + ", ".join(f"{mark}{c} binary" for c in names))


def _scanned(index: DataFrame, asked: DataFrame, n_asked: int, dim: int, found: Callable[[Block, Block, dict, int, np.ndarray], list[tuple]], columns: list[str]) -> DataFrame:
    """Every index block with every block of anchors; found: rows of longs for one anchor, from the partial products of all rows over the first stage."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                held = {name: b.column(name)[r].as_py() for name in b.schema.names}
                x, q = Block(held, dim), Block(held, dim, "q")
                lead, got = x.stages[0], []
                for i in range(0, len(q.rows), _AT_ONCE):
                    first = q.y[i : i + _AT_ONCE, :lead] @ x.y[:, :lead].T
                    for j in range(i, i + len(first)):
                        got += found(x, q, held, j, first[j - i])
                cols = list(zip(*got, strict=True)) or [()] * len(columns)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], columns)

    pairs = index.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))).repartition("qblock", "block").join(asked, "qblock").drop("block", "qblock")
    return pairs.mapInArrow(scan, ", ".join(f"{c} long" for c in columns))


def _best(found: DataFrame, by: list[str], score: str, vec_id: str, row: str, k: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc(score), vec_id, row)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, k_positive: int = 5, k_negative: int = 5, anchor_every: int = 100, max_train: int = MAX_TRAIN) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by anchor_every."""
    spark = vectors.sparkSession
    with Scratch(spark) as tmp:
        all_ = tmp.saved(participants(vectors), "vectors")
        sizes = sorted((r["dim"], r["count"]) for r in all_.groupBy("dim").count().collect())  # a row for each dimension
        found = [_mined(all_.where(F.col("dim") == dim), max(dim, 1), n, tmp, k_positive, k_negative, anchor_every, max_train) for dim, n in sizes]
        empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        return saved(reduce(DataFrame.unionByName, found, empty), "hard-negatives")


def _mined(all_: DataFrame, dim: int, n: int, tmp: Scratch, k_positive: int, k_negative: int, anchor_every: int, max_train: int) -> DataFrame:
    """hard_negatives() for n vectors of one dimension."""
    sample = all_.orderBy(F.xxhash64("vec_id"), "row").limit(max_train).select("v").toArrow()  # max_train vectors at most
    turn = all_.sparkSession.sparkContext.broadcast(rotation(_matrix(sample.column("v"), dim)))
    size = max(1, BLOCK_VALUES // dim)
    index = tmp.saved(_packed(_in_blocks(all_, n, min(INDEX_BLOCK, size))[0], turn), "index")
    anchors = all_.where(F.pmod("vec_id", F.lit(anchor_every)) == 0)
    blocks, n_blocks = _in_blocks(anchors, anchors.count(), min(QUERY_BLOCK, size))

    def positives(x: Block, q: Block, held: dict, j: int, first: np.ndarray) -> list[tuple]:
        at = np.flatnonzero((x.labels == q.labels[j]) & (x.rows != q.rows[j]))
        at = x.survivors(q, j, at, first[at], lambda low, high: high >= kth(low, k_positive))
        at, score = (a[:k_positive] for a in x.scored(q, j, at))
        return [(int(q.rows[j]), int(x.ids[a]), int(x.rows[a]), int(s)) for a, s in zip(at, score, strict=True)]

    asked = tmp.saved(_packed(blocks, turn, "q"), "anchors")
    near = _scanned(index, asked, n_blocks, dim, positives, ["anchor_row", "positive_id", "positive_row", "positive_score"])
    best = tmp.saved(_best(near, ["anchor_row"], "positive_score", "positive_id", "positive_row", k_positive).withColumnRenamed("rank", "place"), "positives")

    scores = best.groupBy(F.col("anchor_row").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p.positive_score).alias("scores"))  # k_positive at most

    def negatives(x: Block, q: Block, held: dict, j: int, first: np.ndarray) -> list[tuple]:
        ends = held.setdefault("ends", np.cumsum(np.frombuffer(held["qscores_n"], np.int64)))
        own = np.frombuffer(held["qscores"], np.int64)[(ends[j - 1] if j else 0) : ends[j]].tolist()
        ranges = [allowed(s) for s in own]

        def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            stays = np.zeros(len(low), bool)
            for least, most in set(ranges):
                if least <= most:
                    within = (high >= least) & (low <= most)
                    sure = low[(low >= least) & (high <= most)]
                    stays |= within & (high >= kth(sure, k_negative))
            return stays

        at = np.flatnonzero(x.labels != q.labels[j])
        at, score = x.scored(q, j, x.survivors(q, j, at, first[at], keep))
        out = []
        for place, (least, most) in enumerate(ranges, 1):
            fits = np.flatnonzero((score >= least) & (score <= most))[:k_negative]
            out += [(int(q.rows[j]), place, int(x.ids[at[f]]), int(x.rows[at[f]]), int(score[f])) for f in fits]
        return out

    asked = tmp.saved(_packed(blocks.join(scores, "row"), turn, "q", ("scores",)), "anchors")
    hard = _scanned(index, asked, n_blocks, dim, negatives, ["anchor_row", "place", "negative_id", "negative_row", "negative_score"])
    hard = _best(hard, ["anchor_row", "place"], "negative_score", "negative_id", "negative_row", k_negative)
    named = hard.join(best, ["anchor_row", "place"]).join(anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = f"""WITH d AS (SELECT vec_id, CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM d a JOIN d c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
 SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score
 WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
