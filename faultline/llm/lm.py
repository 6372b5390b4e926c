"""LM scoring with a log-frequency Bloom filter (operator 6).

Tokens: A-Z lower-cased, words between ASCII white space, then one end token for each text.
Training texts are those whose crc32(doc_id as text) modulo 5 is not 1 (or any given column).

1. Chunks. Texts become chunks of about CHUNK tokens in a table: distinct word hashes and each
   token's place among them. Counts of words and of word pairs are added up from the training texts
   of all chunks by 64-bit hash (two different words share a hash with a chance of about V^2 / 2^65).
2. Model. Every n-gram of the training texts is stored, whatever its count, so the filter grows
   with the corpus. It lies in segments, one for SEGMENT_TOKENS training tokens, each as long as
   its own entries need. An n-gram enters its segment once for each level up to that of its count
   (quantised in steps of STEP). Segments know n-grams by KEY_BYTES bytes: two of a segment's
   share them with a chance of about 2^-20, far below the filter's own errors. `train` keeps the
   segments in a table, which is all that `Model.scores` needs to score any texts.
3. Score. Counts are read off by probing level after level until one is missing. `Model.scores` broadcasts a
   filter of up to SHARED_BYTES, as its table tells, and chunks probe it where they lie; to a larger
   one chunks send their distinct n-grams, and the levels go back. `lm_scores` scores the texts
   that it learns from: there the n-grams that chunks ask for travel with their counts,
   in one shuffle, and a segment is filled and probed by one task. All ways give the same scores.
   Pairs are smoothed with words by a Dirichlet prior: (c(v, w) + BETA p(w)) / (c(v) + BETA).
4. Base score. It needs each word's exact count: the TOP most frequent ones are broadcast, the
   rest of a text's words join the counts table.

Result: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row for each
input row.

Defined results: null texts are empty (one token, the end); repeated rows are counted and
returned each; a null doc_id is held out of nothing and trains; without training text every
probability comes from N = V = 0; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import Scratch, saved, texts_in_batches
from faultline.llm.textkernel import U64, mix, slices, words

STEP, HASHES, BITS_PER_ENTRY = 1.25, 4, 12
CHUNK, SEGMENT_TOKENS, KEY_BYTES = 1 << 20, 1 << 20, 5
BETA = 500.0
#: The largest filter that is broadcast, and so held by every Python worker.
SHARED_BYTES = 64 << 20
TOP = 1 << 18
_END = U64(0x5851F42D4C957F2D)
_LEVEL = U64(0xD1342543DE82EF95)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with ends, offsets)."""
    w = words(texts)
    offsets = w.offsets + np.arange(len(w.offsets))
    out = np.empty(len(w.hashes) + len(texts), U64)
    ends = offsets[1:] - 1
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word], out[ends] = w.hashes, _END
    return out, offsets


def pair_keys(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The key of each token with the one before it; a text's first token follows an end."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[offsets[:-1]] = _END
    return mix(mix(before) * U64(3) + h)


def _packed(at: np.ndarray) -> bytes:
    """Places as 32-bit numbers, byte by byte of all, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(at.astype("<i4").view(np.uint8).reshape(-1, 4).T))


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def chunked(source: DataFrame) -> DataFrame:
    """(chunk, n, sizes, nulls, ids, trains, words, at) of (doc_id, text, trains); chunk is its first row's number, n its tokens, the rest are the bytes of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            h, sizes, nulls, ids, trains = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            uniq, at = np.unique(h, return_inverse=True)
            return pa.record_batch([pa.array([row]), pa.array([len(h)]), *(pa.array([x.tobytes()], pa.binary()) for x in (sizes, nulls, ids, trains, uniq)), pa.array([_packed(at)], pa.binary())], ["chunk", "n", "sizes", "nulls", "ids", "trains", "words", "at"])

        for batch in batches:
            for i, j in slices(batch.column(1)):
                h, offs = tokens(batch.column(1).slice(i, j - i))
                ids = batch.column(0).slice(i, j - i)
                held.append((h, np.diff(offs).astype(np.int32), ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False)))
                if sum(len(x[0]) for x in held) >= CHUNK:
                    rows = sum(len(x[1]) for x in held)
                    yield packed()
                    row += rows
        if held:
            yield packed()

    return source.mapInArrow(run, "chunk long, n long, sizes binary, nulls binary, ids binary, trains binary, words binary, at binary")


class Chunk:
    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.sizes, self.at = np.frombuffer(row["sizes"], np.int32), _unpacked(row["at"])
        self.ids, self.words = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["nulls"], bool)), np.frombuffer(row["words"], U64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        self.trains = np.repeat(np.frombuffer(row["trains"], bool), self.sizes)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)

    @cached_property
    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(the keys of the distinct words and then of the distinct pairs, each token's pair among the latter)."""
        pairs, at = np.unique(pair_keys(self.words[self.at], self.offsets), return_inverse=True)
        return np.concatenate([self.words, pairs]), at


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for b in batches:
        for i in range(len(b)):
            yield Chunk(b.slice(i, 1).to_pylist()[0])


def counted(chunks: DataFrame) -> DataFrame:
    """(h, c): the words of the training texts and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _chunks(batches):
            c = np.bincount(x.at[x.trains], minlength=len(x.words))
            yield pa.record_batch([pa.array(x.words[c > 0].view(np.int64)), pa.array(c[c > 0])], ["h", "c"])

    return chunks.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _entry(key: np.ndarray, level: int) -> np.ndarray:
    return mix(key + U64(int(_LEVEL) * level & 0xFFFFFFFFFFFFFFFF))


def _bit(entry: np.ndarray, k: int, n_bits: int | np.ndarray) -> np.ndarray:
    """The position in a segment of n_bits that the k-th hash gives an entry."""
    return ((entry + U64(k) * ((entry >> U64(32)) | U64(1))) % np.asarray(n_bits, U64)).astype(np.int64)


def placed(key: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, key within it) of each key."""
    x = mix(key ^ _LEVEL)
    return (x % U64(n_segments)).astype(np.int64), x >> U64(64 - 8 * KEY_BYTES)


def levels(c: np.ndarray, floor: float) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(c / floor, 1)) / math.log(STEP) + 1e-9).astype(np.int64)


def filled(key: np.ndarray, c: np.ndarray, floor: float) -> np.ndarray:
    """The segment's bytes that hold each key up to the level of its count."""
    top = levels(c, floor)
    bits = np.zeros(8 * (int(top.sum()) * BITS_PER_ENTRY // 8 + 8), bool)
    for j in range(1, int(top.max(initial=0)) + 1):
        entry = _entry(key[top >= j], j)
        for k in range(HASHES):
            bits[_bit(entry, k, len(bits))] = True
    return np.packbits(bits, bitorder="little")


def probed(data: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The level of each key in its segment, `size` bytes of data from `start` on; 0 if it is not stored."""
    level = np.zeros(len(key), np.int64)
    on, j = np.flatnonzero(size > 0), 0
    key, start, size = key[on], start[on], size[on]
    while len(on):
        j += 1
        entry = _entry(key, j)
        for k in range(HASHES):
            at = _bit(entry, k, 8 * size)
            hit = (data[start + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
            on, key, entry, start, size = on[hit], key[hit], entry[hit], start[hit], size[hit]
        level[on] = j
    return level


def count_of(level: np.ndarray, floor: float = 1.0) -> np.ndarray:
    """The mean of the whole counts that a level stands for, so that sums of counts keep their size; 0 for level 0."""
    low, high = np.ceil(floor * STEP ** (level - 1.0) - 1e-9), np.ceil(floor * STEP**level.astype(np.float64) - 1e-9) - 1
    return np.where(level > 0, (low + high) / 2, 0.0)


def word_probability(c1: np.ndarray, denominator: float) -> np.ndarray:
    """Of words by their count; what is left to 1 goes to the word that training never met."""
    return (c1 + 0.5) / denominator


def next_probability(c2: np.ndarray, before: np.ndarray, p1: np.ndarray, beta: float) -> np.ndarray:
    """Of a word with the probability p1 after one of count `before`, c2 being the pair's count. Over all words it sums to 1, but for the steps of the counts."""
    return (np.minimum(c2, before) + beta * p1) / (before + beta)


class LogFrequencyFilter:
    """Quantised counts by repeated membership probes, of a filter small enough to be held whole."""

    def __init__(self, segments: list[np.ndarray], floor: float):
        self.data, self.floor = np.concatenate([np.zeros(0, np.uint8), *segments]), floor
        self.sizes = np.array([len(x) for x in segments], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def levels(self, key: np.ndarray) -> np.ndarray:
        of, own = placed(key, len(self.sizes))
        return probed(self.data, own, self.starts[of], self.sizes[of])

    def counts(self, key: np.ndarray) -> np.ndarray:
        """The stored count of each key, 0 if it is not stored."""
        return count_of(self.levels(key), self.floor)


def build_filter(counts: list[DataFrame], floor: float = 1.0) -> LogFrequencyFilter:
    """The filter of small (h, c) tables in one piece; `train` builds each segment in a task."""
    rows = pa.concat_tables([x.select("h", "c").toArrow() for x in counts])
    key, c = rows.column("h").to_numpy().view(U64), rows.column("c").to_numpy()
    n_segments = max(1, -(-len(c) // SEGMENT_TOKENS))
    of, own = placed(key, n_segments)
    return LogFrequencyFilter([filled(own[m], c[m], floor) for m in ((of == k) & (c >= floor) for k in range(n_segments))], floor)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of numbers, byte by byte of all, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T))


def _values(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _order(of: np.ndarray, own: np.ndarray) -> np.ndarray:
    """By segment, then by key: rising keys are sent as small differences."""
    return np.lexsort((own, of))


def _by_segment(x: Chunk, n_segments: int, c: np.ndarray, asks: bool) -> pa.RecordBatch:
    """(chunk, segment, keys, counts): a chunk's keys by segment, and their counts in its training texts; unless it asks, those that have one."""
    of, own = placed(x.keys[0], n_segments)
    order = _order(of, own)
    if not asks:
        order = order[c[order] > 0]
    of, own, c = of[order], own[order], c[order]
    named, first = np.unique(of, return_index=True)
    parts = list(zip(first, [*first[1:], len(of)], strict=True))
    keys = [_planes(np.diff(own[a:b], prepend=U64(0)), KEY_BYTES) for a, b in parts]
    counts = [_planes(c[a:b], 4) for a, b in parts]
    return pa.record_batch([pa.array(np.full(len(named), x.number)), pa.array(named), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["chunk", "segment", "keys", "counts"])


def _keys_of(lists: list[bytes]) -> list[np.ndarray]:
    return [np.cumsum(_values(x, KEY_BYTES), dtype=U64) for x in lists]


def sent(chunks: DataFrame, n_segments: int, asks: bool) -> DataFrame:
    """What the chunks send to the segments: the counts of their training n-grams and, if they ask, their other n-grams too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _chunks(batches):
            keys, pair_at = x.keys
            c = np.concatenate([np.bincount(x.at[x.trains], minlength=len(x.words)), np.bincount(pair_at[x.trains], minlength=len(keys) - len(x.words))])
            yield _by_segment(x, n_segments, c, asks)

    return chunks.mapInArrow(run, "chunk long, segment long, keys binary, counts binary")


def _segment(lists: list[np.ndarray], rows: pa.Table) -> np.ndarray:
    """A segment's bytes by the counts that its chunks sent."""
    c = np.concatenate([np.zeros(0, U64), *(_values(x, 4) for x in rows.column("counts").to_pylist())])
    uniq, at = np.unique(np.concatenate([np.zeros(0, U64), *lists]), return_inverse=True)
    c = np.bincount(at, c, len(uniq))
    return filled(uniq[c > 0], c[c > 0], 1.0)


def _levels(segment: np.ndarray, lists: list[np.ndarray], rows: pa.Table) -> pa.Table:
    """(chunk, segment, levels): what a segment answers."""
    keys = np.concatenate([np.zeros(0, U64), *lists])
    level = probed(segment, keys, np.zeros(len(keys), np.int64), np.full(len(keys), len(segment))).astype(np.uint8)
    ends = np.cumsum([0, *map(len, lists)])
    return pa.table({"chunk": rows.column("chunk"), "segment": rows.column("segment"), "levels": pa.array([level[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})


ANSWERS = "chunk long, segment long, levels binary"


def segments(chunks: DataFrame, n_segments: int) -> DataFrame:
    """(segment, filter): the filter of the chunks' training texts. A segment without entries has no row."""

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"segment": pa.array([key[0].as_py()]), "filter": pa.array([_segment(_keys_of(rows.column("keys").to_pylist()), rows).tobytes()], pa.binary())})

    return sent(chunks, n_segments, False).groupBy("segment").applyInArrow(fill, "segment long, filter binary")


def own_answers(chunks: DataFrame, n_segments: int) -> DataFrame:
    """What the filter of the chunks' own training texts answers: questions travel with the counts, so n-grams are shuffled once."""

    def run(rows: pa.Table) -> pa.Table:
        lists = _keys_of(rows.column("keys").to_pylist())
        return _levels(_segment(lists, rows), lists, rows)

    return sent(chunks, n_segments, True).groupBy("segment").applyInArrow(run, ANSWERS)


#: What is made of a chunk and the levels of its keys: one row for each of its texts.
Rows = Callable[[Chunk, np.ndarray], pa.Table]


def put_back(chunks: DataFrame, answers: DataFrame, n_segments: int, rows: Rows, schema: str) -> DataFrame:
    """`rows` of each chunk and the levels that the segments gave it."""

    def run(key: tuple, chunk: pa.Table, own: pa.Table) -> pa.Table:
        x = Chunk(chunk.to_pylist()[0])
        level = np.empty(len(x.keys[0]), np.int64)
        level[_order(*placed(x.keys[0], n_segments))] = np.frombuffer(b"".join(own.sort_by("segment").column("levels").to_pylist()), np.uint8)
        return rows(x, level)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


@dataclass
class Model:
    """All that scoring needs: the filter's table (segment, filter), the number of its segments, of training tokens and of distinct ones."""

    filter: DataFrame | None
    n_segments: int
    n: int
    v: int

    @property
    def denominator(self) -> float:
        return self.n + 0.5 * (self.v + 1)

    def applied(self, chunks: DataFrame, rows: Rows, schema: str, shared_bytes: int = SHARED_BYTES) -> DataFrame:
        """`rows` of each chunk and the levels of its keys."""
        if (self.filter.agg(F.sum(F.length("filter"))).first()[0] or 0) <= shared_bytes:
            return self._broadcast(chunks, rows, schema)
        return put_back(chunks, self._answers(chunks), self.n_segments, rows, schema)

    def _broadcast(self, chunks: DataFrame, rows: Rows, schema: str) -> DataFrame:
        parts = [np.zeros(0, np.uint8)] * self.n_segments
        for r in self.filter.toArrow().to_pylist():  # SHARED_BYTES at most
            parts[r["segment"]] = np.frombuffer(r["filter"], np.uint8)
        shared = chunks.sparkSession.sparkContext.broadcast(LogFrequencyFilter(parts, 1.0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in _chunks(batches):
                yield from rows(x, shared.value.levels(x.keys[0])).to_batches()

        return chunks.mapInArrow(run, schema)

    def _answers(self, chunks: DataFrame) -> DataFrame:
        tokens = chunks.agg(F.sum("n")).first()[0] or 0
        parts = max(1, math.ceil(tokens / (self.n_segments * SEGMENT_TOKENS)))  # more texts than trained it: copies of a segment share their questions

        def run(key: tuple, asked: pa.Table, stored: pa.Table) -> pa.Table:
            data = np.frombuffer(b"".join(stored.column("filter").to_pylist()), np.uint8)
            return _levels(data, _keys_of(asked.column("keys").to_pylist()), asked)

        asked = sent(chunks, self.n_segments, True).withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts).cast("long")))
        stored = self.filter.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        return asked.groupBy("segment", "part").cogroup(stored.groupBy("segment", "part")).applyInArrow(run, ANSWERS)

    def points(self, x: Chunk, level: np.ndarray, beta: float) -> np.ndarray:
        """log10 of the model's probability of each text of a chunk."""
        c, pair_at = count_of(level), x.keys[1]
        c1 = c[: len(x.words)][x.at]
        before = np.empty_like(c1)
        before[1:] = c1[:-1]
        before[x.offsets[:-1]] = c[np.searchsorted(x.words, _END)]  # every text has an end
        p = next_probability(c[len(x.words) :][pair_at], before, word_probability(c1, self.denominator), beta)
        return np.bincount(x.doc, np.log10(p), len(x.sizes))

    def scores(self, docs: DataFrame, beta: float = BETA, shared_bytes: int = SHARED_BYTES) -> DataFrame:
        """(doc_id, n_tokens, score) of any texts (doc_id, text), whether or not the model learnt from them."""
        with Scratch(docs.sparkSession) as tmp:
            chunks = tmp.saved(chunked(_source(docs).withColumn("trains", F.lit(False))), "chunks")

            points = replace(self, filter=None).points  # tasks don't take tables

            def rows(x: Chunk, level: np.ndarray) -> pa.Table:
                return pa.table({"doc_id": x.ids, "n_tokens": pa.array(x.sizes.astype(np.int64)), "score": pa.array(points(x, level, beta))})

            return saved(self.applied(chunks, rows, "doc_id long, n_tokens long, score double", shared_bytes), "lm-points")


def _source(docs: DataFrame) -> DataFrame:
    texts_in_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _learnt(chunks: DataFrame, tmp: Scratch) -> tuple[Model, DataFrame]:
    """The model of the chunks' training texts, its filter not yet made, and (h, c), the exact counts of their words."""
    counts = tmp.saved(counted(chunks), "words")
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    return Model(None, max(1, math.ceil(n / SEGMENT_TOKENS)), n, v), counts


def train(docs: DataFrame) -> Model:
    """The model of all texts (doc_id, text); its filter is a table of its own in the shared folder."""
    with Scratch(docs.sparkSession) as tmp:
        chunks = tmp.saved(chunked(_source(docs).withColumn("trains", F.lit(True))), "chunks")
        model, _ = _learnt(chunks, tmp)
        return replace(model, filter=saved(segments(chunks, model.n_segments), "lm-filter"))


def lm_scores(docs: DataFrame, beta: float = BETA, top: int = TOP) -> DataFrame:
    with Scratch(docs.sparkSession) as tmp:
        return _scores(docs, beta, top, tmp)


def _scores(docs: DataFrame, beta: float, top: int, tmp: Scratch) -> DataFrame:
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    chunks = tmp.saved(chunked(_source(docs).withColumn("trains", ~held_out)), "chunks")
    model, counts = _learnt(chunks, tmp)
    denominator = model.denominator
    first = counts.orderBy(F.desc("c"), "h").limit(top).toArrow()  # `top` rows at most
    known = first.column("h").to_numpy().view(U64)
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast((known[order], first.column("c").to_numpy()[order]))
    points = model.points

    def rows(x: Chunk, level: np.ndarray) -> pa.Table:
        known, known_c = shared.value
        n_docs = len(x.sizes)
        # exact counts of frequent words
        pos = np.minimum(np.searchsorted(known, x.words), max(len(known) - 1, 0))
        hit = known[pos] == x.words if len(known) else np.zeros(len(x.words), bool)
        exact = np.where(hit, known_c[pos] if len(known) else 0, 0)
        token_hit = hit[x.at]
        base = np.bincount(x.doc[token_hit], np.log10((exact[x.at[token_hit]] + 0.5) / denominator), n_docs)
        n_known = np.bincount(x.doc[token_hit], minlength=n_docs)
        rest = np.concatenate([[0], np.cumsum(np.bincount(x.doc[~token_hit], minlength=n_docs))])
        rare_words = pa.ListArray.from_arrays(pa.array(rest.astype(np.int32), pa.int32()), pa.array(x.words[x.at[~token_hit]].view(np.int64)))
        return pa.table([pa.array(x.number + np.arange(n_docs)), x.ids, pa.array(x.sizes.astype(np.int64)), pa.array(n_known), pa.array(base), pa.array(points(x, level, beta)), rare_words], ["row", "doc_id", "n_tokens", "n_top", "base_top", "score", "rare"])

    schema = "row long, doc_id long, n_tokens long, n_top long, base_top double, score double, rare array<long>"
    scored = tmp.saved(put_back(chunks, own_answers(chunks, model.n_segments), model.n_segments, rows, schema), "scored")
    rest = scored.select("row", F.explode("rare").alias("h")).join(counts, "h", "left").groupBy("row").agg(F.count("c").alias("n_rest"), F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.5) / denominator)).alias("base_rest"))
    out = scored.drop("rare").join(rest, "row", "left").select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("n_top") + F.coalesce("n_rest", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base_top") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"),
        "score",
    )
    return saved(out, "lm-scores")
