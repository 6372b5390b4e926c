"""Benchmark decontamination (operator 3): a BM25 index of test items with block-max WAND.

The test items are indexed by tasks, in shards of about SHARD_TOKENS tokens, dealt by hash, which
lie in a table; word counts over all items are a Spark aggregate. A shard is broadcast alone, so
what is broadcast has a fixed bound; a larger test set makes more shards, and every document meets
each of them. The driver holds one shard at a time.

Each document is cut into passages of 2L words, L apart, where L is the shard's longest item:
any verbatim item lies whole in a passage. A passage is a BM25 query of its distinct words. A
posting holds the item's BM25 weight of a word divided by the item's score for itself, so a
passage that has all words of an item scores 1 for it and one threshold serves all items.
Words are split into essential ones and a rest whose weights stay below REST thresholds in every
item, so an item's score is at most its essential weight plus `slack`, the largest rest. Block-max
WAND walks the postings of a passage's essential words with this slack in its bounds and returns
EVERY item that scores at least `threshold`: it skips blocks (BLOCK items) whose maxima cannot
reach it, nothing else. The sums of block maxima are made for all passages of a batch at once;
the walk goes through the blocks that are left.

Retrieved items are verified on the whole document's words: the share of the item's, the
question's and the answer's word runs (RUN words) found in it. A leak needs `min_question` of the
question and `min_answer` of the answer. Of an item that is one text the last sentence counts as the
answer; as it may be no answer at all, `min_whole` of the whole item, whichever part that is, is a
leak as well.

Result: (doc_id, item_id, score, overlap, question_overlap, answer_overlap), a row for each document
row and leaked item.

Defined results: null or empty texts leak nothing; items without words are ignored; items that
share a text are reported each; repeated document rows are reported each; a null doc_id or
item_id is reported as null; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import saved, texts_in_batches
from faultline.llm.textkernel import NON_WORD, U64, slices, words

K1, B, BLOCK, RUN = 1.2, 0.75, 8, 4
#: What words that are not essential may hold of an item, in thresholds.
REST = 0.5
#: Tokens of an index shard (about 24 bytes each when broadcast).
SHARD_TOKENS = 1_000_000


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the last sentence is the answer if there are several."""
    body = text.rstrip()
    cut = max(body.rfind(x, 0, len(body) - 1) for x in (". ", "? ", "! ", "\n", ".\n"))
    return (body[: cut + 1], body[cut + 1 :]) if cut > 0 and body[cut + 1 :].strip() else (body, "")


def runs(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of RUN words; a shorter text is one run."""
    if len(h) < RUN:
        return np.array([hash_run(h)], U64) if len(h) else h
    out = np.zeros(len(h) - RUN + 1, U64)
    for j in range(RUN):
        out = out * U64(0x9E3779B97F4A7C15) + h[j : len(h) - RUN + 1 + j]
    return out


def hash_run(h: np.ndarray) -> np.uint64:
    out = np.zeros(1, U64)
    for x in h:
        out = out * U64(0x9E3779B97F4A7C15) + x
    return out[0]


@dataclass
class Postings:
    """Of one word: items in ascending order, their weights, and the largest weight in each block of BLOCK item numbers that has any."""

    items: list[int]
    weights: list[float]
    tops: dict[int, float]

    def weight_of(self, item: int) -> float:
        at = bisect_left(self.items, item)
        return self.weights[at] if at < len(self.items) and self.items[at] == item else 0.0


@dataclass
class Shard:
    item_ids: list
    vocabulary: np.ndarray  # word hashes, ascending
    lists: list[Postings]
    essential: np.ndarray  # of each word: whether an item needs it or its like to reach the threshold
    rest: np.ndarray  # of each item: the weight of its words that are not essential
    blocks_at: np.ndarray  # where each word's blocks begin in the two below
    blocks: np.ndarray
    tops: np.ndarray
    length: int  # words of the longest item
    wholes: list[np.ndarray]
    questions: list[np.ndarray]
    answers: list[np.ndarray]

    @property
    def slack(self) -> float:
        return float(self.rest.max(initial=0.0))

    def passing(self, query: np.ndarray, term: np.ndarray, threshold: float) -> np.ndarray:
        """query x n_blocks + block of the blocks whose maxima let an item reach the threshold; query, term: the queries' distinct essential terms."""
        n = self.blocks_at[term + 1] - self.blocks_at[term]
        at = np.repeat(self.blocks_at[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair, inverse = np.unique(np.repeat(query, n) * self.n_blocks + self.blocks[at], return_inverse=True)
        return pair[self.slack + np.bincount(inverse, self.tops[at], len(pair)) >= threshold]

    @property
    def n_blocks(self) -> int:
        return len(self.item_ids) // BLOCK + 1

    def wand(self, terms: list[int], threshold: float, blocks: list[int] | None = None) -> list[tuple[int, float]]:
        """All (item, score) with score >= threshold for the query's distinct terms: block-max WAND over the essential ones with a fixed threshold. blocks: those that pass, if known."""
        mine, others = [self.lists[t] for t in terms if self.essential[t]], [self.lists[t] for t in terms if not self.essential[t]]
        if blocks is None:
            own = np.array([t for t in terms if self.essential[t]], np.int64)
            blocks = self.passing(np.zeros(len(own), np.int64), own, threshold).tolist()
        slack, found = self.slack, []
        for block in blocks:
            low, high = block * BLOCK, (block + 1) * BLOCK
            cursors = []
            for p in mine:
                if block in p.tops:
                    at = bisect_left(p.items, low)
                    cursors.append([p.items[at], at, p])
            while cursors:
                cursors.sort(key=lambda c: c[0])
                bound, pivot = slack, -1
                for k, c in enumerate(cursors):
                    bound += c[2].tops[block]
                    if bound >= threshold:
                        pivot = k
                        break
                if pivot < 0:
                    break
                item = cursors[pivot][0]
                to = item
                if cursors[0][0] == item:  # all before the pivot are there
                    score = sum(c[2].weights[c[1]] for c in cursors if c[0] == item)
                    if score + self.rest[item] >= threshold:
                        score += sum(p.weight_of(item) for p in others)
                        if score >= threshold:
                            found.append((item, score))
                    to = item + 1
                for c in cursors:
                    if c[0] < to:
                        at = bisect_left(c[2].items, to, c[1])
                        c[0], c[1] = (c[2].items[at] if at < len(c[2].items) else high), at
                cursors = [c for c in cursors if c[0] < high]
        return found


def build_shard(rows: list[tuple], n_items: int, mean_words: float, doc_freq: dict[int, int], threshold: float = 0.5) -> Shard:
    """rows: (item_id, question, answer). Weights use the counts of all items, so shards agree. The shard serves searches with this threshold or a higher one."""
    lists: dict[int, list[tuple[int, float]]] = {}
    item_ids, wholes, questions, answers, longest = [], [], [], [], 0
    for item_id, question, answer in rows:
        q, a = (words(pa.array([x]), NON_WORD).hashes for x in (question, answer))
        h = np.concatenate([q, a])
        if not len(h):
            continue
        terms, tf = np.unique(h, return_counts=True)
        df = np.array([doc_freq[int(t)] for t in terms])
        weight = np.log1p((n_items - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean_words))
        weight /= weight.sum()
        for t, w in zip(terms.tolist(), weight.tolist(), strict=True):
            lists.setdefault(t, []).append((len(item_ids), w))
        item_ids.append(item_id)
        wholes.append(runs(h))
        questions.append(runs(q))
        answers.append(runs(a))
        longest = max(longest, len(h))
    vocabulary = np.array(sorted(lists), U64)
    built = []
    for t in vocabulary.tolist():
        items, weights = map(list, zip(*lists[t], strict=True))
        tops: dict[int, float] = {}
        for i, w in zip(items, weights, strict=True):
            tops[i // BLOCK] = max(w, tops.get(i // BLOCK, 0.0))
        built.append(Postings(items, weights, tops))
    # the words of most items leave first; a word stays essential where its items would reach the threshold without it
    rest, essential = np.zeros(len(item_ids)), np.ones(len(built), bool)
    for t in sorted(range(len(built)), key=lambda t: (-len(built[t].items), t)):
        after = rest[built[t].items] + built[t].weights
        if (after < REST * threshold).all():
            rest[built[t].items], essential[t] = after, False
    at = np.concatenate([[0], np.cumsum([len(p.tops) for p in built])]).astype(np.int64)
    flat = lambda of, kind: np.array([x for p in built for x in of(p.tops)], kind)
    return Shard(item_ids, vocabulary, built, essential, rest, at, flat(dict.keys, np.int64), flat(dict.values, np.float64), max(longest, 1), wholes, questions, answers)


def search(shard: Shard, texts: pa.Array, threshold: float) -> Iterator[tuple[int, dict[int, float], np.ndarray]]:
    """(text, best score of each retrieved item, the text's word hashes) for texts that retrieve any item."""
    w = words(texts, NON_WORD)
    at = np.searchsorted(shard.vocabulary, w.hashes)
    at[at == len(shard.vocabulary)] = 0
    known = shard.vocabulary[at] == w.hashes
    n, step = w.counts, shard.length
    n_windows = np.maximum(1, -(-(n - step) // step)) * (n > 0)
    doc = np.repeat(np.arange(len(n)), n_windows)
    window_at = np.cumsum(n_windows) - n_windows
    first = w.offsets[:-1][doc] + step * (np.arange(len(doc)) - window_at[doc])
    last = np.minimum(first + 2 * step, w.offsets[1:][doc])
    # essential words' postings, in each of the up to two passages that hold the word
    word = np.flatnonzero(known)
    word = word[shard.essential[at[word]]]
    of = np.searchsorted(w.offsets, word, "right") - 1
    step_of = (word - w.offsets[:-1][of]) // step
    held = []
    for back in (0, 1):
        k = step_of - back
        ok = (k >= 0) & (k < n_windows[of])
        held.append((window_at[of] + k)[ok] * len(shard.vocabulary) + at[word][ok])
    held = np.unique(np.concatenate(held))  # each word of a passage once
    size = max(len(shard.vocabulary), 1)
    passing = shard.passing(held // size, held % size, threshold - 1e-9)
    found: dict[int, dict[int, float]] = {}
    passages, begin = np.unique(passing // shard.n_blocks, return_index=True)
    for k, blocks in zip(passages.tolist(), np.split(passing % shard.n_blocks, begin[1:]), strict=False):
        span = slice(first[k], last[k])
        for item, score in shard.wand(np.unique(at[span][known[span]]).tolist(), threshold - 1e-9, blocks.tolist()):
            best = found.setdefault(int(doc[k]), {})
            best[item] = max(score, best.get(item, 0.0))
    for i, items in found.items():
        yield i, items, w.hashes[w.offsets[i] : w.offsets[i + 1]]


def shards(items: DataFrame, threshold: float, question: str | None, answer: str | None, shard_tokens: int) -> DataFrame:
    """(shard, data): the pickled index shards, in a table."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = saved(items.select(F.col("item_id").cast("long").alias("item_id"), text(question or "text").alias("q"), (text(answer) if answer else F.lit("")).alias("a")), "test-items")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [words(b.column(c), NON_WORD) for c in (1, 2)]
            each = [np.concatenate([w.hashes[w.offsets[i] : w.offsets[i + 1]] for w in parts]) for i in range(len(b))]
            yield pa.record_batch([pa.array([len(h) for h in each], pa.int64()), pa.array([np.unique(h).view(np.int64) for h in each], pa.list_(pa.int64()))], ["n", "terms"])

    counted = given.mapInArrow(terms, "n long, terms array<long>").where("n > 0")
    n_items, n_words = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    freq = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n_shards = max(1, -(-n_words // shard_tokens))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [words(b.column(c), NON_WORD) for c in (1, 2)]
            hashes = [np.unique(np.concatenate([w.hashes[w.offsets[i] : w.offsets[i + 1]] for w in parts])).view(np.int64) for i in range(len(b))]
            yield pa.record_batch([*b.columns, pa.array(hashes, pa.list_(pa.int64()))], [*b.schema.names, "terms"])

    marked = given.withColumn("shard", F.pmod(F.xxhash64("item_id", "q", "a"), F.lit(n_shards)).cast("int")).mapInArrow(dealt, "item_id long, q string, a string, shard int, terms array<long>")
    own = marked.select("shard", F.explode("terms").alias("term")).distinct().join(freq, "term").select(F.col("shard").alias("of"), "term", "df")

    def build(key: tuple, rows: pa.Table, df: pa.Table) -> pa.Table:
        rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("item_id", "q", "a")), strict=True), key=lambda r: (r[0] is not None, r))
        rows = rows if answer else [(i, *split_item(q)) for i, q, _ in rows]
        known = dict(zip(df.column("term").to_numpy().view(U64).tolist(), df.column("df").to_pylist(), strict=True))
        data = pickle.dumps(build_shard(rows, n_items, n_words / n_items, known, threshold)) if known else b""
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    return saved(marked.drop("terms").groupBy("shard").cogroup(own.groupBy("of")).applyInArrow(build, "shard int, data binary"), "test-shards")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5, min_question: float = 0.6, min_answer: float = 0.5, min_whole: float = 0.5, question: str | None = None, answer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """items: (item_id, text), or with the columns named by question and answer."""
    spark = docs.sparkSession
    texts_in_batches(spark)
    schema = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    index = shards(items, threshold, question, answer, shard_tokens).where("length(data) > 0")
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found: list[DataFrame] = []
    for row in index.orderBy("shard").toLocalIterator():  # one shard at a time
        shared = spark.sparkContext.broadcast(row["data"])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            shard = pickle.loads(shared.value)
            for batch in batches:
                at, got = [], []
                for i, j in slices(batch.column(1)):
                    for k, best, h in search(shard, batch.column(1).slice(i, j - i), threshold):
                        own = np.unique(np.concatenate([runs(h), _shorter(h)]))
                        for item, score in best.items():
                            whole, q, a = (float(np.isin(x, own).mean()) if len(x) else 1.0 for x in (shard.wholes[item], shard.questions[item], shard.answers[item]))
                            if (q >= min_question and a >= min_answer) or (not answer and whole >= min_whole):
                                at.append(i + k)
                                got.append((shard.item_ids[item], min(score, 1.0), whole, q, a))
                ids, *shares = zip(*got, strict=True) if got else [()] * 5
                yield pa.record_batch([pc.take(batch.column(0), pa.array(at, pa.int64())), pa.array(ids, pa.int64()), *(pa.array(x, pa.float64()) for x in shares)], ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        found.append(saved(source.mapInArrow(run, schema), "leaks-of-a-shard"))
        shared.destroy()  # what the shard found is written, so no executor needs it again
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def _shorter(h: np.ndarray) -> np.ndarray:
    """Runs of one to RUN - 1 words, which stand for answers that short."""
    out, parts = np.zeros(len(h), U64), []
    for j in range(min(RUN - 1, len(h))):
        out = out[: len(h) - j] * U64(0x9E3779B97F4A7C15) + h[j:]
        parts.append(out)
    return np.concatenate(parts) if parts else h
