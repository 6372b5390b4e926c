import math
import re
import zlib
from collections import Counter

import numpy as np

from faultline.llm.lm import BETA, LogFrequencyFilter, build_filter, count_of, levels, lm_scores, next_probability, train, word_probability
from faultline.llm.shared import table
from faultline.llm.textkernel import mix
from tests.llm.thue_morse import pair

SF = "/root/testdata/sf0.001"


def toks(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", folded), None]


def brute(rows):
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    count = Counter(t for d, text in rows if not out(d) for t in toks(text))
    n, v = sum(count.values()), len(count)
    base = lambda text: sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks(text))
    return {d: (out(d), len(toks(t)), sum(count[x] > 0 for x in toks(t)), n, base(t)) for d, t in rows}


def same(rows, got, **_):
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert abs(r["base_score"] - w[4]) <= 1e-9 * abs(w[4]) + 1e-9
        assert r["score"] < 0


def test_base_counts_match_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    same(rows, lm_scores(docs).collect())
    same(rows, lm_scores(docs, top=50).collect())  # most words take the join


def test_words_that_polynomials_confuse(spark):
    texts = [t for bits in range(10, 15) for t in pair(bits)]
    rows = [(i, t) for i, t in enumerate(texts * 2)] + [(100 + i, f"{a} {b} {a.upper()}") for i, (a, b) in enumerate([pair(10), pair(12)])]
    same(rows, lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "É a B\tb\u00a0c " * 20_000), (None, "a b c"), (7, " \n ")]
    frame = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    same(rows, lm_scores(frame).collect())
    assert lm_scores(frame.limit(0)).count() == 0
    twice = lm_scores(frame.unionAll(frame)).collect()
    assert len(twice) == 10 and len({(r["doc_id"], r["score"]) for r in twice}) == 5


def test_filter_reads_back_quantised_counts(spark):
    rng = np.random.default_rng(3)
    keys = mix(np.arange(1, 20_001, dtype=np.uint64))
    c = np.ceil(rng.pareto(0.8, len(keys)) * 3 + 1).astype(np.int64)
    frame = spark.createDataFrame(list(zip(keys.view(np.int64).tolist(), c.tolist())), "h long, c long")
    f = build_filter([frame], 4.0)
    got, kept = f.counts(keys), c >= 4
    assert isinstance(f, LogFrequencyFilter)
    level = np.where(got > 0, levels(got, 4.0), 0)
    true = np.where(kept, levels(c, 4.0), 0)
    assert (level[kept] >= true[kept]).all()  # never below: probes have no false negatives
    assert np.mean(level == true) > 0.97
    assert np.mean(f.counts(mix(np.arange(10**6, 10**6 + 50_000, dtype=np.uint64))) > 0) < 0.03


def test_the_model_beats_the_base_on_ordered_text(spark):
    rows = [(i, "one two three four five six seven eight nine ten " * 30) for i in range(60)]
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert BETA > 0 and all(r["score"] > r["base_score"] for r in got if r["held_out"])


def test_rare_ngrams_count_in_a_large_corpus(spark):
    common = [(i, "a b " * 100_000) for i in range(30)]  # 2^-22 of these tokens is more than one
    train = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 != 1)
    out = [i for i in range(1100, 1200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = [*common, (train, "once said u v w x y"), (out[0], "u v w x y"), (out[1], "u w y v x"), (out[2], "k l m n o")]
    got = {r["doc_id"]: r for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got[0]["train_tokens"] * 2.0**-22 > 1
    assert got[out[0]]["score"] > got[out[1]]["score"] + 1e-9 and got[out[1]]["score"] > got[out[2]]["score"] + 1e-9


def test_small_counts_are_exact_and_large_ones_near():
    c = np.arange(1, 100_000)
    got = count_of(levels(c, 1.0))
    assert (got[:4] == c[:4]).all() and (np.abs(got / c - 1) < 0.13).all()


def test_probabilities_of_all_next_words_sum_to_one(spark):
    texts = [r["text"] for r in table(spark, SF, "documents").collect()]
    words, pairs = Counter(), Counter()
    for t in texts:
        own = toks(t)
        words.update(own)
        pairs.update(zip([None, *own], own))
    denominator = sum(words.values()) + 0.5 * (len(words) + 1)
    seen = lambda c: count_of(levels(np.array(c), 1.0))
    p1 = dict(zip(words, word_probability(seen(list(words.values())), denominator)))
    total = sum(p1.values()) + 0.5 / denominator
    assert abs(total - 1) < 0.05
    after = Counter()
    for (v, w), c in pairs.items():  # what pairs add to the words' share
        before = seen([words[v]])
        after[v] += float((next_probability(seen([c]), before, np.array([p1[w]]), BETA) - next_probability(np.zeros(1), before, np.array([p1[w]]), BETA))[0])
    for v, extra in after.items():
        share = BETA / (float(seen([words[v]])[0]) + BETA)
        assert abs(extra + share * total - 1) < 0.13


def test_scores_follow_the_formula(spark):
    rows = [(i, t) for i, t in enumerate(["a b a b c", "b a c", "a b d", "c c a b"] * 3)]
    got = {r["doc_id"]: r["score"] for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words, pairs = Counter(), Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            words.update(toks(t))
            pairs.update(zip([None, *toks(t)], toks(t)))
    denominator = sum(words.values()) + 0.5 * (len(words) + 1)
    seen = lambda c: float(count_of(levels(np.array([c]), 1.0))[0]) if c else 0.0
    for d, t in rows:
        want = sum(math.log10((min(seen(pairs[v, w]), seen(words[v])) + BETA * (seen(words[w]) + 0.5) / denominator) / (seen(words[v]) + BETA)) for v, w in zip([None, *toks(t)], toks(t)))
        assert abs(got[d] - want) < 1e-6


def test_a_filter_too_large_to_broadcast_gives_the_same_scores(spark, monkeypatch):
    monkeypatch.setattr("faultline.llm.lm.SEGMENT_TOKENS", 1 << 12)  # many segments
    monkeypatch.setattr("faultline.llm.lm.CHUNK", 1 << 13)
    docs = table(spark, SF, "documents").repartition(3, "doc_id")
    rows = lambda f: sorted((tuple(r) for r in f.collect()), key=lambda r: r[0])
    own = rows(lm_scores(docs).select("doc_id", "n_tokens", "score"))
    model = train(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1"))
    here, there = rows(model.scores(docs)), rows(model.scores(docs, shared_bytes=0))
    assert model.filter.count() > 5 and len(own) == docs.count()
    for other in (here, there):
        assert [r[:2] for r in own] == [r[:2] for r in other]
        assert np.allclose([r[2] for r in own], [r[2] for r in other], rtol=1e-12)


def test_a_model_scores_texts_that_it_never_met(spark):
    taught = spark.createDataFrame([(i, "the quick brown fox jumps over the lazy dog") for i in range(20)], "doc_id long, text string")
    model = train(taught)
    assert (model.n, model.v) == (200, 9) and model.filter.count() == 1
    new = spark.createDataFrame([(1, "the quick brown fox"), (2, "fox brown quick the"), (3, None), (4, "unheard of words")] * 2, "doc_id long, text string")
    for bytes_ in (1 << 20, 0):
        got = [(r["doc_id"], r["n_tokens"], round(r["score"], 9)) for r in model.scores(new, shared_bytes=bytes_).collect()]
        by_id = {d: s for d, _, s in got}
        assert len(got) == 8 and len(set(got)) == 4 and by_id[1] > by_id[2] > by_id[4]
    empty = train(taught.limit(0))
    for bytes_ in (1 << 20, 0):
        assert all(r["score"] == 0 for r in empty.scores(new, shared_bytes=bytes_).collect())  # the word it never met is all there is
    assert model.scores(new.limit(0)).count() == 0
