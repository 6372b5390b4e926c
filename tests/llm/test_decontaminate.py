import random

import numpy as np
import pyarrow as pa

from faultline.llm.decontaminate import build_shard, leaks, search, split_item
from faultline.llm.shared import table
from faultline.llm.textkernel import NON_WORD, words

SF = "/root/testdata/sf0.01"


def shard_of(texts, threshold=0.5):
    rows = [(i, *split_item(t)) for i, t in enumerate(texts)]
    freq, total = {}, 0
    for _, q, a in rows:
        h = np.concatenate([words(pa.array([x]), NON_WORD).hashes for x in (q, a)])
        total += len(h)
        for t in set(h.tolist()):
            freq[t] = freq.get(t, 0) + 1
    return build_shard(rows, len(rows), total / len(rows), freq, threshold)


def test_wand_returns_every_item_above_the_threshold():
    rng = random.Random(2)
    vocab = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(600)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 30))) for _ in range(200)]
    shards = {t: shard_of(texts, t) for t in (0.05, 0.2, 0.5)}
    shard = shards[0.5]
    weights = np.zeros((len(shard.item_ids), len(shard.vocabulary)))
    for t, p in enumerate(shard.lists):
        weights[p.items, t] = p.weights
    np.testing.assert_allclose(weights.sum(1), 1)
    for _ in range(300):
        terms = sorted(rng.sample(range(len(shard.vocabulary)), rng.randint(1, 60)))
        threshold = rng.choice([0.05, 0.2, 0.5])
        shard = shards[threshold]
        score = weights[:, terms].sum(1)
        assert sorted(i for i, _ in shard.wand(terms, threshold)) == np.flatnonzero(score >= threshold).tolist()


def test_passages_miss_nothing_that_lies_in_one():
    rng = random.Random(5)
    items = [" ".join(f"t{rng.randrange(2000)}" for _ in range(rng.randint(5, 40))) for _ in range(30)]
    shard = shard_of(items)
    for at in (0, 7, 39, 40, 41, 80, 333):
        for k in (0, 5, 29):
            text = " ".join(["filler"] * at + [items[k]] + ["end"] * 60)
            found = {i: best for i, best, _ in search(shard, pa.array([text, ""]), 0.5)}
            assert found[0][k] > 0.99 and 1 not in found


def test_search_equals_scoring_every_passage():
    rng = random.Random(8)
    vocab = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(900)]
    shard = shard_of([" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 25))) for _ in range(80)])
    weights = np.zeros((len(shard.item_ids), len(shard.vocabulary)))
    for t, p in enumerate(shard.lists):
        weights[p.items, t] = p.weights
    texts = ["", "zz", *(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 300))) for _ in range(60))]
    got = {i: best for i, best, _ in search(shard, pa.array(texts), 0.5)}
    for i, text in enumerate(texts):
        h = words(pa.array([text]), NON_WORD).hashes
        want = {}
        for a in range(0, max(1, len(h) - shard.length), shard.length):
            terms = np.isin(shard.vocabulary, h[a : a + 2 * shard.length])
            for item in np.flatnonzero(weights[:, terms].sum(1) >= 0.5 - 1e-9):
                want[int(item)] = max(want.get(int(item), 0), weights[item, terms].sum())
        assert got.get(i, {}).keys() == want.keys()
        for item, score in want.items():
            assert abs(got[i][item] - score) < 1e-9


def test_planted_items_are_found_and_only_they(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark").collect()
    norm = lambda t: " " + " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()) + " "
    want = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items if norm(i["text"]) in norm(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in leaks(docs, table(spark, SF, "benchmark")).collect()}
    assert want and got == want
    sharded = leaks(docs, table(spark, SF, "benchmark"), shard_tokens=300)
    assert {(r["doc_id"], r["item_id"]) for r in sharded.collect()} == want


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "What is the tallest hill here? Mount Example."), (2, None), (None, "unit words alone stand"), (3, "What is the tallest hill here? Mount Example.")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (None, "He asked: what is the tallest hill here? mount example, they said", 0.0), (4, "unit words alone stand", 0.0), (4, "unit words alone stand", 0.0), (5, "a " * 100_000, 0.0)], "doc_id long, text string, score double")
    got = sorted(((r["doc_id"] or 0, r["item_id"] or 0) for r in leaks(docs, items).collect()))
    assert got == [(0, 1), (0, 3), (4, 0), (4, 0)]
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


def test_copies_without_the_first_or_the_last_sentence(spark):
    rng = random.Random(9)
    items = [[" ".join(f"u{rng.randrange(10**6)}" for _ in range(12)) + "." for _ in range(4)] for _ in range(5)]
    docs = [(10 * k + j, "filler words here. " + " ".join(x) + " and an end") for k, item in enumerate(items) for j, x in enumerate((item, item[1:], item[:-1], item[:1]))]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(10 * k + j, k) for k in range(5) for j in range(3)]


def test_a_question_and_its_answer_apart_are_a_leak(spark):
    rng = random.Random(10)
    new = lambda n: " ".join(f"z{rng.randrange(10**6)}" for _ in range(n))
    question, answer = new(12) + "?", new(3)
    items = spark.createDataFrame([(1, f"{question} {answer}", question, answer)], "item_id long, text string, q string, a string")
    docs = spark.createDataFrame([(1, f"{question} well {answer}"), (2, question), (3, f"{new(9)} {answer} {new(9)}")], "doc_id long, text string")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(leaks(docs, items)) == [1, 2]  # one text: the question alone is most of it
    assert ids(leaks(docs, items, question="q", answer="a")) == [1]
