import random
from collections import Counter

import numpy as np
import pyarrow as pa

from faultline.llm.near_dup import near_duplicates, prob_jaccard, prob_minhash, similarity, weighted_sets
from faultline.llm.textkernel import mix


def brute_pj(a: dict, b: dict) -> float:
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def test_probability_jaccard_and_its_estimate():
    rng = random.Random(3)
    for _ in range(20):
        a = {k: rng.randint(1, 5) for k in rng.sample(range(40), 25)}
        b = {k: rng.randint(1, 5) for k in rng.sample(range(40), 25)}
        keys = sorted(a.keys() | b.keys())
        x, y = (np.array([d.get(k, 0) for k in keys], float) for d in (a, b))
        assert abs(prob_jaccard(x, y) - brute_pj(a, b)) < 1e-9
    s = mix(np.concatenate([np.arange(60), np.arange(30, 90)]).astype(np.uint64))
    w = np.concatenate([1 + np.arange(60) % 4, 1 + np.arange(30, 90) % 3])
    sketch = prob_minhash(s, w, np.array([0, 60, 120]), 4096)
    want = brute_pj(dict(zip(s[:60].tolist(), w[:60].tolist())), dict(zip(s[60:].tolist(), w[60:].tolist())))
    assert abs((sketch[0] == sketch[1]).mean() - want) < 0.03


def shingle_counts(text):
    words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def texts():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    out = []
    for group in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(40, 200))]
        for copy in range(rng.choice([1, 2, 4, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                own[rng.randrange(len(own))] = "edit" + str(rng.random())
            out.append(" ".join(own))
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    out += [passage + " " + " ".join(rng.choice(vocab) for _ in range(40)) for _ in range(60)]
    out += ["line one two three four five\n" * 30 + "tail a b c d e f", "line one two three four five\n" * 9 + "tail a b c d e f"]
    return out + ["a b c", "A, b c!", "a b", "", None, "...", "", "x " * 20000]


def test_classes_match_brute_force(spark):
    rows = list(enumerate(texts(), 10)) + [(None, "a b c"), (10, texts()[0])]
    got = near_duplicates(spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, id int").repartition(3)).collect()
    assert len(got) == len(rows)
    sets = {d: shingle_counts(t) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                inter, union = len(sets[a].keys() & sets[b].keys()), len(sets[a].keys() | sets[b].keys())
                if inter / union >= 0.8 or (inter / union > 0.4 and brute_pj(sets[a], sets[b]) >= 0.8):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {(r["doc_id"], r["class_id"]) for r in got if r["doc_id"] is not None} == {(d, root(d)) for d in sets}
    assert [r["class_id"] for r in got if r["doc_id"] is None] == [root([d for d, t in rows if t == "a b c"][0])]


def test_empty_table_and_short_texts(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    s, c, offs = weighted_sets(pa.array(["", "a", "a b c d e f", None]))
    assert np.diff(offs).tolist() == [0, 1, 2, 0] and similarity(np.array([1]), [], np.array([2]), []) == 0


def class_of(spark, texts):
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    return {r["doc_id"]: r["class_id"] for r in got}


def test_a_large_bucket_yields_all_its_classes(spark):
    rng = random.Random(5)  # with it each pair of a class shares a band, so that only the buckets are tested
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    passage, texts = new(300), []
    for _ in range(150):
        pair = new(25)
        texts += [" ".join(passage + pair + new(38)) for _ in range(2)]
    rng.shuffle(texts)
    sets = [shingle_counts(t).keys() for t in texts]
    want = {}
    for i, a in enumerate(sets):  # pairs only: no chains
        want[i] = min(j for j, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b))
    assert len(set(want.values())) == 150 and class_of(spark, texts) == want


def test_one_line_repeated_many_times(spark):
    texts = []
    for g in range(20):
        lines = [" ".join(f"g{g}w{k}" for k in range(i, i + 10)) for i in range(0, 110, 10)]
        texts += ["\n".join(lines), "\n".join(lines + lines[-1:] * 59)]
    assert class_of(spark, texts) == {i: i - i % 2 for i in range(40)}


def test_sql_gives_the_same_rows(spark):
    import duckdb

    from faultline.llm.queries import op5_near_duplicates, oracle_sql

    sf = "/root/testdata/sf0.01"
    got = op5_near_duplicates(spark, sf)
    duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    want = duckdb.sql(oracle_sql()["op5_near_duplicates"])
    rows = sorted(want.fetchall())
    assert sorted(got.columns) == sorted(want.columns) and sorted(tuple(r) for r in got.select(*want.columns).collect()) == rows
    assert len({c for _, c in rows}) < len(rows)
