"""Fingerprints and components against plain Python."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from faultline.llm.shared import Scratch, table
from faultline.llm.simhash import components, embedding, differing, links, simhash_components

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", fold)
    runs = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    ones = np.zeros(64, int)
    for r in runs:
        h = xxhash.xxh64_intdigest(" ".join(r).encode(), seed=42)
        ones += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(runs))


def plain_components(fps):
    """fps: list of ints; for each the index of its component's first."""
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    x = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 2) + i + 1:
            a, b = sorted((top(i), top(int(j))))
            up[b] = a
    return [top(i) for i in range(len(fps))]


def check(df, rows):
    """rows: (doc_id, text) with distinct ids."""
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(fps)
    low = {}
    for (d, _), c in zip(rows, comp):
        low[c] = min(low.get(c, d), d)
    want = {(d, f"{f:016x}", low[c]) for (d, _), f, c in zip(rows, fps, comp)}
    got = [tuple(r) for r in df.collect()]
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    assert len(got) == len(rows) and set(got) == want


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    check(simhash_components(docs), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_texts(spark):
    texts = [None, "", " \t\n\x0b", "One", "one", "ONE  two", "one\ttwo", "a b c", "A\x0cB\r\nC", "é É b c d", "ÄB c d e", "x\x00y z w v", "x " * 50_000, "zz " * 3 + "b " * 9_000, "a b c d"]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, comp int")
    check(simhash_components(df), [r[:2] for r in rows])
    assert simhash_components(df.limit(0)).count() == 0
    again = df.unionByName(df.limit(1)).unionByName(spark.createDataFrame([(None, "lonely words that nobody has", "", 0)], df.schema))
    got = simhash_components(again)
    assert got.count() == len(rows) + 2 and [r[0] for r in got.where("doc_id is null").select("component_id").collect()] == [None]


@pytest.mark.parametrize("cell", [256, 3])
def test_links_of_crowded_cells(spark, cell):
    """Around few centres; the second way sends most through the crowded cells."""
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(c) for c in centres} | {0, (1 << 64) - 1, 1 << 63}
    for c in centres:
        for _ in range(150):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            fps.add(int(c) ^ sum(1 << int(b) for b in flips))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    with Scratch(spark) as tmp:
        comp = {r.id: r.comp for r in components(links(df, tmp, cell), tmp).collect()}
    want = plain_components(fps)
    groups = {}
    for f, c in zip(signed, want):
        groups.setdefault(c, []).append(f)
    for g in groups.values():
        assert {comp.get(f, f) for f in g} == {min(g)}


def test_embedding_bounds_the_distance(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(a) ^ (1 << int(b) if b < 63 else 0)) for a, b in zip(rng.integers(-(1 << 62), 1 << 62, 200), rng.integers(0, 64, 200))] + [(int(a), int(b)) for a, b in rng.integers(-(1 << 62), 1 << 62, (200, 2))]
    df = spark.createDataFrame(pairs, "a long, b long")
    ones = lambda x: np.array([bin((x >> 2 * s) & 3).count("1") for s in range(32)])
    for a, b, d in df.select("a", "b", differing(embedding(F.col("a")), embedding(F.col("b")))).collect():
        assert d == np.abs(ones(a) - ones(b)).sum() <= bin((a ^ b) & (1 << 64) - 1).count("1")
