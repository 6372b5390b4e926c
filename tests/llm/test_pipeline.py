"""The stages against brute force on a small corpus with planted cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from faultline.llm.queries import TARGETS, TOKENIZER
from faultline.llm.shared import saved, table

SF = "/root/testdata/sf0.01"
PLAIN = Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        out.append(saved(stage(spark, out[-1], SF), f"test-{k}"))
    return out


def words(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_drops_what_labels_call_bad(spark, stages):
    kept = {r["doc_id"] for r in stages[1].select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    right = [(d in kept) == bool(labels[d]) for d in held]
    assert np.mean(right) > 0.9


def test_one_of_each_class_stays(stages):
    rows = {r["doc_id"]: words(r["text"]) for r in stages[1].collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in rows.items() if w}
    counts = {d: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for d, w in rows.items() if w}
    parent = {d: d for d in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    meet: dict[tuple, list[int]] = {}
    for d, s in sets.items():
        for x in s:
            meet.setdefault(x, []).append(d)
    for pair in {(a, b) for m in meet.values() for a in m for b in m if a < b}:
        a, b = (sets[x] for x in pair)
        near = len(a & b) / len(a | b) >= 0.8
        if not near and len(a & b) / len(a | b) > 0.4:
            ca, cb = (counts[x] for x in pair)
            near = sum(1 / sum(max(ca[j] / ca[i], cb[j] / cb[i]) for j in ca.keys() | cb.keys()) for i in ca.keys() & cb.keys()) >= 0.8
        if near:
            parent[max(map(root, pair))] = min(map(root, pair))
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(d for d in rows if root(d) == d)


def test_leaks_go_and_others_stay(spark, stages):
    items = [" " + " ".join(words(r["text"])) + " " for r in table(spark, SF, "benchmark").collect()]
    before = {r["doc_id"]: " " + " ".join(words(r["text"])) + " " for r in stages[2].collect()}
    want = {d for d, t in before.items() if not any(i in t for i in items)}
    assert {r["doc_id"] for r in stages[3].collect()} == want and len(want) < len(before)


def test_mixture_meets_its_targets_and_keeps_all(stages):
    before = {r["doc_id"]: (r["lang"], len(r["text"].split())) for r in stages[3].collect()}
    after = Counter(r["doc_id"] for r in stages[4].select("doc_id").collect())
    assert after.keys() == before.keys()
    total = Counter()
    for d, n in after.items():
        total[before[d][0]] += n * before[d][1]
    for lang, share in TARGETS.items():
        assert abs(total[lang] / sum(total.values()) - share) < 0.05


def test_files_hold_the_mixture(stages):
    want = sorted((r["doc_id"], PLAIN.encode(r["text"], add_special_tokens=False).ids + [2]) for r in stages[4].collect())
    got = sorted(tuple(r) for r in stages[5].select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    at = 0
    for (doc, ids), row in zip(want, got, strict=True):
        assert row == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_odd_rows(spark):
    rng = random.Random(1)
    prose = " ".join(rng.choice(["the", "of", "rain", "hill", "and", "over"]) for _ in range(80))
    frame = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, prose, None, None, None), (4, prose, "en", "s", 3), (4, prose, "en", "s", 3), (5, prose + " end", "en", "s", 3), (6, "x" * 100_000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.near_dedup(spark, frame, SF)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [1, 2, 4, 6]
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, frame, SF).columns == frame.columns
        assert stage(spark, frame.limit(0), SF).count() == 0
    assert cp.write_tokens(spark, frame, SF).count() == 7


def test_columns_that_clash_or_are_odd_survive_every_stage(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "of", "rain", "hill", "and", "over"]) for _ in range(80)), "en", "s", 3, 77, 88, "q", {"k": 1}, 5, "t") for i in range(6)]
    rows.append(rows[0])
    names = "doc_id long, text string, lang string, source string, n_chars long, __id long, __n long, quality_score string, m map<string,int>, `a.b` long, row string"
    frame = spark.createDataFrame(rows, names)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns, name
        kept = out.collect()
        assert all((r["__id"], r["__n"], r["quality_score"], r["m"], r["a.b"], r["row"]) == (77, 88, "q", {"k": 1}, 5, "t") for r in kept), name
        if name == "MinHash near-dedup":
            assert sorted(r["doc_id"] for r in kept) == [0, 1, 2, 3, 4, 5]
    assert cp.write_tokens(spark, frame, SF).count() == 7
