import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultline.llm.queries import TOKENIZER
from faultline.llm.shared import table
from faultline.llm.token_counts import MASKED, TokenTree, apply_edits, count_tokens, edit_tokens, leaf_arrays, masked_token_counts, masking_edits
from faultline.llm.token_files import encoder
from tests.llm.thue_morse import pair

PLAIN = Tokenizer.from_file(TOKENIZER)
count = lambda t: len(PLAIN.encode(t, add_special_tokens=False).ids)


def edited(text, edits):
    out, done, at, skipped = [], 0, 0, 0
    for a, b, new in sorted(edits, key=lambda e: (e[0], e[1])):
        a, b = max(a, 0), min(max(b, a), len(text))
        if a < done or a > len(text):
            skipped += 1
            continue
        out += [text[at:a], new]
        at = done = b
    return "".join(out) + text[at:], skipped


ALPHABET = st.sampled_from("ab' \n é1!,中")


def tree_of(text):
    chars, tokens, _ = leaf_arrays(encoder(TOKENIZER), pa.array([text]))
    return TokenTree.of(chars, tokens)


EDITS = st.lists(st.tuples(st.integers(0, 400), st.integers(0, 30), st.text(ALPHABET, max_size=8)), max_size=6).map(lambda x: [(a, a + n, new) for a, n, new in x])


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=400), st.lists(EDITS, min_size=1, max_size=3))
def test_edits_count_as_whole_texts(text, rounds):
    tree = tree_of(text)
    for edits in rounds:  # one tree goes through all rounds
        want, skipped = edited(text, edits)
        text, _, left_out = apply_edits(encoder(TOKENIZER), text, tree, edits)
        assert (text, tree.tokens, tree.chars, left_out) == (want, count(want), len(want), skipped)
        tree = TokenTree.read(tree.stored())


def test_long_text_is_not_encoded_again():
    rng = random.Random(1)
    text = " ".join(f"word{rng.randrange(999)}" for _ in range(20_000))
    tree = tree_of(text)
    for start in (0, 5, 70_000, len(text) - 3, len(text)):
        edits = [(start, start + 2, "new text here"), (start // 2, start // 2, "in")]
        want = edited(text, edits)[0]
        text, encoded, _ = apply_edits(encoder(TOKENIZER), text, tree, edits)
        assert (text, tree.tokens) == (want, count(want)) and encoded < 2500


def test_long_texts_take_seconds(spark):
    import time

    texts = ["a@b" + ".b" * 1_000_000, "letters " + "x" * 5_000_000, "1.2.3.4 " * 200_000, "a.b" * 500_000]
    began = time.time()
    got = masking_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).selectExpr("doc_id", "size(edits) n").collect()
    assert {r["doc_id"]: r["n"] for r in got} == {0: 1, 1: 0, 2: 200_000, 3: 0} and time.time() - began < 60
    began, tree = time.time(), tree_of(texts[2])
    after, _, _ = apply_edits(encoder(TOKENIZER), texts[2], tree, [(i, i + 7, "<address>") for i in range(0, len(texts[2]), 8)])
    assert after == "<address> " * 200_000 and tree.tokens == count(after) and time.time() - began < 60


def test_tree_sums():
    tree = TokenTree.of(np.array([3, 4, 5]), np.array([1, 2, 3]))
    assert (tree.chars, tree.tokens, tree.find(0), tree.find(3), tree.find(11)) == (12, 6, (0, 0), (1, 3), (2, 7))
    tree.put(1, 10, 5)
    assert (tree.chars, tree.tokens, tree.find(12)) == (18, 9, (1, 3))


def test_masked_counts(spark):
    import re

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r["doc_id"]: r for r in masked_token_counts(docs, TOKENIZER).collect()}
    for r in docs.collect():
        spans = [(m.start(), m.end(), new) for p, new in MASKED for m in re.finditer(p, r["text"])]
        own = got[r["doc_id"]]
        assert (own["n_tokens"], own["n_edits"], own["n_tokens_after"]) == (count(r["text"]), len(spans), count(edited(r["text"], spans)[0]))


def test_masks():
    import re

    found = lambda t: [t[m.start() : m.end()] for p, _ in MASKED for m in re.finditer(p, t)]
    assert found("to a.b+c@x-y.org, or d@e (f@g.h.) 10.0.0.1 and 1.2.3.4.5 or 4111111111111111 12345678901234567") == ["a.b+c@x-y.org", "f@g.h", "10.0.0.1", "1.2.3.4", "4111111111111111"]


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", []), (None, "a b", [(0, 1, None), (None, 1, "x")]), (4, "x " * 50_000, [(1, 2, "y")]), (4, "x " * 50_000, [(1, 2, "y")])]
    frame = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, edits array<struct<start:long,end:long,text:string>>, n_tokens string")
    got = edit_tokens(count_tokens(frame.drop("n_tokens"), TOKENIZER), TOKENIZER).collect()
    assert len(got) == 5
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_tokens"], by[2]["n_tokens_after"], by[None]["n_edits"], by[None]["n_tokens_after"]) == (0, 0, 1, count(" b"))
    assert by[4]["n_tokens_after"] == count("xy" + ("x " * 50_000)[2:])
    assert masked_token_counts(frame, TOKENIZER).count() == 5 and masked_token_counts(frame.limit(0), TOKENIZER).count() == 0


def test_texts_that_polynomials_confuse(spark):
    rows = [(i, t) for i, t in enumerate(t for bits in range(10, 15) for t in pair(bits))]
    for own in (rows, rows[::-1]):
        encoder(TOKENIZER).clear()
        chars, tokens, offsets = leaf_arrays(encoder(TOKENIZER), pa.array([t for _, t in own]))
        assert [int(tokens[a:b].sum()) for a, b in zip(offsets[:-1], offsets[1:])] == [count(t) for _, t in own]
