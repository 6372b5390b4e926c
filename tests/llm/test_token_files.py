import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultline.llm.queries import TOKENIZER
from faultline.llm.token_files import encoder, shard_cuts, token_files
from tests.llm.thue_morse import pair

PLAIN = Tokenizer.from_file(TOKENIZER)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab' \n\t  é1!,中\r"), max_size=30), max_size=6))
def test_chunks_encode_as_whole_texts(texts):
    ids, at = encoder(TOKENIZER).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_texts_that_polynomials_confuse():
    texts = [t for bits in range(10, 15) for t in pair(bits)]
    encoder(TOKENIZER).clear()
    for batch in (texts, texts[::-1]):
        ids, at = encoder(TOKENIZER).encode(pa.array(batch))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [PLAIN.encode(t, add_special_tokens=False).ids for t in batch]


def test_files_hold_every_text(spark):
    texts = {3: "One two  three\n", 1: "", 7: None, 5: "déjà vu " * 3000, -2: "x" * 50_000, 4: "a b"}
    rows = [(k, v, "t") for k, v in texts.items()] + [(4, "a b", "again"), (None, "no id", "n")]
    got = token_files(spark.createDataFrame(rows, "doc_id long, text string, start string"), TOKENIZER, length=64).collect()
    assert len(got) == len(rows)
    at = 0
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = PLAIN.encode(text or "", add_special_tokens=False).ids + [2]
        assert (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) in [tuple(r) for r in got]
        at += len(ids)


def test_empty_table(spark):
    assert token_files(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


def test_shards_hold_like_bytes(spark):
    rng = np.random.default_rng(4)
    rows = [(int(d), "x" * int(n)) for d, n in zip(rng.permutation(5000) ** 2, rng.pareto(1.5, 5000) * 100)]
    docs = spark.createDataFrame([*rows, (None, "y")], "doc_id long, text string").repartition(5)
    cuts = shard_cuts(docs, shards=20)
    sizes = np.bincount(np.searchsorted(cuts, [d for d, _ in rows], "right"), [len(t) + 8 for _, t in rows])
    largest = max(len(t) for _, t in rows)
    assert len(sizes) == len(cuts) + 1 and sizes.max() <= sizes.sum() / 20 + 2 * largest
    assert shard_cuts(docs.where("doc_id is null")) == []
