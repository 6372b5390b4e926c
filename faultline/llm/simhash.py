"""SimHash near-dedup by a segment-popcount embedding (operator 12).

Text -> words (A-Z folded, white space separates) -> shingles of three words, repeats included ->
XXH64 of each -> a fingerprint whose bit is 1 where over half of the hashes have it.

1. Fingerprints are made once for each row; rows of one fingerprint go on as one.
2. Embedding. A fingerprint's 32 segments of two bits become the number of ones in each. Moving a
   bit moves one number by one, so the Manhattan distance of two embeddings is at most the
   fingerprints' Hamming distance. Numbers are kept in unary (0, 1, 2 as 00, 01, 11), so that the
   distance is the number of bits in which two embeddings differ.
3. Grid. The segments form GROUPS groups. Two embeddings within `radius` differ in `radius` groups
   at most, so they agree on the remaining ones whatever these are: a cell is a choice of groups and
   the numbers in them. Fingerprints meet in cells, pairs beyond the Manhattan bound go, and the
   rest is verified on the fingerprints.
4. Cells of more than CELL fingerprints (many texts around one) would make too many pairs. Their
   members meet exactly by their neighbours instead: two fingerprints within two bits share one that
   is at most one bit from each, and no more than 65 can meet there.
5. Components by label propagation over tables; each row gets the smallest doc_id of its component.

Result: doc_id, fingerprint (16 hex digits), component_id for each row.

Defined results: null and word-less texts have the fingerprint zero, which links like any other; one
or two words are a shingle; repeated rows get a row each; null doc_ids are never a component's id
unless it has no other; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.near_dup import components
from faultline.llm.shared import Scratch, saved, texts_in_batches
from faultline.llm.textkernel import SPACE, slices, text_bytes

WORDS, SEED, RADIUS = 3, 42, 2
GROUPS = 6
#: Fingerprints of one cell whose pairs are tried.
CELL = 256
_LOW = 0x5555555555555555
#: Hashes whose bits are counted at once.
_AT_ONCE = 1 << 16


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every shingle, offsets): those of text i are offsets[i]:offsets[i + 1]."""
    raw, offs = text_bytes(texts)
    folded = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    gap = SPACE[folded]
    # words keep one space between them, whatever parted them
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | edge[:-1])) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]]) | edge[1:])) + 1 if len(raw) else np.zeros(0, np.int64)
    folded = folded.copy()
    folded[gap] = 32
    data = folded.tobytes()
    of = np.searchsorted(starts, offs)
    n_words = np.diff(of)
    n = np.where(n_words >= WORDS, n_words - WORDS + 1, (n_words > 0).astype(np.int64))
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(of[:-1], n)
    last = np.minimum(first + WORDS, np.repeat(of[1:], n)) - 1
    a, b = starts[first], ends[last]
    plain = (b - a) == np.concatenate([[0], np.cumsum(ends - starts)])[last + 1] - np.concatenate([[0], np.cumsum(ends - starts)])[first] + (last - first)
    digest = xxhash.xxh64_intdigest
    out = np.array([digest(data[i:j], SEED) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.uint64)
    for k in np.flatnonzero(~plain).tolist():  # more than one separator between words
        out[k] = digest(b" ".join(data[a[k] : b[k]].split()), SEED)
    return out, np.concatenate([[0], np.cumsum(n)])


def fingerprints_of(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A bit is 1 if over half of a text's hashes have it; no hash: 0."""
    ones = np.zeros((len(offsets) - 1, 64), np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for i in range(0, len(hashes), _AT_ONCE):
        bits = np.unpackbits(hashes[i : i + _AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = doc[i : i + _AT_ONCE]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > np.diff(offsets)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row; fp is a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(1)):
                fp = fingerprints_of(*shingle_hashes(batch.column(1).slice(i, j - i)))
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    texts_in_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def embedding(fp: Column) -> Column:
    """The ones of each two-bit segment in unary: the lower bit if there is any, the upper if both."""
    right = F.shiftrightunsigned(fp, 1)
    low = F.lit(_LOW)
    return fp.bitwiseOR(right).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(right).bitwiseAND(low), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cell_masks(radius: int = RADIUS, groups: int = GROUPS) -> list[int]:
    """For each choice of all but `radius` groups of segments the bits of its numbers."""
    bits = [reduce(int.__or__, (3 << 2 * s for s in range(32) if s % groups == g)) for g in range(groups)]
    return [_signed(reduce(int.__or__, choice)) for choice in combinations(bits, groups - radius)]


def links(fps: DataFrame, tmp: Scratch, cell: int = CELL) -> DataFrame:
    """(a, b), distinct fingerprints (fp) that connect just those within RADIUS bits: the pairs themselves, or in crowded cells what leads from one to the other."""
    cells = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("point").bitwiseAND(F.lit(m)).alias("numbers")) for i, m in enumerate(cell_masks())])
    met = tmp.saved(fps.select("fp", embedding(F.col("fp")).alias("point")).select("fp", "point", F.explode(cells).alias("c")).select("fp", "point", "c.choice", "c.numbers"), "cells")
    key = ["choice", "numbers"]
    sizes = met.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = tmp.saved(met.join(sizes, key), "shared-cells")
    sparse = shared.where(F.col("n") <= cell)
    one, other = (sparse.select(*key, F.col("fp").alias(f), F.col("point").alias(p)) for f, p in (("a", "pa"), ("b", "pb")))
    near = (F.col("a") < F.col("b")) & (differing(F.col("pa"), F.col("pb")) <= RADIUS) & (differing(F.col("a"), F.col("b")) <= RADIUS)
    found = one.join(other, key).where(near).select("a", "b").distinct()
    crowd = shared.where(F.col("n") > cell).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    around = crowd.select("fp", F.explode(flips).alias("middle"))
    hubs = around.groupBy("middle").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
    crowded = hubs.select("a", F.explode("all").alias("b")).where("a <> b").distinct()
    return tmp.saved(found.unionByName(crowded).distinct(), "links")


def simhash_components(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; see the module's text."""
    with Scratch(docs.sparkSession) as tmp:
        rows = tmp.saved(fingerprints(docs), "fingerprints")
        least = tmp.saved(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
        comp = components(links(least.select("fp"), tmp, cell), tmp)
        of_fp = least.join(comp.withColumnRenamed("id", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
        named = of_fp.groupBy("comp").agg(F.min("low").alias("component_id"))
        of_fp = of_fp.join(named, "comp").select("fp", "component_id")
        out = rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
        return saved(out, "simhash")
