"""Edit-aware token counts (operator 8).

A document keeps a segment tree over its pre-token pieces: leaves of LEAF pieces with their
length (code points) and token count, inner nodes with sums. An edit looks up the leaves it
touches by the lengths, re-encodes only their text plus the boundary context (the leaf before, if
the edit may change where its piece ends), replaces these leaves and updates the sums above them.
Pieces begin where the pre-tokenizer surely cuts, whatever stands before, so counts of leaves add
up to the count of the whole text exactly.

count_tokens stores each document's tree (about 16 bytes for LEAF pieces); edit_tokens applies edits
to stored trees and gives the new text and its tree, so further edits start from there. A region
that edits touch becomes one leaf.

Edits are (start, end, text) in code points of the old text. They are applied as a set: in order
of start, an edit that begins before the end of one already taken is left out and counted in
n_skipped; ends beyond the text are cut to it.

Defined results: a null text is empty and has 0 tokens; null or empty edits change nothing, null
replacement text is empty; repeated rows get a row each; a null doc_id is kept; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.shared import quoted, saved, texts_in_batches
from faultline.llm.textkernel import slices, text_bytes
from faultline.llm.token_files import ChunkEncoder, chunk_starts, encoder

LEAF = 32


class TokenTree:
    """Sums of (code points, tokens) over leaves, in an array: node i has the children 2i and 2i + 1."""

    def __init__(self, sums: np.ndarray):
        self.sums, self.leaves = sums, len(sums) // 2

    @classmethod
    def of(cls, chars: np.ndarray, tokens: np.ndarray) -> TokenTree:
        leaves = max(1, 1 << max(0, int(len(chars)) - 1).bit_length())
        sums = np.zeros((2 * leaves, 2), np.int64)
        sums[leaves : leaves + len(chars), 0] = chars
        sums[leaves : leaves + len(chars), 1] = tokens
        step = leaves // 2
        while step:
            sums[step : 2 * step] = sums[2 * step : 4 * step : 2] + sums[2 * step + 1 : 4 * step : 2]
            step //= 2
        return cls(sums)

    @classmethod
    def read(cls, data: bytes) -> TokenTree:
        return cls(np.frombuffer(data, "<u4").reshape(-1, 2).astype(np.int64))

    def stored(self) -> bytes:
        return self.sums.astype("<u4").tobytes()

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, its first code point) of the leaf that holds code point `at`."""
        node, first = 1, 0
        while node < self.leaves:
            node *= 2
            if at >= first + self.sums[node, 0] and self.sums[node + 1, 0]:
                first += int(self.sums[node, 0])
                node += 1
        return node - self.leaves, first

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.leaves
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


def leaf_arrays(enc: ChunkEncoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, tokens) of all leaves of the texts, and the texts' leaf offsets."""
    raw, offs = text_bytes(texts)
    starts = chunk_starts(raw, offs)
    piece = np.searchsorted(starts, offs)
    n = np.diff(piece)
    n_leaves = -(-n // LEAF)
    leaf_offs = np.concatenate([[0], np.cumsum(n_leaves)])
    doc = np.repeat(np.arange(len(n)), n_leaves)
    first = piece[:-1][doc] + LEAF * (np.arange(len(doc)) - leaf_offs[:-1][doc])
    begin = starts[first]
    edge = np.append(begin, len(raw))
    letters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    chars = letters[edge[1:]] - letters[edge[:-1]]
    cut = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
    _, at = enc.encode(cut)
    return chars, np.diff(at), leaf_offs


def apply_edits(enc: ChunkEncoder, text: str, tree: TokenTree, edits: list[tuple[int, int, str]]) -> tuple[str, int, int]:
    """(new text, code points encoded again, edits left out); the tree becomes the new text's."""
    taken, done, skipped = [], 0, 0
    for start, end, new in sorted(edits, key=lambda e: (e[0], e[1])):
        start, end = max(start, 0), min(max(end, start), len(text))
        if start < done or start > len(text):
            skipped += 1
            continue
        taken.append((start, end, new or ""))
        done = max(end, start)
    size, regions = len(text), []
    # from the right; edits of shared leaves go together. Positions are the old text's until all is found
    while taken:
        group = [taken.pop()]
        high, at_high = tree.find(group[0][1]) if group[0][1] < size else (tree.leaves, size)
        while True:
            low, at_low = tree.find(max(group[-1][0] - 2, 0))
            if not taken or taken[-1][1] < at_low:
                break
            group.append(taken.pop())
        # the leaf that the last edit ends in is encoded up to its own end, where a piece begins anyway
        # (or whole, if it is the only one)
        whole = high < tree.leaves and (at_high < group[0][1] or high == low)
        stop, last = (at_high + int(tree.sums[high + tree.leaves, 0]), high + 1) if whole else (at_high, high)
        parts, at = [], at_low
        for start, end, new in reversed(group):
            parts += [text[at:start], new]
            at = end
        regions.append((low, last, at_low, stop, "".join([*parts, text[at:stop]])))
    counts = np.diff(enc.encode(pa.array([r[-1] for r in regions], pa.string()))[1])
    out, at = [], size
    for (low, last, start, stop, region), n in zip(regions, counts.tolist(), strict=True):
        for leaf in np.flatnonzero(tree.sums[tree.leaves + low : tree.leaves + last].any(1)).tolist():
            tree.put(low + leaf, 0, 0)
        tree.put(low, len(region), n)
        out += [text[stop:at], region]
        at = start
    return "".join(reversed([*out, text[:at]])), sum(len(r[-1]) for r in regions), skipped


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs (doc_id, text, ...) with n_tokens and `tree`, the sums of its nodes (little-endian 32-bit)."""
    texts_in_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_tokens", "tree")]
    source = docs.select(*[quoted(c) for c in names])
    at_text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            text = b.column(at_text)
            for i, j in slices(text):
                chars, tokens, offs = leaf_arrays(enc, text.slice(i, j - i))
                trees = [TokenTree.of(chars[a:z], tokens[a:z]) for a, z in zip(offs[:-1], offs[1:], strict=True)]
                yield pa.record_batch([*(c.slice(i, j - i) for c in b.columns), pa.array([t.tokens for t in trees], pa.int64()), pa.array([t.stored() for t in trees], pa.binary())], [*names, "n_tokens", "tree"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("tree", T.BinaryType())]))


def edit_tokens(counted: DataFrame, tokenizer: str) -> DataFrame:
    """counted: count_tokens' columns with `edits` array<struct<start, end, text>>; gives doc_id, text and tree after the edits, and n_tokens, n_edits, n_skipped, n_tokens_after, n_encoded. Where nothing is edited text and tree are as given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            edits = [[(e["start"], e["end"], e["text"] or "") for e in x or [] if e and e["start"] is not None and e["end"] is not None] for x in b.column(2).to_pylist()]
            after, encoded, skipped = b.column(3).to_pylist(), [0] * len(b), [0] * len(b)
            texts, trees = b.column(1).to_pylist(), b.column(4).to_pylist()
            for k, own in enumerate(edits):
                if own:
                    tree = TokenTree.read(trees[k])
                    texts[k], encoded[k], skipped[k] = apply_edits(enc, texts[k] or "", tree, own)
                    after[k], trees[k] = tree.tokens, tree.stored()
            cols = [pa.array(x, pa.int64()) for x in ([len(x) for x in edits], skipped, after, encoded)]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string()), pa.array(trees, pa.binary()), b.column(3), *cols], ["doc_id", "text", "tree", "n_tokens", "n_edits", "n_skipped", "n_tokens_after", "n_encoded"])

    texts_in_batches(counted.sparkSession)
    return counted.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "edits", "n_tokens", "tree").mapInArrow(run, "doc_id long, text string, tree binary, n_tokens long, n_edits long, n_skipped long, n_tokens_after long, n_encoded long")


#: Personal data that a release would mask: mail addresses, IPv4 addresses, runs of 13 to 16 digits. Each starts where such a
#: run starts, and none is tried again within it, so a search takes time in proportion to the text.
MASKED = (
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "<mail>"),
    (r"(?<![A-Za-z0-9_])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9_])", "<address>"),
    (r"(?<![A-Za-z0-9_])[0-9]{13,16}(?![A-Za-z0-9_])", "<number>"),
)


def masking_edits(docs: DataFrame, rules: tuple[tuple[str, str], ...] = MASKED) -> DataFrame:
    """docs (doc_id, text, ...) with `edits`, which replace each match of each rule."""
    texts_in_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "edits"]
    source, at_text = docs.select(*[quoted(c) for c in names]), names.index("text")
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(re.compile(p), new) for p, new in rules]
        for b in batches:
            edits = [[(m.start(), m.end(), new) for p, new in found for m in p.finditer(t or "")] for t in b.column(at_text).to_pylist()]
            one = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
            lists = pa.array([[{"start": a, "end": z, "text": new} for a, z, new in x] for x in edits], pa.list_(one))
            yield pa.record_batch([*b.columns, lists], [*names, "edits"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("edits", kind)]))


def masked_token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Token counts before and after masking: the trees are built once and kept in a table, masking edits them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    marked = masking_edits(count_tokens(own, tokenizer))
    # a text is kept beside its tree only where there is something to edit
    trees = saved(marked.withColumn("text", F.when(F.size("edits") > 0, F.col("text"))), "token-trees")
    return edit_tokens(trees, tokenizer).drop("text", "tree")
