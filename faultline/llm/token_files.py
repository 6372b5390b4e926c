"""Token-ID / binary output (operator 9).

Texts are encoded with the `tokenizers` library, an end id is appended, and the ids of all
documents in ascending doc_id order form one stream. The stream lies in shards (ranges of
doc_id); a shard is an Arrow IPC file (the stream format plus a footer of batch offsets) whose
batches hold two fixed-size-list columns: `ids` (equal-length sequences) and `mask` (false on
the padding of a shard's last sequence). The values of a batch are one contiguous buffer, so a
memory-mapped file gives any sequence, or any document through the index, without a copy.

Spark deals documents to shards by cut points of doc_id. Candidates for cuts are a hash sample of
the ids (CUT_SAMPLE at about, whatever the input); the bytes of text between them are counted over
all documents, and neighbouring spans are joined up to SHARD_BYTES. Each shard is a partition of
its own, sorted there and written; a file is written under a name of its own and then moved, so a
task that runs again after a lost executor replaces it by the same bytes.

Defined results: a null text is empty (only the end id); null doc_ids come first; rows that
share a doc_id keep one entry each, ordered by their ids; an empty table writes no file and
returns no row; other columns are ignored. Rows of one doc_id lie in one shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import new_dir, texts_in_batches
from faultline.llm.textkernel import SPACE, U64, slices, span_hashes, text_bytes

#: A worker's store of encoded chunks is emptied beyond this many.
CACHE_CHUNKS = 1_500_000
#: Bytes of text in a shard, and how many candidates for cuts between shards there are.
SHARD_BYTES, CUT_SAMPLE = 64 << 20, 1 << 16
#: Ids of a shard's batch in memory: sequences in a batch times their length.
BATCH_ROWS = 256

_NOT_AFTER_SPACE = SPACE.copy()
_NOT_AFTER_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # these may begin white space beyond ASCII


def chunk_starts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions where the byte-level pre-tokenizer surely begins a piece: texts' starts, and each space before a visible byte."""
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    cut[: max(n - 1, 0)] = (raw[:-1] == 0x20) & ~_NOT_AFTER_SPACE[raw[1:]]
    cut[offs[1:] - 1] = False  # a text's last byte has nothing after it
    cut[offs] = True
    cut[n] = False
    return np.flatnonzero(cut)


class ChunkEncoder:
    """Encodes texts piece by piece; a piece that this worker has met before is looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        marks = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark_id, self.mark = min(marks, default=(-1, ""))
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.clear()

    def clear(self) -> None:
        # known chunks: hashes in ascending order, and where their ids lie in the pool
        self.keys, self.first, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 18, self.dtype), 0

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        """keys: ascending and new."""
        parts, sizes = [], []
        for at in range(0, len(chunks), 10_000):
            ids, size = self._encoded(chunks[at : at + 10_000])
            parts.append(ids)
            sizes.append(size)
        ids, size = np.concatenate(parts), np.concatenate(sizes)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool) // 2, len(ids)), self.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(size, dtype=np.int64) - size
        self.used += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.size = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.size, at, size)

    def _encoded(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, how many each has). Chunks go as one text, parted by a special token, which nothing merges with."""
        if self.mark:
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.encode().join(chunks).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.int64)
            cut = np.flatnonzero(ids == self.mark_id)
            if len(cut) == len(chunks) - 1:
                return np.delete(ids, cut).astype(self.dtype), (np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1).astype(np.int32)
        # no such token, or a chunk spells it
        each = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False)]
        return np.array([x for e in each for x in e], self.dtype), np.array([len(e) for e in each], np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        raw, offs = text_bytes(texts)
        if not len(raw):
            return np.zeros(0, self.dtype), np.zeros(len(offs), np.int64)
        starts = chunk_starts(raw, offs)
        ends = np.append(starts[1:], len(raw))
        uniq, where, inverse = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > max(CACHE_CHUNKS, len(uniq)):
            self.clear()
        at = np.searchsorted(self.keys, uniq)
        new = np.flatnonzero((at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != uniq)) if len(self.keys) else np.arange(len(uniq))
        if len(new):
            data = raw.tobytes()
            self._learn(uniq[new], [data[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
        slots = np.searchsorted(self.keys, uniq)[inverse]
        n = self.size[slots].astype(np.int64)
        total = np.cumsum(n)
        ids = self.pool[np.repeat(self.first[slots] - (total - n), n) + np.arange(total[-1])]
        return ids, np.concatenate([[0], total])[np.searchsorted(starts, offs)]


@lru_cache(2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def encoded(docs: DataFrame, tokenizer: str, end_id: int, cuts: list[int]) -> DataFrame:
    """(shard, doc_id, ids) with ids as little-endian bytes, end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for i, j in slices(batch.column(1)):
                doc = batch.column(0).slice(i, j - i)
                ids, at = enc.encode(batch.column(1).slice(i, j - i))
                shard = np.searchsorted(cuts, doc.fill_null(0).to_numpy(zero_copy_only=False), "right")
                shard[doc.is_null().to_numpy(zero_copy_only=False)] = 0
                yield pa.record_batch([pa.array(shard, pa.int32()), doc, _binary([ids[a:b].tobytes() + end for a, b in zip(at[:-1], at[1:], strict=True)])], ["shard", "doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "shard int, doc_id long, ids binary")


class ShardWriter:
    """One shard's file: ids are buffered up to a batch of equal-length sequences."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, length: int):
        self.fs, base = _filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.part = f"{base}/shard-{shard:06d}.arrow", f"{base}/.part-{shard:06d}-{uuid.uuid4().hex}"
        self.length, self.dtype = length, dtype
        self.schema = pa.schema({"ids": pa.list_(pa.from_numpy_dtype(dtype), length), "mask": pa.list_(pa.bool_(), length)})
        self.sink = self.fs.open_output_stream(self.part)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0

    def add(self, ids: np.ndarray) -> int:
        at = self.n
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= BATCH_ROWS * self.length:
            self.flush()
        return at

    def flush(self, last: bool = False) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        size = BATCH_ROWS * self.length
        full = len(ids) // size * size
        for at in range(0, full, size):
            self._batch(ids[at : at + size], size)
        self.held, self.n_held = [ids[full:]], len(ids) - full
        if last and self.n_held:
            rows = -(-self.n_held // self.length)
            self._batch(np.concatenate([ids[full:], np.zeros(rows * self.length - self.n_held, self.dtype)]), self.n_held)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> None:
        self.flush(last=True)
        self.writer.close()
        self.sink.close()
        self.fs.move(self.part, self.path)


def shard_cuts(docs: DataFrame, shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> list[int]:
    """doc_ids at which shards begin, so that they hold about equal bytes of text: `shards` of them, or as many as shard_bytes asks for and as tasks can run at once."""
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    step = max(1, ids.count() // CUT_SAMPLE)
    points = np.sort(ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).distinct().toArrow().column("doc_id").to_numpy())  # about CUT_SAMPLE
    if not len(points):
        return []
    shared = spark.sparkContext.broadcast(points)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value
        total = np.zeros(len(points) + 1, np.int64)
        for b in batches:
            total += np.bincount(np.searchsorted(points, b.column(0).to_numpy(), "right"), b.column(1).to_numpy(), len(total)).astype(np.int64)
        kept = np.flatnonzero(total)
        yield pa.record_batch([pa.array(kept), pa.array(total[kept])], ["span", "bytes"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(points[0]))).alias("doc_id"), (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 8).cast("long").alias("bytes"))
    got = rows.mapInArrow(sizes, "span long, bytes long").groupBy("span").agg(F.sum("bytes").alias("bytes")).toArrow()  # a row for each candidate at most
    size = np.zeros(len(points) + 1, np.int64)
    size[got.column("span").to_numpy()] = got.column("bytes").to_numpy()
    before = np.cumsum(size) - size  # bytes before each span
    n = shards or max(-(-int(size.sum()) // shard_bytes), spark.sparkContext.defaultParallelism)
    at = np.searchsorted(before, np.arange(1, n) * (size.sum() / n))
    return np.unique(points[at[(at > 0) & (at <= len(points))] - 1]).tolist()


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, length: int = 2048, shards: int | None = None) -> DataFrame:
    """Writes the shards to folder/files and the index (shard, doc_id, at, n_tokens) to folder/index; returns the index."""
    spark = docs.sparkSession
    cuts = shard_cuts(docs, shards)
    dtype = encoder(tokenizer).dtype.str
    texts_in_batches(spark)
    files = f"{folder}/files"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at_shard = None, None
        for batch in batches:
            shard = batch.column(0).to_pylist()
            at, n = [], []
            for s, x in zip(shard, batch.column(2), strict=True):
                if s != at_shard:
                    if out:
                        out.close()
                    out, at_shard = ShardWriter(files, s, np.dtype(dtype), length), s
                own = np.frombuffer(x.as_buffer(), dtype)
                at.append(out.add(own))
                n.append(len(own))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["shard", "doc_id", "at", "n_tokens"])
        if out:
            out.close()

    index = encoded(docs, tokenizer, end_id, cuts).repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids").mapInArrow(write, "shard int, doc_id long, at long, n_tokens long")
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


class ShardReader:
    """Random access to a shard; local files are memory-mapped, so slices are views of the file."""

    def __init__(self, folder: str, shard: int):
        fs, base = _filesystem(folder)
        path = f"{base}/shard-{shard:06d}.arrow"
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.size = BATCH_ROWS * self.file.schema.field("ids").type.list_size
        self.now: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def values(self, k: int) -> np.ndarray:
        if self.now[0] != k:
            self.now = (k, self.file.get_batch(k).column(0).values.to_numpy())
        return self.now[1]

    def parts(self, at: int, n: int) -> Iterator[np.ndarray]:
        """The ids at:at+n of the shard, in order, as views of its batches."""
        while n > 0:
            k, i = divmod(at, self.size)
            part = self.values(k)[i : i + n]
            yield part
            at, n = at + len(part), n - len(part)

    def close(self) -> None:
        self.source.close()


def read_token_index(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) with the checksum of the ids read back from the files."""
    sums = sorted((r["shard"], r["n"]) for r in index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())  # a row for each shard
    base = dict(zip([s for s, _ in sums], np.cumsum([0] + [n for _, n in sums]).tolist(), strict=False))
    files = f"{folder}/files"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at_shard = None, None
        for batch in batches:
            start, crc = [], []
            for s, at, n in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if s != at_shard:
                    if reader:
                        reader.close()
                    reader, at_shard = ShardReader(files, s), s
                c = 0
                for part in reader.parts(at, n):
                    c = zlib.crc32(part.astype("<u4").tobytes(), c)
                start.append(base[s] + at)
                crc.append(c)
            yield pa.record_batch([batch.column(1), pa.array(start, pa.int64()), batch.column(3), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        if reader:
            reader.close()

    return index.repartitionById(max([0, *base]) + 1, "shard").sortWithinPartitions("shard", "at").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 2048, folder: str | None = None) -> DataFrame:
    folder = folder or new_dir(docs.sparkSession, "token-files")
    return read_token_index(write_token_files(docs, tokenizer, end_id, folder, length), folder)
