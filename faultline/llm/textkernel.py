"""Word boundaries and word hashes of many texts at once, on the bytes of an Arrow column.

Separators are ASCII bytes, so UTF-8 needs no decoding. A short word's hash is a polynomial over
its bytes modulo 2**64, taken from prefix sums and then mixed. Polynomials modulo 2**64 collide on
long words of a regular build (Thue-Morse words, whatever the base), so words of over SHORT bytes
are hashed by BLAKE2b.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII that is neither a letter nor a digit.
NON_WORD = np.zeros(256, bool)
NON_WORD[:128] = [not chr(i).isalnum() for i in range(128)]

#: Bytes of a span up to which the polynomial is its hash.
SHORT = 64

_POWERS_KEPT = (1 << 20) + 1
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """At least n powers; tables for longer inputs than most are made anew, as workers keep what they hold."""
    if base not in _powers or n > _POWERS_KEPT:
        steps = np.full(max(n, _POWERS_KEPT), base, U64)
        steps[0] = 1
        steps = np.multiply.accumulate(steps)
        if n > _POWERS_KEPT:
            return steps
        _powers[base] = steps
    return _powers[base]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # other C libraries have none
    _trim = None


def release() -> None:
    """Gives freed memory back to the system: Python workers live on, and with them what they hold."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes (one row at least), which bound the arrays below."""
    _, offs = text_bytes(texts)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, end
        at = end
    release()


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """The 64-bit hash of each byte span; fold: A-Z count as a-z."""
    up, down = _powers_of(_BASE, len(raw) + 1), _powers_of(_BASE_INV, len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum((_FOLDED if fold else _BYTE)[raw] * up[: len(raw)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
    for k in np.flatnonzero(ends - starts > SHORT).tolist():
        span = raw[starts[k] : ends[k]].tobytes()
        out[k] = int.from_bytes(hashlib.blake2b(span.lower() if fold else span, digest_size=8).digest(), "little")
    return out


@dataclass
class Words:
    """Words of several texts: byte spans, hashes, and for text i the words offsets[i]:offsets[i+1]."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def words(texts: pa.Array, separators: np.ndarray = SPACE, fold: bool = True) -> Words:
    raw, offs = text_bytes(texts)
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1 : n + 1] = ~separators[raw]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(inside[1 : n + 1] & (~inside[:n] | edge[:n]))
    ends = np.flatnonzero(inside[1 : n + 1] & (~inside[2 : n + 2] | edge[1 : n + 1])) + 1
    return Words(raw, starts, ends, np.searchsorted(starts, offs), span_hashes(raw, starts, ends, fold))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of each run of k words; a shorter text that has words gives one run of all."""
    h, counts = w.hashes, w.counts
    width = np.minimum(counts, k)
    n_runs = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), n_runs)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs) + w.offsets[:-1][doc]
    out = np.zeros(len(doc), U64)
    each = width[doc]
    for j in range(k):
        if j and len(doc) and each.min() <= j:
            at = np.minimum(first + j, len(h) - 1)
            out = np.where(each > j, mix(out * U64(3) + h[at]), out)
        elif len(doc):
            out = mix(out * U64(3) + h[first + j])
    return out, doc
