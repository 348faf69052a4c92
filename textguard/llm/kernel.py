"""Vectorised text kernels that run inside Arrow batches.

Texts stay in the byte buffer that Arrow delivers; words, shingles and their 64-bit names come from prefix
sums over that buffer, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

try:  # glibc: large arrays go back to the system as soon as they are free, which keeps reused workers small
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
    _LIBC.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())
except (OSError, AttributeError):
    _LIBC = None

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_MUL = _RNG.integers(0, 2**31, 1024, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, 1024, dtype=np.uint32)

#: Byte classes: word bytes are ASCII letters and digits and all bytes of multi-byte characters.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False

CHUNK = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = 1 << max(20, int(n).bit_length())
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if off is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offsets


def slices(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of at most `limit` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
    if _LIBC:
        _LIBC.malloc_trim(0)


def spans(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of a class within rows: starts, ends, and per row the first span's index (n + 1)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    on = table[buf]
    before = np.empty_like(on)
    before[0], before[1:] = False, on[:-1]
    inner = offsets[:-1][offsets[:-1] < len(buf)]
    before[inner] = False
    starts = np.flatnonzero(on & ~before)
    after = np.empty_like(on)
    after[-1], after[:-1] = False, on[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(on & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash."""
    p = np.empty(len(buf) + 1, np.uint64)
    p[0] = 0
    np.cumsum(_BYTES[buf] * _powers(len(buf) + 1)[0][: len(buf)], out=p[1:])
    return p


def name(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of the ranges, equal for equal content."""
    return mix((p[ends] - p[starts]) * _powers(len(p))[1][starts] + (ends - starts).astype(np.uint64))


def grams(words: np.ndarray, bounds: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the n-grams of each row, the index of their first word, and each row's first n-gram (rows + 1).

    A row of fewer words gives one shorter gram if `short`, else none.
    """
    lens = np.diff(bounds)
    counts = np.maximum(lens - n + 1, (lens > 0).astype(lens.dtype) if short else 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(first[-1]) + np.repeat(bounds[:-1] - first[:-1], counts)
    end = np.minimum(at + n, np.repeat(bounds[1:], counts))
    p = np.empty(len(words) + 1, np.uint64)
    p[0] = 0
    np.cumsum(words * _powers(len(words) + 1)[0][: len(words)], out=p[1:])
    return name(p, at, end), at, first


def minhash(names: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """k minimum hashes (uint32) of each row that has names; rows without are left out."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), k), np.uint32)
    if len(starts):
        x = (names >> np.uint64(32)).astype(np.uint32)
        g = np.empty_like(x)
        for j in range(k):
            np.multiply(x, _MUL[j], out=g)
            g += _ADD[j]
            out[:, j] = np.minimum.reduceat(g, starts)
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """Keys (int64) of the bands of `rows` minimum hashes; a key holds the band's number."""
    n, k = signature.shape
    s = signature[:, : k // rows * rows].astype(np.uint64).reshape(n, k // rows, rows)
    acc = np.broadcast_to(mix(np.arange(s.shape[1], dtype=np.uint64) + np.uint64(77)), s.shape[:2]).copy()
    for r in range(rows):
        acc = mix(acc ^ (s[:, :, r] + np.uint64(_BASE)))
    return acc.view(np.int64)
