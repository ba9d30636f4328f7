"""Vectorised text kernels shared by the Arrow stages of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

#: Bytes of text that an Arrow stage works on at once; bounds the memory of its arrays, not what it processes.
SLICE_BYTES = 2 << 20


def _random_bytes_table() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)


_CODE = _random_bytes_table()
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\f\v")] = True


def whitespace_table() -> np.ndarray:
    """Words are maximal runs of bytes other than ASCII white space."""
    t = _CODE.copy()
    t[_SPACE] = 0
    return t


def letter_table() -> np.ndarray:
    """Words are runs of ASCII letters and of bytes beyond ASCII; ASCII case is folded."""
    t = np.zeros(256, np.uint64)
    for b in range(256):
        c = chr(b).lower() if b < 128 else chr(b)
        if b >= 128 or c.isalpha():
            t[b] = _CODE[ord(c)]
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers, modulo 2^64, of the hash base or of its inverse."""
    name = "inverse" if inverse else "base"
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        p = np.full(size, _B_INV if inverse else _B, np.uint64)
        p[0] = 1
        have = np.cumprod(p, dtype=np.uint64)
        if size <= 1 << 23:
            _powers[name] = have
    return have[:n]


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `limit` bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    release()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that a finished task has freed back to the system: workers stay, and their executor's memory is shared."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the row offsets (from 0) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if kind is np.int32 and pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch of texts: byte spans, 64-bit hashes, and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        code = table[data]
        word = code != 0
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begins[inner] = word[inner]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        ends[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(code * powers(len(data)), out=total[1:])
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix((total[self.end] - total[self.start]) * powers(len(data) + 1, True)[self.start] + length)
        #: first[r] to first[r + 1] are the words of row r.
        self.first = np.searchsorted(self.start, offsets)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit fingerprint of each run of `size` consecutive hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes)), out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(n, True) + U64(size))


def scatter(indices: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges that begin at `indices` and have `lengths`."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(indices - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)
