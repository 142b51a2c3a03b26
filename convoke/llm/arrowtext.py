"""Texts of Arrow batches as byte arrays: words, their hashes and runs, by numpy.

A batch's texts are one byte buffer with offsets, so segmentation and hashing
run over the buffer and never make a Python string per word.  Work goes in
blocks of a fixed number of bytes: memory does not depend on how long a text is,
but for one word longer than a block.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_U = np.uint64
#: An odd multiplier and its inverse modulo 2**64: the base of the rolling hash.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _table(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, 0 to n - 1 at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(BLOCK + 1, 1 << (n - 1).bit_length())
        _powers[:] = [np.concatenate([[_U(1)], np.multiply.accumulate(np.full(size, x, _U))]) for x in (_BASE, _INVERSE)]
    return _powers


def charset(pattern: bytes, within: bool = True) -> np.ndarray:
    """256 flags: 1 for the bytes listed (or, with within=False, for all others)."""
    flags = np.full(256, 0 if within else 1, np.uint8)
    flags[list(pattern)] = 1 if within else 0
    return flags


#: Words are what stands between these: space and the controls 9 to 13.
NOT_SPACE = charset(bytes([32, *range(9, 14)]), within=False)
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def blocks(data: np.ndarray, offsets: np.ndarray, flags: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Cuts of the buffer that split no word."""
    at, end = 0, len(data)
    while at < end:
        to = min(end, at + size)
        while to < end:
            tail = np.flatnonzero(flags[data[max(at, to - size) : to]] == 0)
            if len(tail):
                to = max(at, to - size) + int(tail[-1]) + 1
                break
            k = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[k] > at:
                to = int(offsets[k])
                break
            to = min(end, to + size)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, flags: np.ndarray = NOT_SPACE, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words, and the words' bounds per text.

    A word is a maximal run of flagged bytes within one text.  ``fold`` maps
    bytes before hashing.  Equal words have equal hashes in every batch.
    """
    starts, ends, hashes = [], [], []
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    for a, b in blocks(data, offsets, flags):
        block = data[a:b]
        inside = flags[block].astype(bool)
        new = edge[a : b + 1]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | new[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | new[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _table(len(block) + 1)
        sums = np.zeros(len(block) + 1, _U)
        np.cumsum(((block if fold is None else fold[block]).astype(_U) + _U(1)) * up[: len(block)], out=sums[1:])
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(_U)))
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    s = np.concatenate(starts)
    return s, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(s, offsets)


def rolled(hashes: np.ndarray, n: int, base: int = _BASE) -> np.ndarray:
    """Hash of the n hashes from each position on, len - n + 1 of them (none if fewer)."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    out = np.zeros(len(hashes) - n + 1, _U)
    for k in range(n):
        out = out * _U(base | 1) + hashes[k : k + len(out)]
    return mix(out)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between neighbouring bounds, in exact order and 0 for none."""
    if not len(values):
        return np.zeros(len(bounds) - 1, values.dtype)
    padded = np.concatenate([values, np.zeros(1, values.dtype)])
    out = np.add.reduceat(padded, bounds[:-1])
    out[bounds[1:] == bounds[:-1]] = 0
    return out


def slices(table: pa.Table | pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text, a row at least."""
    for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
        if not batch.num_rows:
            continue
        _, at = buffers(batch.column(column))
        k = 0
        while k < batch.num_rows:
            to = max(k + 1, int(np.searchsorted(at, at[k] + size, "right")) - 1)
            yield batch.slice(k, to - k)
            k = to


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trimmed() -> None:
    """Gives memory that a worker has freed back to the machine: Arrow's pool and, where the C library can, the heap."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
