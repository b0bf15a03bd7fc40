"""Words, shingles and per-document sums over the UTF-8 bytes of an Arrow text column, as whole-array numpy steps.

A word is a run of anything but ASCII white space; A-Z are lower-cased. Texts are taken in slices of bounded
size, so memory follows the slice or the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from stockweave.llm.tokens import forget

#: Working arrays take some hundred bytes a byte of the slice.
SLICE_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[SPACE] = 0
_BASE = np.uint64(int(_RNG.integers(0, 1 << 63)) * 2 + 1)
_POWERS = np.cumprod(np.full(1 << 12, _BASE, np.uint64), dtype=np.uint64)
_PLACES = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shift and multiply, twice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trimmed(run: Callable[[Iterator], Iterator], encodes: bool = False) -> Callable[[Iterator], Iterator]:
    """run, giving freed memory back to the system at a task's end: workers live on and serve other stages.

    A run that does not encode drops the worker's encoders first.
    """

    def again(batches):
        if not encodes:
            forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return again


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row count, bytes, row offsets in them); null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        yield row, last - row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def sums(values: np.ndarray, offsets: np.ndarray, op=np.add) -> np.ndarray:
    """op over each row's values; 0 for rows without any."""
    out = np.zeros(len(offsets) - 1, values.dtype if values.dtype != bool else np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = op.reduceat(values, offsets[full], dtype=out.dtype)
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, offset of each row's first word, start of each word); apart marks the bytes between words."""
    global _POWERS
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), np.zeros(0, np.int64)
    space = apart[data]
    start = ~space
    start[1:] &= space[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    start[firsts] |= ~space[firsts]
    at = np.flatnonzero(start)
    word_offsets = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), word_offsets, at
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], at]), np.diff(np.concatenate([[0], at, [len(data)]])))
    place[space] = 0
    longest = int(place.max()) + 1
    if longest > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * longest, _BASE, np.uint64), dtype=np.uint64)
    terms = _BYTE[_LOWER[data] if lower else data] * _POWERS[place]
    if apart is not SPACE:
        terms[space] = 0
    return mixed(np.add.reduceat(terms, at)), word_offsets, at


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of every run of width words of a row, row offsets); a shorter row is one shingle, an empty one none."""
    counts = np.diff(offsets)
    n_out = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(n_out)])
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    runs = np.zeros(len(words), np.uint64)
    for j in range(width):
        runs += padded[j : j + len(words)] * _PLACES[j]
    first = np.repeat(offsets[:-1], n_out) + np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1], n_out)
    out = runs[first]
    short = np.flatnonzero((counts > 0) & (counts < width))
    for r in short.tolist():
        run = words[offsets[r] : offsets[r + 1]]
        out[out_offsets[r]] = np.append(run * _PLACES[: len(run)], _PLACES[5 + len(run) : 6 + len(run)]).sum(dtype=np.uint64)
    return mixed(out), out_offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, sorted."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.concatenate(parts) if parts else values[:0], np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
