"""Words of whole Arrow text columns as numpy arrays, without a Python loop over words.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D after lower-casing
A-Z; nulls count as empty. Each word gets a 64-bit hash: a polynomial hash of
its bytes (through a fixed random byte table) taken from one cumulative sum
over the buffer, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (multiply and xor-shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Words:
    """Words of rows ``first .. first + rows - 1`` of a batch, in order."""

    first: int
    rows: int
    row: np.ndarray       # row of each word, relative to first
    hash: np.ndarray      # uint64
    start: np.ndarray     # byte offsets in ``data``
    end: np.ndarray
    data: np.ndarray      # the chunk's bytes as given (not lower-cased)
    row_start: np.ndarray  # byte offset of each row in ``data``
    bounds: np.ndarray    # words of row i are bounds[i] .. bounds[i + 1]


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), offsets


def word_chunks(column, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of a text column, some rows at a time (at least one row, about ``chunk_bytes`` bytes)."""
    data, offsets = text_buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = int(np.searchsorted(offsets, offsets[at] + chunk_bytes, side="right")) - 1
        upto = min(max(upto, at + 1), n)
        yield _words(data[offsets[at]:offsets[upto]], offsets[at:upto + 1] - offsets[at], at)
        at = upto


def _words(data: np.ndarray, offsets: np.ndarray, first: int) -> Words:
    rows, n = len(offsets) - 1, len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(first, rows, none, none.astype(np.uint64), none, none, data, offsets[:-1], np.zeros(rows + 1, np.int64))
    lower = _LOWER[data]
    inside = ~_SPACE[lower]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edges[edges > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[lower] * up, out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start])
    row = np.searchsorted(offsets[1:], start, side="right")
    return Words(first, rows, row, hashes, start, end, data, offsets[:-1],
                 np.searchsorted(row, np.arange(rows + 1), side="left"))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` words: (hash, row, index of the first word); none crosses a row."""
    if len(w.hash) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = w.hash[:len(w.hash) - n + 1].copy()
    for k in range(1, n):
        total *= _STEP
        total += w.hash[k:len(w.hash) - n + 1 + k]
    at = np.flatnonzero(w.row[:len(total)] == w.row[n - 1:])
    return mix(total[at] + np.uint64(n)), w.row[at], at


def run_hash(hashes: np.ndarray) -> np.uint64:
    """The gram hash of one whole word sequence."""
    total = np.zeros(1, np.uint64)
    for h in hashes:
        total = total * _STEP + h
    return mix(total + np.uint64(len(hashes)))[0]


def shingle_sets(w: Words, n: int = 5) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingle hashes: runs of ``n`` words, or with fewer words the whole sequence."""
    hashes, row, _ = grams(w, n)
    at = np.searchsorted(row, np.arange(w.rows + 1), side="left")
    for i in range(w.rows):
        own = hashes[at[i]:at[i + 1]]
        if len(own) == 0 and w.bounds[i + 1] > w.bounds[i]:
            own = np.array([run_hash(w.hash[w.bounds[i]:w.bounds[i + 1]])], np.uint64)
        yield np.unique(own)
