"""Token-id files whose document boundaries are Elias-Fano encoded.

A file holds the ids of consecutive documents as one array and, in place of a
table of 64-bit offsets, the documents' end positions in Elias-Fano form: the
low bits packed, the high bits in unary in a bit vector with a select sample
for every 256th one. Document i ends at ``select(i)``; a boundary costs about
2 + log2(ids / documents) bits.

File layout (little endian):
  ids        n_ids integers of ``width`` bytes
  doc ids    n_docs int64 (rows without a doc_id come first, ``n_null`` of them)
  low        ceil(n_docs * low_bits / 8) bytes
  high       bit vector
  samples    one uint32 for every 256th one bit: its position in the bit vector
  footer     see FOOTER
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MAGIC = b"EFTOKEN1"
FOOTER = struct.Struct("<QQQIIQQQ8s")  # n_ids, n_docs, n_null, width, low_bits, low bytes, high bytes, samples, magic
SAMPLE = 256


@dataclass
class EliasFano:
    """Non-decreasing integers; ``select(i)`` is the i-th, ``all()`` are all of them."""

    n: int
    low_bits: int
    low: np.ndarray      # uint8
    high: np.ndarray     # uint8, bits in little order
    samples: np.ndarray  # uint32

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, int(int(values[-1]) // n).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: int) -> int:
        """The i-th value: the position of the i-th one bit, searched from the nearest sample."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)  # ones before the sample are cleared
        while word.bit_count() <= left:
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return ((one - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        i = np.arange(self.n)
        return ((ones - i) << self.low_bits) | self._low(i)


def write_file(out, blocks, doc_ids: list[int | None], lengths: np.ndarray, width: int) -> int:
    """Write a file from ``blocks`` of id bytes; returns the number of ids."""
    written = 0
    for block in blocks:
        out.write(block)
        written += len(block)
    ends = np.cumsum(np.asarray(lengths, np.int64))
    n_ids = int(ends[-1]) if len(ends) else 0
    if written != n_ids * width:
        raise ValueError(f"{written} bytes of ids for {n_ids} ids")
    ef = EliasFano.encode(ends)
    n_null = sum(x is None for x in doc_ids)
    out.write(np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes())
    for part in (ef.low, ef.high, ef.samples.astype("<u4")):
        out.write(part.tobytes())
    out.write(FOOTER.pack(n_ids, len(doc_ids), n_null, width, ef.low_bits, len(ef.low), len(ef.high), len(ef.samples), MAGIC))
    return n_ids


class TokenFile:
    """Reader over a file's bytes; nothing is copied."""

    def __init__(self, content):
        n_ids, n, n_null, width, low_bits, low, high, samples, magic = FOOTER.unpack_from(content, len(content) - FOOTER.size)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ids = np.frombuffer(content, f"<u{width}", n_ids)
        at = n_ids * width
        raw = np.frombuffer(content, "<i8", n, at)
        self.doc_ids = [None] * n_null + raw[n_null:].tolist()
        at += 8 * n
        parts = []
        for dtype, count in (("u1", low), ("u1", high), ("<u4", samples)):
            parts.append(np.frombuffer(content, dtype, count, at))
            at += count * np.dtype(dtype).itemsize
        self.ends = EliasFano(n, low_bits, *parts)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0:self.ends.select(i)]
