"""Ids of whole texts by the tokenizers library, each distinct piece encoded once.

The byte-level pre-tokenizer never joins what stands before a space to the
space and the non-space after it, so a text may be cut in front of every space
that a non-space follows, and the ids of the pieces concatenated are the ids of
the text (special strings hold no space, so none is cut). Where the next byte
may begin white space beyond ASCII the text is not cut, which is always right.

Pieces repeat heavily. A column's pieces are hashed as arrays (64 bits, and the
length and first bytes must agree), the distinct new ones go to the library many in one text, and the ids
of all pieces are gathered from a bounded pool; Python loops over texts only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from claimlens.llm import words as W

CHUNK_BYTES = 1 << 20
POOL_PIECES = 1_000_000
_JOIN = 2000  # new pieces in one text for the library

# Bytes that keep a space from starting a piece: ASCII white space and separators, and first bytes of longer white space.
_NO_CUT = np.zeros(256, bool)
_NO_CUT[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True


@dataclass
class Encoded:
    """Ids of rows ``first`` and following: row i has ``ids[bounds[i]:bounds[i + 1]]``."""

    first: int
    ids: np.ndarray
    bounds: np.ndarray


class PieceEncoder:
    """Texts -> ids of ``dtype`` (uint16 for vocabularies that fit)."""

    def __init__(self, path: str, pool_pieces: int = POOL_PIECES):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.starts = np.zeros(size, bool)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.starts[i] = piece.startswith("Ġ")  # how byte-level vocabularies write a space
        self.pool_pieces = pool_pieces
        self._empty()

    def _empty(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def encode(self, column) -> Iterator[Encoded]:
        """Ids of a text column, some rows at a time; nulls are empty."""
        data, offsets = W.text_buffers(column)
        at, n = 0, len(offsets) - 1
        while at < n:
            upto = min(max(int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1, at + 1), n)
            yield self._rows(data[offsets[at]:offsets[upto]], offsets[at:upto + 1] - offsets[at], at)
            at = upto

    def _rows(self, data: np.ndarray, offsets: np.ndarray, first: int) -> Encoded:
        n = len(data)
        if n == 0:
            return Encoded(first, np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64))
        space = data == 32
        cut = np.zeros(n, bool)
        cut[:-1] = space[:-1] & ~_NO_CUT[data[1:]]
        row_start = offsets[:-1][np.diff(offsets) > 0]
        cut[row_start[row_start > 0] - 1] = False  # a row's last byte
        cut[row_start] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        spaces = np.concatenate([[0], np.cumsum(space)])
        plain = spaces[end] - spaces[start + 1] == 0
        plain[np.searchsorted(start, row_start)] = False

        up, down = W._power_tables(n)
        pieces = np.flatnonzero(plain)
        s, e = start[pieces], end[pieces]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(W._BYTE[data] * up, out=sums[1:])
        hashed = W.mix((sums[e] - sums[s]) * down[s])
        # what else must agree: the length and the first bytes
        check = (e - s).astype(np.uint64)
        for k in range(1, 8):
            check = check << np.uint64(8) ^ data[np.minimum(s + k, e - 1)]
        order = np.argsort(hashed)
        ranked = hashed[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        key, which = ranked[new], order[new]
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        place = self._places(key, check[which], s[which], e[which], data)
        of = place[inverse]
        ok = self.check[of] == check
        alone = np.concatenate([np.flatnonzero(~plain), pieces[~ok]])

        length = np.zeros(len(start), np.int64)
        length[pieces[ok]] = self.size[of[ok]]
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8") for a, b in zip(start[alone].tolist(), end[alone].tolist())]
        own = [np.array(g.ids, self.dtype) for g in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        length[alone] = [len(x) for x in own]
        to = np.concatenate([[0], np.cumsum(length)])
        out = np.empty(to[-1], self.dtype)
        sizes = self.size[of[ok]]
        before = np.cumsum(sizes) - sizes
        step = np.arange(sizes.sum())
        source = np.repeat(self.begin[of[ok]] - before, sizes)
        source += step
        step += np.repeat(to[pieces[ok]] - before, sizes)
        out[step] = self.pool[source]
        for i, ids in zip(to[alone].tolist(), own):
            out[i:i + len(ids)] = ids
        return Encoded(first, out, to[np.searchsorted(start, offsets)])

    def _places(self, key: np.ndarray, check: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Where each piece (sorted by key) stands in the pool's tables; new ones are encoded first."""
        if len(self.key) > self.pool_pieces:
            self._empty()
        at = np.searchsorted(self.key, key)
        known = np.zeros(len(key), bool)
        inside = at < len(self.key)
        known[inside] = self.key[at[inside]] == key[inside]
        new = np.flatnonzero(~known)
        if len(new):
            sizes = []
            for part in (new[i:i + _JOIN] for i in range(0, len(new), _JOIN)):
                sizes.append(self._learn(start[part], end[part], data))
            size = np.concatenate(sizes)
            begin = self.used - int(size.sum()) + np.cumsum(size) - size
            for name, values in (("check", check[new]), ("begin", begin), ("size", size), ("key", key[new])):
                setattr(self, name, np.insert(getattr(self, name), at[new], values))
            at = np.searchsorted(self.key, key)
        return at

    def _learn(self, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Append the ids of pieces to the pool; their lengths. A token that starts with the space mark starts a piece."""
        long = end - start
        begin = np.cumsum(long) - long
        text = data[np.repeat(start - begin, long) + np.arange(long.sum())].tobytes()
        ids = np.array(self.tokenizer.encode_batch_fast([text.decode("utf-8")], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(self.starts[ids])
        if len(cuts) == len(start):
            size = np.diff(np.append(cuts, len(ids)))
        else:
            texts = [text[a:a + n].decode("utf-8") for a, n in zip(begin.tolist(), long.tolist())]
            got = [np.array(g.ids, self.dtype) for g in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids, size = np.concatenate(got), np.array([len(x) for x in got])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        return size


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of a vocabulary file, once in each Python worker; Spark runs one task per core, so the library gets one thread."""
    if path not in _encoders:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
