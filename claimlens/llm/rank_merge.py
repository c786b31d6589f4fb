"""Token counts (9): byte-pair merges applied to all distinct pre-tokens of a batch at once.

Pre-tokens are ragged arrays: one flat array of symbol ids and, for each
symbol, the pre-token it belongs to. In each round every pre-token finds the
lowest merge rank among its adjacent pairs, all occurrences of that pair merge
(left to right without overlap), and pre-tokens without a mergeable pair leave
the batch. The symbols that survive are the tokens. No tokenizer is trained and
the library's own encoder is not called: only its normaliser, its pre-token
pattern and its merge table are used.

Defined results: null and empty texts have 0 bytes and 0 tokens; whole texts of
any length count; repeated rows are counted each; extra columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FAR = np.int64(1) << np.int64(60)
_WHITE = re.compile(r"[ \t\n\r\x0b\x0c]+")
CACHE_PIECES = 1_000_000


def _pieces(text: str) -> list[str]:
    """Runs between white space; str.split also cuts at four control characters that are not white space to the library."""
    return _WHITE.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


class MergeCounter:
    """Counts the tokens of texts for a word-end BPE vocabulary file."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        tokenizer = Tokenizer.from_file(path)
        self.normalise, self.pre_tokenise = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.vocab, self.size = vocab, max(vocab.values()) + 1
        keys, out = [], []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(vocab[a] * self.size + vocab[b])
            out.append(vocab[a + b])
        keys = np.array(keys, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.out = keys[order], order.astype(np.int64), np.array(out, np.int64)
        self.cache: dict[str, int] = {}
        self.cache_pieces = cache_pieces

    def _symbols(self, pre_token: str) -> list[int]:
        """Ids of a pre-token's characters, the last with the word-end mark; characters outside the vocabulary give no token."""
        chars = [*pre_token[:-1], pre_token[-1] + self.suffix]
        return [self.vocab[c] for c in chars if c in self.vocab]

    def merged_counts(self, pre_tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        lists = [self._symbols(p) for p in pre_tokens]
        lengths = np.array([len(x) for x in lists], np.int64)
        counts = lengths.copy()
        sym = np.fromiter((s for x in lists for s in x), np.int64, int(lengths.sum()))
        seq = np.repeat(np.arange(len(lists)), lengths)
        while len(sym) > 1:
            together = seq[1:] == seq[:-1]
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(together & (self.keys[at] == key), self.rank[at], _FAR)
            # lowest rank of each sequence
            first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            low = np.minimum.reduceat(np.concatenate([rank, [_FAR]]), first)
            which = np.cumsum(np.concatenate([[0], seq[1:] != seq[:-1]]))
            hit = (rank == low[which[:-1]]) & (rank < _FAR)
            # a pair of equal symbols may overlap itself: take every other one of such a run
            where = np.flatnonzero(hit)
            if len(where):
                run_start = np.concatenate([[True], np.diff(where) != 1])
                step = np.arange(len(where)) - np.maximum.accumulate(np.where(run_start, np.arange(len(where)), 0))
                where = where[step % 2 == 0]
            sym[where] = self.out[rank[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            np.subtract.at(counts, seq[where], 1)
            alive = (low < _FAR)[which] & keep
            sym, seq = sym[alive], seq[alive]
        return counts

    def _learn(self, pieces: list[str]) -> None:
        """Fill the cache for pieces without white space."""
        pre, owner = [], []
        counts = np.zeros(len(pieces), np.int64)
        for i, piece in enumerate(pieces):
            parts = [piece]
            if self.special_at is not None and self.special_at.search(piece):
                counts[i] += len(self.special_at.findall(piece))
                parts = self.special_at.split(piece)
            for part in parts:
                if part:
                    got = [p for p, _ in self.pre_tokenise(self.normalise(part))]
                    pre += got
                    owner += [i] * len(got)
        if pre:
            distinct = {p: k for k, p in enumerate(dict.fromkeys(pre))}
            own = self.merged_counts(list(distinct))
            np.add.at(counts, np.array(owner), own[[distinct[p] for p in pre]])
        self.cache.update(zip(pieces, counts.tolist()))

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text. No pre-token holds white space, so pieces between white space count on their own."""
        pieces = [_pieces(t) if t else [] for t in texts]
        if len(self.cache) > self.cache_pieces:
            self.cache.clear()
        missing = list(set().union(*pieces) - self.cache.keys()) if pieces else []
        for at in range(0, len(missing), 20_000):
            self._learn(missing[at:at + 20_000])
        get = self.cache.__getitem__
        return [sum(map(get, p)) for p in pieces]


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; a map stage without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path).count
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = count(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
