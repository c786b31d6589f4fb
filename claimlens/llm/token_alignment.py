"""Cross-tokenizer alignment (11): the tokens of two tokenizers linked by their bytes.

Both id lists of a text give a dictionary from cumulative byte end to token
index; the intersection of their keys, sorted, slices both lists into groups,
and inside a group tokens are linked where their byte ranges overlap.

A text is space + text for both tokenizers, and is cut into pieces before each
space that follows no white space. There both end a token (the byte-level
pre-tokenizer joins no other character to a following space, and no piece of the
other vocabulary holds a space after anything else, which ``PairAligner``
verifies), so the groups of a text are those of its pieces, and each distinct
piece is encoded and aligned once per worker and block.

Corpus-wide counts need every text, so there are two passes. The first writes
one row per block of texts: what is known of each text, how often it holds each
distinct piece, and the distinct id pairs with their links. Pair counts are
summed over blocks and ranked within each B id; every block gets the figures of
its own pairs back, and the second pass sums them per text. A pair, however
frequent, is one row per block.

Defined results: texts null, empty, or whose A or B bytes differ from space +
text (such as those that hold U+2581) have zeros and ''; special strings in texts are plain text; repeated rows and
rows that share a doc_id are aligned and counted each; whole texts of any length
(a text is never split over blocks); ties for a B id's highest count all count
as highest; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.stage import staged

BLOCK_CHARS = 4 << 20
POOL_CHARS = 3 << 20
PART_CHARS = 1 << 18  # of a block, whose pieces are looked up at a time
FILE_BLOCKS = 4  # written to a file: Spark reads thousands of rows of a file at once
_JOIN = 2000  # new pieces in one text for the libraries
_CUT = re.compile(r"(?<=\S)(?= )")
_JOINED = re.compile(r"\s |^ ")  # a space that starts no piece
BLOCK = ("block string, n_docs long, doc_ids binary, stats binary, hashes binary, doc_start binary, doc_piece binary, doc_times binary, "
         "piece_start binary, piece_pair binary, pairs array<long>, links array<long>")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_table() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte, to that byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def aligned(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the groups in the A tokens and in the B tokens (beyond the last), and the linked tokens (A, B), for two arrays of cumulative byte ends."""
    index_a, index_b = dict(zip(ends_a.tolist(), range(len(ends_a)))), dict(zip(ends_b.tolist(), range(len(ends_b))))
    common = sorted(index_a.keys() & index_b.keys())
    a_to = np.fromiter(map(index_a.__getitem__, common), np.int64, len(common)) + 1
    b_to = np.fromiter(map(index_b.__getitem__, common), np.int64, len(common)) + 1
    # Inside a slice two tokens overlap in one stretch between neighbouring ends; a slice of i and j tokens has i + j - 1 of them.
    stretch = np.union1d(ends_a, ends_b)
    return a_to, b_to, np.searchsorted(ends_a, stretch), np.searchsorted(ends_b, stretch)


class PairAligner:
    """Aligns distinct pieces, many at a time, and keeps what it knows of them between blocks.

    A piece is kept without its leading space. Beyond ``pool_chars`` characters those stay that were used again since the last
    time (none, if they alone would fill half of the pool): what goes is encoded anew when it comes again.
    """

    def __init__(self, path_a: str, path_b: str, pool_chars: int = POOL_CHARS):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        to_byte = byte_table()
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            self.bytes_a[i] = bytes(to_byte[c] for c in name) if all(c in to_byte for c in name) else name.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
        if any("▁" in t.lstrip("▁") for t in names):
            raise ValueError("the second vocabulary has pieces across word starts: texts cannot be cut into pieces")
        self.size_a, self.size_b = np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])
        n, m = len(names), len(self.bytes_a)
        # every id with what follows it: a further A id of its group, the first B id; a further B id, the next group, the next piece
        self.told = [f"{i}{mark}" for mark, count in ((",", m), ("|", m), (",", n), (";", n), ("\n", n)) for i in range(count)]
        self.pool_chars = pool_chars
        self.known: dict[str, int] = {}
        self._keep(np.zeros(0, np.int64))

    def _keep(self, kept: np.ndarray) -> None:
        """Forget all pieces but those of these numbers."""
        names = list(self.known)
        texts = self.text if names else []
        self.known = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.chars = sum(map(len, self.known))
        self.text = [texts[k] for k in kept.tolist()]  # groups as text; None where the bytes differ
        stats, begin, pair = (self.stats, self.begin, self.pair) if names else (np.zeros((0, 4), np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64))
        self.stats, (self.begin, self.pair) = stats[kept], _gathered(begin, pair, kept)  # A tokens, B tokens, groups, links; an A and a B id in one number for each link
        self.uses = np.zeros(len(kept), np.int64)

    def trim(self) -> None:
        if self.chars > self.pool_chars:
            self._keep(np.flatnonzero(self.uses > 1))
            if self.chars > self.pool_chars // 2:
                self._keep(np.zeros(0, np.int64))

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of pieces; new ones are encoded and aligned, many in one text where they may stand side by side."""
        found = list(map(self.known.get, pieces))
        at = [i for i, k in enumerate(found) if k is None]
        if at:
            missing = dict.fromkeys(pieces[i] for i in at)
            solid = [p for p in missing if p and not p[-1].isspace()]
            parts = [solid[i:i + _JOIN] for i in range(0, len(solid), _JOIN)] + [[p] for p in missing if not p or p[-1].isspace()]
            stats, pairs = zip(*(x for part in parts for x in self._learn(part)))
            self.stats = np.concatenate([self.stats, *stats]).astype(np.int32)
            self.begin = np.concatenate([[0], np.cumsum(self.stats[:, 3])])
            self.pair = np.concatenate([self.pair, *pairs])
            self.uses = np.concatenate([self.uses, np.zeros(len(missing), np.int64)])
            for i in at:
                found[i] = self.known[pieces[i]]
        return np.array(found, np.int64)

    def _learn(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Figures and id pairs of new pieces, encoded and aligned as the one text that they make up."""
        text = " " + " ".join(pieces)
        ids_a, ids_b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        raw = text.encode()
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != raw or b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw:
            if len(pieces) > 1:
                half = len(pieces) // 2
                return self._learn(pieces[:half]) + self._learn(pieces[half:])
            self._add(pieces, [None])
            return [(np.zeros((1, 4), np.int64), np.zeros(0, np.int64))]
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        a_to, b_to, link_a, link_b = aligned(ends_a, ends_b)
        end = np.cumsum([1 + len(p.encode()) for p in pieces])
        of_a, of_b = np.searchsorted(ends_a, end) + 1, np.searchsorted(ends_b, end) + 1
        groups = np.searchsorted(a_to, of_a) + 1
        stats = np.diff(np.column_stack([of_a, of_b, groups, of_a + of_b - groups]), axis=0, prepend=0)

        # the ids in the order of the groups' text, each with its mark
        m, n = len(self.bytes_a), len(self.bytes_b)
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[a_to - 1] = 1
        last_b[b_to - 1] = 1
        last_b[of_b - 1] = 2
        group_a, group_b = np.searchsorted(a_to, np.arange(len(ids_a)), side="right"), np.searchsorted(b_to, np.arange(len(ids_b)), side="right")
        told = np.empty(len(ids_a) + len(ids_b), np.int64)
        told[np.arange(len(ids_a)) + np.concatenate([[0], b_to])[group_a]] = ids_a + m * last_a
        told[np.arange(len(ids_b)) + a_to[group_b]] = 2 * m + ids_b + n * last_b
        self._add(pieces, "".join(map(self.told.__getitem__, told.tolist()))[:-1].split("\n"))
        return [(stats, ids_a[link_a] << 32 | ids_b[link_b])]

    def _add(self, pieces: list[str], groups: list[str | None]) -> None:
        self.known.update(zip(pieces, range(len(self.text), len(self.text) + len(pieces))))
        self.text += groups
        self.chars += sum(map(len, pieces))


def _gathered(begin: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, values) of the stretches ``which`` of ``values``."""
    size = begin[which + 1] - begin[which]
    to = np.concatenate([[0], np.cumsum(size)])
    return to, values[np.repeat(begin[which] - to[:-1], size) + np.arange(to[-1])]


def _pieces(text: str | None) -> list[str]:
    """The pieces of a text, without their leading spaces."""
    if not text:
        return []
    if _JOINED.search(text):
        return [p[1:] for p in _CUT.split(" " + text)]
    return text.split(" ")


_aligners: dict[tuple[str, str], PairAligner] = {}


def aligner(path_a: str, path_b: str) -> PairAligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = PairAligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _numbered(known: PairAligner, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the texts' pieces, one text after the other, and how many each has."""
    cut = [_pieces(t) for t in texts]
    flat = known.numbers([p for own in cut for p in own])
    each = np.array([len(own) for own in cut], np.int64)
    differs = known.stats[flat, 0] == 0
    odd = set(np.repeat(np.arange(len(each)), each)[differs].tolist())
    if odd:  # differences of two pieces might make up for each other: such a text is one piece
        for i in odd:
            cut[i] = [texts[i]]
        whole = known.numbers([texts[i] for i in odd])
        for i, k in zip(odd, whole.tolist()):
            if known.text[k] is None:
                cut[i] = []
        flat = known.numbers([p for own in cut for p in own])
        each = np.array([len(own) for own in cut], np.int64)
    return flat, each


def _stretches(texts: list[str | None], chars: int = PART_CHARS) -> Iterator[list[str | None]]:
    """The texts in order, about ``chars`` characters at a time (one text at least)."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def _block(known: PairAligner, ids: list[int | None], texts: list[str | None]) -> tuple:
    """The row of a block."""
    known.trim()
    # Pieces as strings take some ten times their characters: only those of a stretch are held at once, of the block their numbers.
    flat, each = (np.concatenate(x) for x in zip(*(_numbered(known, part) for part in _stretches(texts))))
    to = np.concatenate([[0], np.cumsum(each)])
    hashes = b"".join(hashlib.sha256(";".join(map(known.text.__getitem__, flat[a:b].tolist())).encode()).digest() if b > a else bytes(32)
                      for a, b in zip(to[:-1].tolist(), to[1:].tolist()))
    seen = np.zeros(len(known.text), bool)
    seen[flat] = True
    pieces = np.flatnonzero(seen)
    total = np.bincount(flat, minlength=len(seen))[pieces]
    known.uses[pieces] += total
    width = max(len(pieces), 1)
    key, times = np.unique(np.repeat(np.arange(len(each)), each) * width + (np.cumsum(seen) - 1)[flat], return_counts=True)  # a piece once per text, with its times
    doc, piece = key // width, key % width
    begin = np.searchsorted(doc, np.arange(len(each) + 1))
    del flat, key
    stats = np.empty((len(each), 4), np.int64)
    for k in range(4):  # one figure at a time: an array of all four takes sixteen megabytes and more
        upto = np.concatenate([[0], np.cumsum(known.stats[pieces, k][piece] * times)])
        stats[:, k] = upto[begin[1:]] - upto[begin[:-1]]
    # Narrow arrays from here on: those of the pairs come beside them.
    begin, piece, times = begin.astype(np.int64).tobytes(), piece.astype(np.uint32).tobytes(), times.astype(np.uint32).tobytes()
    del doc, upto
    bounds, every = _gathered(known.begin, known.pair, pieces)
    pairs, pair = np.unique(every, return_inverse=True)
    links = np.bincount(pair, weights=np.repeat(total, np.diff(bounds)), minlength=len(pairs)).astype(np.int64)
    valid = np.array([i is not None for i in ids], bool)
    return (uuid.uuid4().hex, len(each), np.array([i or 0 for i in ids], np.int64).tobytes() + valid.tobytes(),
            stats.tobytes(), hashes, begin, piece, times, bounds.astype(np.int64).tobytes(), pair.astype(np.uint32).tobytes(), pairs, links)


def blocks(docs: DataFrame, path_a: str, path_b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """First pass: a row per block of about ``block_chars`` characters (one text at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(path_a, path_b)
        names = [f.split(" ")[0] for f in BLOCK.split(", ")]

        def emit():
            row = _block(known, ids, texts)
            return pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[2:10]),
                                               *(pa.array([x], pa.list_(pa.int64())) for x in row[10:])], names)

        ids, texts, chars = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                ids.append(i.as_py())
                texts.append(t.as_py())
                chars += len(texts[-1] or "")
                if chars >= block_chars:
                    yield emit()
                    ids, texts, chars = [], [], 0
        if ids:
            yield emit()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, total (links over all texts), best (the highest of its B id, ties included); ``found``: rows of ``blocks``."""
    each = found.select(F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("x.pairs", "x.links")
    total = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("links").alias("total"))
    # At most one row per id of the first vocabulary in a group.
    top = F.max("total").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    return total.select("pair", "total", (F.col("total") == top).alias("best"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second pass: the rows of each block's texts."""
    _aligners.clear()  # what this worker keeps of the first pass
    for batch in batches:
        for at in range(batch.num_rows):  # a block's arrays take megabytes: one row at a time leaves Arrow
            row = batch.slice(at, 1).to_pylist()[0]
            n = row["n_docs"]
            total, best = np.array(row["total"] or [], np.int64), np.array(row["best"] or [], bool)
            start, pair = np.frombuffer(row["piece_start"], np.int64), np.frombuffer(row["piece_pair"], np.uint32)
            doc_start, piece = np.frombuffer(row["doc_start"], np.int64), np.frombuffer(row["doc_piece"], np.uint32)
            times = np.frombuffer(row["doc_times"], np.uint32).astype(np.int64)

            def per_doc(of_pair: np.ndarray) -> np.ndarray:
                upto = np.concatenate([[0], np.cumsum(of_pair[pair])])
                of_piece = upto[start[1:]] - upto[start[:-1]]
                upto = np.concatenate([[0], np.cumsum(of_piece[piece] * times)])
                return upto[doc_start[1:]] - upto[doc_start[:-1]]

            stats = np.frombuffer(row["stats"], np.int64).reshape(n, 4)
            ids, valid = np.frombuffer(row["doc_ids"][:8 * n], np.int64), np.frombuffer(row["doc_ids"][8 * n:], bool)
            hashes = [row["hashes"][32 * i:32 * i + 32].hex() if stats[i, 0] else "" for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=~valid), *(pa.array(stats[:, k]) for k in range(4)), pa.array(per_doc(best.astype(np.int64))),
                 pa.array(per_doc(total)), pa.array(hashes, pa.string())], [f.split(" ")[0] for f in RESULT.split(", ")])


def align_texts(docs: DataFrame, path_a: str, path_b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row of RESULT per row of ``docs``; A: a byte-level tokenizers file, B: a sentencepiece model."""
    found = staged(blocks(docs, path_a, path_b, block_chars), "aligned-blocks", FILE_BLOCKS)
    # A block's arrays take megabytes, and all rows of a task may go into one Arrow batch: as many parts as blocks, and they stay apart.
    parts = max(found.count(), 1)
    asked = found.select("block", F.posexplode("pairs").alias("at", "pair"))
    # A group holds the distinct pairs of one block, which its texts bound.
    answers = (asked.join(pair_counts(found), "pair").repartition(parts, "block").groupBy("block")
               .agg(F.sort_array(F.collect_list(F.struct("at", "total", "best"))).alias("x"))
               .select("block", F.col("x.total").alias("total"), F.col("x.best").alias("best")))
    return found.drop("pairs", "links").repartition(parts, "block").join(answers, "block", "left").mapInArrow(_summed, RESULT)
