"""Benchmark decontamination (7): rare n-gram seeds, then Smith-Waterman alignment of the passages they point at.

Every run of four words of a test item is a seed (an item with fewer words is
one seed). A first pass over all texts counts in how many documents each seed
occurs. A seed is rare when that is at most ``rare_share`` of all documents, or
at most twice the median over its item's occurring seeds, or if it is one of the
``FEW`` rarest occurring seeds of a stretch of ``STRETCH`` words of its item: an
item that leaked into thousands of documents keeps its seeds, edited or not. With
``rare_share=1`` every seed counts as rare and joins by itself. In a
second pass seeds join passages to items: a rare one by itself, other ones (common
word runs) where two or more of an item are near each other. Around each group of hits the item is
aligned with the passage's words (match 2, mismatch -1, gap -1), and the best
local alignment, divided by that of the item with itself, is the score: 1 for an
exact copy, less for paraphrased or edited ones.

Items are taken in blocks of at most ``block_words`` words, which bounds what a
task holds; each block is the two passes. Only per-seed counts are shuffled.

Defined results: null, empty and wordless texts and items match nothing;
repeated rows and items are reported each; documents without an id are reported
with a null id; an empty table of documents or items gives no rows; extra
columns are not read, and pass through ``kept_rows`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm import words as W
from claimlens.llm.stage import staged

SEED = 4
LEAST_SCORE = 0.5
RARE_SHARE = 0.001
FEW = 4            # occurring seeds of a stretch that are used however frequent they are
STRETCH = 16
BLOCK_WORDS = 2_000_000
RESULT = "doc_id long, item_id long, score double, start_word long, end_word long, n_seeds long"


@dataclass(frozen=True)
class Block:
    """Some test items: ids, word hashes, and their seeds sorted by hash."""

    ids: list[int | None]
    words: list[np.ndarray]
    seed: np.ndarray   # sorted distinct seed hashes
    entry: np.ndarray  # hits of seed i: entries entry[i] .. entry[i + 1]
    item: np.ndarray   # of each entry
    at: np.ndarray     # word position in the item
    size: np.ndarray   # words of each distinct seed


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """Items block by block, each of at most ``block_words`` words (or of one item)."""
    ids, hashes, held = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        own = next(W.word_chunks(pa.array([r["text"]], pa.string()))).hash
        if not len(own):
            continue
        if ids and held + len(own) > block_words:
            yield _block(ids, hashes)
            ids, hashes, held = [], [], 0
        ids.append(r["item_id"])
        hashes.append(own)
        held += len(own)
    if ids:
        yield _block(ids, hashes)


def _block(ids: list, hashes: list[np.ndarray]) -> Block:
    seeds, items, at, size = [], [], [], []
    for i, h in enumerate(hashes):
        n = min(SEED, len(h))
        for k in range(len(h) - n + 1):
            seeds.append(W.run_hash(h[k:k + n]))
            items.append(i)
            at.append(k)
            size.append(n)
    seeds = np.array(seeds, np.uint64)
    order = np.argsort(seeds, kind="stable")
    distinct, first = np.unique(seeds[order], return_index=True)
    return Block(ids, hashes, distinct, np.append(first, len(seeds)), np.array(items)[order], np.array(at)[order], np.array(size)[order][first])


def _hits(w: W.Words, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(word index, seed index) of every seed occurrence in a chunk."""
    at, seed = [], []
    for n in np.unique(block.size):
        hashes, _, index = W.grams(w, int(n))
        where = np.minimum(np.searchsorted(block.seed, hashes), len(block.seed) - 1)
        found = block.seed[where] == hashes
        at.append(index[found])
        seed.append(where[found])
    return np.concatenate(at), np.concatenate(seed)


def rare_seeds(docs: DataFrame, block: Block, rare_share: float = RARE_SHARE) -> np.ndarray:
    """Which seeds of a block are rare, from their document frequencies over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(len(block.seed), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for w in W.word_chunks(batch.column(0)):
                at, seed = _hits(w, block)
                df += np.bincount(np.unique(w.row[at] * len(df) + seed) % len(df), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], rows))], ["seed", "n"])

    df, rows = np.zeros(len(block.seed), np.int64), 0
    # one row for each seed of the block at most, and the number of documents
    for r in docs.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect():
        if r["seed"] < 0:
            rows = r["n"]
        else:
            df[r["seed"]] = r["n"]
    of_entry = np.repeat(np.arange(len(block.seed)), np.diff(block.entry))
    occurs = df[of_entry] > 0
    item, at, seed = block.item[occurs], block.at[occurs], of_entry[occurs]
    rare = df <= rare_share * rows
    order = np.lexsort((df[seed], item))
    edge = np.flatnonzero(np.diff(item[order], prepend=-1, append=-1))  # first of each item, and the end
    for a, b in zip(edge[:-1], edge[1:]):
        own = seed[order[a:b]]
        rare[own[df[own] <= 2 * np.median(df[own])]] = True
    part = at // STRETCH
    order = np.lexsort((at, df[seed], part, item))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(item[order]) != 0) | (np.diff(part[order]) != 0)
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    rare[seed[order[np.arange(len(order)) - first < FEW]]] = True
    return rare


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: (score, first, end) with the span in the passage."""
    score, end_item, end = _best(item, passage)
    if score <= 0:
        return 0, 0, 0
    _, _, back = _best(item[:end_item][::-1], passage[:end][::-1])
    return score, end - back, end


def _best(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Score and ends of the best local alignment; one vectorised step for each item word."""
    n = len(passage)
    ramp = np.arange(n + 1)
    row, best = np.zeros(n + 1, np.int64), (0, 0, 0)
    for i, word in enumerate(item):
        fresh = np.zeros(n + 1, np.int64)
        fresh[1:] = np.maximum(row[:-1] + np.where(passage == word, 2, -1), row[1:] - 1)
        np.maximum(fresh, 0, out=fresh)
        row = np.maximum.accumulate(fresh + ramp) - ramp  # gaps in the item
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), i + 1, top)
    return best


def _matches(w: W.Words, block: Block, usable: np.ndarray, least: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(row, item, score, first word, end word, seeds) of every row and item that align well enough."""
    at, seed = _hits(w, block)
    n = np.diff(block.entry)[seed]
    hit = np.repeat(np.arange(len(seed)), n)
    entry = np.repeat(block.entry[seed], n) + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
    row, item = w.row[at[hit]], block.item[entry]
    begin = at[hit] - block.at[entry]  # where the item's first word would be
    order = np.lexsort((begin, item, row))
    row, item, begin, seed = row[order], item[order], begin[order], seed[hit][order]
    edges = np.flatnonzero((np.diff(row) != 0) | (np.diff(item) != 0)) + 1
    for a, b in zip([0, *edges], [*edges, len(row)]):
        if a == b:
            continue
        own, i, lo, hi = block.words[item[a]], int(row[a]), w.bounds[row[a]], w.bounds[row[a] + 1]
        slack = max(8, len(own) // 2)
        best = (0, 0, 0)
        cuts = np.flatnonzero(np.diff(begin[a:b]) > len(own) + slack) + 1
        for group, of in zip(np.split(begin[a:b], cuts), np.split(seed[a:b], cuts)):
            if not usable[of].any() and (of == of[0]).all():
                continue
            left = max(lo, group[0] - slack)
            right = min(hi, group[-1] + len(own) + slack)
            score, first, end = align(own, w.hash[left:right])
            if score > best[0]:
                best = (score, left + first - lo, left + end - lo)
        share = best[0] / (2 * len(own))
        if share >= least:
            yield i, int(item[a]), share, int(best[1]), int(best[2]), b - a


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, rare_share: float = RARE_SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and test item whose alignment score reaches ``least``."""
    out = docs.sparkSession.createDataFrame([], RESULT)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in blocks(benchmark, block_words):
        usable = rare_seeds(source, block, rare_share)

        def run(batches: Iterator[pa.RecordBatch], block=block, usable=usable) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for w in W.word_chunks(batch.column(1)):
                    found = [(batch.column(0)[w.first + i].as_py(), block.ids[k], *rest) for i, k, *rest in _matches(w, block, usable, least)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _TYPES)], _NAMES)

        out = out.unionByName(staged(source.mapInArrow(run, RESULT), "leaks"))
    return out


_NAMES = [c.split()[0] for c in RESULT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]


def kept_rows(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, rare_share: float = RARE_SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows that hold no passage of any test item, with all their columns; a map stage for each block."""
    position = docs.columns.index("text")
    out = docs
    for block in blocks(benchmark, block_words):
        usable = rare_seeds(docs, block, rare_share)

        def run(batches: Iterator[pa.RecordBatch], block=block, usable=usable) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for w in W.word_chunks(batch.column(position)):
                    for i, *_ in _matches(w, block, usable, least):
                        clean[w.first + i] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
