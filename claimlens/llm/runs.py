"""Periodic run detection (13): descending-LCP Kruskal over the words of each document.

The positions whose next 16 words occur again in the document are sorted as
suffixes (prefix doubling over word ranks; no run of 24 words and three periods
can start at any other). Neighbouring suffixes are then united by decreasing
LCP: a class is the ordered set of positions that agree on at least the current
LCP, the smaller set moves into the larger, and a pair of positions that becomes
adjacent by the move at a distance p within the LCP seeds a run of period p. A
pair is adjacent only if no smaller period holds, so p is the smallest one; the
LCP is the pair's own, so the run ends p + LCP words after its first position;
the pair counts where the words before both positions differ, which is the one
left end of a run. Every document is judged alone, by a map stage.

Defined results: null and empty texts have 0 words, no runs and the hash of
nothing; a null doc_id leaves the words as they are; repeated rows are judged
each; whole texts of any length; other columns are not read; an empty table
gives an empty result. Among equally good runs the smallest start, then the
smallest period is reported.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.words import mix

LEAST_WORDS, LEAST_PERIODS = 24, 3
RESULT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")
_STEP = np.uint64(0xD6E8FEB86659FD93)


def planted_period(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the words from ``a`` on are to repeat with period ``p``; None for documents left as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or n == 0:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def repeated_positions(ids: np.ndarray, width: int) -> np.ndarray:
    """Positions whose next ``width`` (a power of two) words may occur again: equal hashes, so none that does is left out."""
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    size = 1
    while size < width:
        h = mix(h[:-size] * _STEP + h[size:])
        size *= 2
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return np.flatnonzero(again)


def sorted_suffixes(ids: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``positions`` in suffix order, and the LCP of each with the next."""
    n = len(ids)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    size = 1
    while size < n and len(np.unique(ranks[-1][positions])) < len(positions):
        rank = ranks[-1]
        key = (rank + 1) * np.int64(n + 1)
        key[:-size] += rank[size:] + 1
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int64))
        size *= 2
    order = positions[np.argsort(ranks[-1][positions])]
    left, right = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(len(left), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (left < n) & (right < n)
        same = inside.copy()
        # ranks of one level agree only if the next 2**k words do, the end of the text being a word of its own
        same[inside] = ranks[k][left[inside]] == ranks[k][right[inside]]
        step = np.where(same, 1 << k, 0)
        lcp += step
        left += step
        right += step
    return order, lcp


def new_neighbours(order: np.ndarray, lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, LCP) of positions that become neighbours in a class as classes unite by decreasing LCP, down to ``least``."""
    parent = list(range(len(order)))
    members: list[list[int] | None] = [[p] for p in order.tolist()]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_lcp = np.argsort(-lcp, kind="stable")
    by_lcp = by_lcp[lcp[by_lcp] >= least]
    for k, level in zip(by_lcp.tolist(), lcp[by_lcp].tolist()):
        a, b = find(k), find(k + 1)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, small = members[a], members[b]
        parent[b], members[b] = a, None
        last = len(small) - 1
        for t, x in enumerate(small):
            at = bisect_left(large, x)
            if at and (t == 0 or small[t - 1] < large[at - 1]):
                yield large[at - 1], x, level
            if at < len(large) and (t == last or small[t + 1] > large[at]):
                yield x, large[at], level
        if last < 8:
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()  # two ascending stretches: merged in one pass


def find_runs(ids: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of ``least_words`` words and ``least_periods`` (two at least) periods, by start, then period."""
    # a run of period q has an LCP of length - q >= max(least_words - q, (least_periods - 1) * q) at its start
    least = -(-least_words * (least_periods - 1) // least_periods)
    n = len(ids)
    if n < least_words:
        return []
    positions = repeated_positions(ids, 1 << (least.bit_length() - 1))
    if len(positions) < 2:
        return []
    order, lcp = sorted_suffixes(ids, positions)
    word = ids.tolist()
    found = {(i, j - i + level, j - i) for i, j, level in new_neighbours(order, lcp, least)
             if level >= (least_periods - 1) * (j - i) and j - i + level >= least_words and (i == 0 or word[i - 1] != word[j - 1])}
    return sorted(found, key=lambda r: (r[0], r[2]))


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties to the smallest start, then period (the order of ``runs``)."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: those of a run after its first period go."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def judged(doc_id: int | None, text: bytes | None) -> tuple:
    words = (text or b"").split()  # bytes.split cuts at 0x20 and 0x09-0x0D only
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    planted = planted_period(doc_id, n)
    if planted:
        a, p = planted
        source = np.arange(n)
        source[a:] = a + (source[a:] - a) % p
        ids = ids[source]
        words = [words[i] for i in source.tolist()]
    runs = find_runs(ids)
    if runs:
        words = [words[i] for i in np.flatnonzero(kept_words(n, runs)).tolist()]
    best = best_run(runs)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row of RESULT per row of ``docs``; a map stage without a shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
                        ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judged(i.as_py(), t.as_buffer().to_pybytes() if t.is_valid else None) for i, t in zip(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)
