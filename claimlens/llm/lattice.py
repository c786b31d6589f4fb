"""LM scoring (1): marginal probability of a text over all segmentations of its words.

The vocabulary of subword pieces exists already; the lattice of a word has an
edge for every piece that matches at a position, plus an edge for every single
character (so every word has a path). The lattice probability of a word is the
sum over all paths, computed by a forward recursion in log space:

    alpha[0] = 0,  alpha[j] = logsumexp over edges (i, j) of alpha[i] + log p(edge)

The piece weights start from the vocabulary's own scores (its merge ranks, read
as a Zipf law since ranks are no probabilities) and are re-estimated on the
training words by expectation maximisation over the same lattices. Words of the
training texts have one more edge, over the whole word, with the word's
discounted frequency; the mass that the discount frees goes to the piece paths:

    p(word) = max(c - D, 0) / N + D * V / N * lattice(word)

Texts of a corpus come from several languages, so a text's probability is
marginal over these too: for each value k of ``component`` (the ``lang`` of the
training texts; the commonest few, the others together) the same formula with
the counts of k backs off to p, and with one end token

    p(text) = sum over k of share(k) * product over words of p_k(word)

A text's own ``lang`` is never looked at when it is scored. Words do not
overlap, so the lattice of a text is the chain of its words' lattices and each
distinct word is computed once for the whole corpus.

Word counts, the total and the vocabulary come from all training texts. The
``head`` most frequent words (a fixed number) are known to every task; the rest
are joined by a shuffle, where no word is frequent. Nothing else is broadcast.

Defined results: a null text is empty, so its only token is the end; rows
without a doc_id are training rows; repeated rows count each; an empty table
gives no rows; without any training text no word is known and the lattice alone
scores; a missing or null component is one of its own; extra columns are not
read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm import words as W
from claimlens.llm.stage import id_remainder, staged

HEAD = 1 << 18
DISCOUNT = 0.75
EM_ROUNDS = 3
COMPONENTS = 6
FLUSH = 400_000
WORDS_AT_ONCE = 60_000  # whose lattices are computed together: words of one length share each step
END = b""  # the end token's key; no word is empty
MARK = "\u2581"
_CHARACTERS = 1_114_112  # code points; characters outside the vocabulary share one weight evenly
_BASE = 0x9E3779B97F4A7C15
_PLAIN = 650.0  # -log of the least probability that is summed without logarithms; a double holds 708
_BINS = 64  # of word counts, per doubling


def _text_key(text: str) -> int:
    h = 0
    for c in text:
        h = (h * _BASE + ord(c) + 1) % (1 << 64)
    return int(W.mix(np.array([h], np.uint64) + np.uint64(len(text)))[0])


class Pieces:
    """An existing subword vocabulary: pieces with log probabilities, looked up by hash."""

    def __init__(self, pieces: list[str], weights: np.ndarray):
        self.pieces, self.longest = pieces, max(map(len, pieces))
        prefixes = {p[:k] for p in pieces for k in range(1, len(p))}
        at = {p: i for i, p in enumerate(pieces)}
        entries = sorted({*at, *prefixes})
        # An open-addressing table of pieces and of their beginnings, at most an eighth full.
        size = 1 << (8 * len(entries)).bit_length()
        self.mask = np.uint64(size - 1)
        self.slot_key, self.slot_piece, self.slot_more = np.zeros(size, np.uint64), np.full(size, -1, np.int32), np.zeros(size, bool)
        for text in entries:
            key = _text_key(text)
            slot = key & (size - 1)
            while self.slot_key[slot]:
                slot = (slot + 1) & (size - 1)
            self.slot_key[slot], self.slot_piece[slot], self.slot_more[slot] = key, at.get(text, -1), text in prefixes
        self.set_weights(np.append(weights, 1e-9 * np.sum(weights)))

    @classmethod
    def from_file(cls, path: str) -> Pieces:
        """Pieces of a sentencepiece model that can stand inside a word; control and byte pieces are left out."""
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, weights = [], []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) or MARK in piece[1:]):
                pieces.append(piece)
                weights.append(1.0 / (10.0 - min(0.0, model.get_score(i))))
        return cls(pieces, np.array(weights))

    def set_weights(self, weights: np.ndarray) -> None:
        """Weights of the pieces and, last, of all characters outside the vocabulary together."""
        self.logp = np.log(weights / weights.sum())
        self.logp[-1] -= math.log(_CHARACTERS)

    def _slots(self, key: np.ndarray) -> np.ndarray:
        """Where each key stands in the table, -1 if it is not there."""
        slot = (key & self.mask).astype(np.int64)
        held = self.slot_key[slot]
        same = held == key
        out = np.where(same, slot, -1)
        open_ = np.flatnonzero(~same & (held != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            held = self.slot_key[slot[open_]]
            out[open_[held == key[open_]]] = slot[open_[held == key[open_]]]
            open_ = open_[(held != key[open_]) & (held != 0)]
        return out

    def edges(self, codes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Lattice edges of words of one length, given as code points [words, length]: (from, to, words, pieces), by from."""
        n, length = codes.shape
        base, hashes = np.uint64(_BASE), np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            hashes[j + 1] = hashes[j] * base + codes[:, j].astype(np.uint64) + np.uint64(1)
        powers = [pow(_BASE, k, 1 << 64) for k in range(self.longest + 1)]
        out = []
        for i in range(length):
            live = np.arange(n)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                key = W.mix(hashes[j, live] - hashes[i, live] * np.uint64(powers[j - i]) + np.uint64(j - i))
                slot = self._slots(key)
                hit = np.flatnonzero(slot >= 0)
                at = slot[hit]
                piece = self.slot_piece[at]
                known = piece >= 0
                if j == i + 1:
                    every = np.full(len(live), len(self.pieces), piece.dtype)
                    every[hit[known]] = piece[known]
                    out.append((i, j, live, every))
                elif known.any():
                    out.append((i, j, live[hit[known]], piece[known]))
                live = live[hit[self.slot_more[at]]]
                if not len(live):
                    break
        return out

    def marginals(self, words: list[bytes], expected: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each word's marginal probability; adds expected piece counts to ``expected`` if given."""
        texts = [MARK + w.decode("utf-8") for w in words]
        lengths = np.array([len(t) for t in texts], np.int64)
        out = np.zeros(len(texts))
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            for part in np.array_split(own, -(-len(own) * int(length) // 200_000) or 1):
                codes = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le"), "<u4").reshape(len(part), length)
                out[part] = self._forward(codes, expected)
        return out

    def _forward(self, codes: np.ndarray, expected: np.ndarray | None) -> np.ndarray:
        n, length = codes.shape
        edges = self.edges(codes)
        if length * -self.logp.min() < _PLAIN:
            return self._plain_forward(n, length, edges, expected)
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0
        for i, j, rows, piece in edges:
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.logp[piece])
        if expected is not None:
            beta = np.full((length + 1, n), -np.inf)
            beta[length] = 0
            for i, j, rows, piece in reversed(edges):
                onward = self.logp[piece] + beta[j, rows]
                beta[i, rows] = np.logaddexp(beta[i, rows], onward)
                expected += np.bincount(piece, np.exp(alpha[i, rows] + onward - alpha[length, rows]), len(expected))
        return alpha[length]

    def _plain_forward(self, n: int, length: int, edges: list, expected: np.ndarray | None) -> np.ndarray:
        """The same on the probabilities themselves, where no path of so many characters can be too unlikely for a double."""
        p = np.exp(self.logp)
        alpha = np.zeros((length + 1, n))
        alpha[0] = 1
        weights = [p[piece] for _, _, _, piece in edges]
        for (i, j, rows, _), weight in zip(edges, weights):
            alpha[j, rows] += alpha[i, rows] * weight
        if expected is not None:
            beta = np.zeros((length + 1, n))
            beta[length] = 1 / alpha[length]
            for (i, j, rows, piece), weight in zip(reversed(edges), reversed(weights)):
                onward = weight * beta[j, rows]
                beta[i, rows] += onward
                expected += np.bincount(piece, alpha[i, rows] * onward, len(expected))
        return np.log(alpha[length])


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").lower().split() if text else []  # of bytes: A-Z only, and the six white space characters


def word_counts(docs: DataFrame, components: int) -> DataFrame:
    """word and its counts n0, n1, ... in the training texts of each component (all 0 for words of held-out texts only).

    ``docs``: text, component (null: held out). The end token counts training texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int | None, Counter] = {}

        def flush():
            for k, own in counts.items():
                for at in range(0, len(own), 100_000):
                    words, n = list(own)[at:at + 100_000], list(own.values())[at:at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([k] * len(words), pa.int32()), pa.array(n, pa.int64())],
                                                     ["word", "component", "n"])
            counts.clear()

        for batch in batches:
            for text, component in zip(batch.column(0), batch.column(1)):
                component, found = component.as_py(), words_of(text.as_py())
                own = counts.setdefault(component, Counter())
                if component is None:
                    own.update(dict.fromkeys(set(found), 0))
                else:
                    own.update(found)
                    own[END] += 1
            if sum(map(len, counts.values())) > FLUSH:
                yield from flush()
        yield from flush()

    parts = docs.select("text", "component").mapInArrow(run, "word binary, component int, n long")
    return parts.groupBy("word").agg(*(F.sum(F.when(F.col("component") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(components)))


def _held_out(folds: int):
    return F.coalesce(id_remainder("doc_id", folds) == 0, F.lit(False))


def _together(batches: Iterator[pa.RecordBatch], rows: int = WORDS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows``, the last one excepted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _maximised(types: DataFrame, pieces: Pieces, rounds: int) -> Pieces:
    """Expectation maximisation over word types: each counts once, as each frees the same discount."""
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(pieces.logp))
            for batch in _together(batches):
                pieces.marginals(batch.column(0).to_pylist(), total)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "expected"])

        total = np.full(len(pieces.logp), 0.1)
        # one row for each piece of the vocabulary file at most
        for r in types.mapInArrow(run, "piece long, expected double").groupBy("piece").agg(F.sum("expected").alias("expected")).collect():
            total[r["piece"]] += r["expected"]
        pieces.set_weights(total)
    return pieces


def _priced(counts: DataFrame, pieces: Pieces, totals: np.ndarray, distinct: np.ndarray) -> DataFrame:
    """word, n, base and, for each component, the log10 probability of every word.

    ``totals`` and ``distinct`` hold a number for each component and, last, for all together.
    """
    components = len(totals) - 1
    base_total = totals[-1] + 0.1 * (distinct[-1] + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _together(batches):
            words = batch.column(0).to_pylist()
            n = np.stack([batch.column(1 + k).to_numpy() for k in range(components)], 1).astype(float)
            every = n.sum(axis=1)
            known = np.array([w != END for w in words])
            logp = np.full(len(words), math.log(0.1 / base_total))  # an end token that no training text has shown: the base's share
            logp[known] = pieces.marginals([w for w in words if w != END])
            with np.errstate(divide="ignore"):
                if totals[-1]:
                    whole = np.log(np.maximum(every - DISCOUNT, 0) / totals[-1])
                    logp = np.logaddexp(whole, logp + math.log(DISCOUNT * distinct[-1] / totals[-1]))
                by = [np.logaddexp(np.log(np.maximum(n[:, k] - DISCOUNT, 0) / totals[k]), logp + math.log(DISCOUNT * distinct[k] / totals[k]))
                      if totals[k] else logp for k in range(components)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(every.astype(np.int64)), pa.array(np.log10((every + 0.1) / base_total)),
                                              *(pa.array(x / math.log(10)) for x in by)], ["word", "n", "base", *(f"p{k}" for k in range(len(by)))])

    return counts.mapInArrow(run, "word binary, n long, base double, " + ", ".join(f"p{k} double" for k in range(components)))


def _head(priced: DataFrame, most: int) -> list:
    """The most frequent words, at most ``most``, cut at a step of a logarithmic count scale (about 64 rows a doubling)."""
    step = F.floor(F.log2(F.col("n") + 1) * _BINS)
    left, least = most, None
    for r in sorted(priced.groupBy(step.alias("bin")).count().collect(), key=lambda r: -r["bin"]):
        if r["count"] > left:
            break
        left, least = left - r["count"], r["bin"]
    return [] if least is None else priced.filter(step >= least).collect()


def _components(docs: DataFrame, most: int) -> tuple[DataFrame, list[float]]:
    """A column ``component`` on training rows (0, 1, ... by frequency, the rest together; null on held-out rows) and the components' shares."""
    name = F.coalesce(F.col("_group").cast("string"), F.lit(""))
    sizes = docs.filter(~F.col("held_out")).groupBy(name.alias("name")).count().orderBy(F.desc("count"), "name").limit(most).collect()
    total = docs.filter(~F.col("held_out")).count()
    shares = [r["count"] / total for r in sizes]
    rest = 1 - sum(r["count"] for r in sizes) / total if total else 0.0
    which = F.lit(len(sizes))
    for k, r in enumerate(sizes):
        which = F.when(name == r["name"], F.lit(k)).otherwise(which)
    return docs.withColumn("component", F.when(~F.col("held_out"), which)), shares + [rest] * (rest > 0)


def score_texts(docs: DataFrame, pieces_path: str, folds: int = 10, component: str | None = "lang", head: int = HEAD,
                rounds: int = EM_ROUNDS, most_components: int = COMPONENTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    group = F.col(component) if component in docs.columns else F.lit(None).cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", group.alias("_group")).withColumn("held_out", _held_out(folds))
    docs, shares = _components(docs, most_components)
    shares = shares or [1.0]  # no training text: one component without counts
    end = spark.createDataFrame([(END, *[0] * len(shares))], "word binary" + "".join(f", n{k} long" for k in range(len(shares))))
    counts = word_counts(docs, len(shares)).unionByName(end).groupBy("word").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(len(shares))))
    counts = staged(counts, "counts")
    every = sum((F.col(f"n{k}") for k in range(len(shares))), F.lit(0))
    found = counts.select(*(f"n{k}" for k in range(len(shares))), every.alias("n"))
    sums = found.agg(*(F.sum(c).alias(f"s_{c}") for c in found.columns), *(F.count_if(F.col(c) > 0).alias(f"v_{c}") for c in found.columns)).first()
    totals = np.array([sums[f"s_{c}"] for c in found.columns], np.int64)
    distinct = np.array([sums[f"v_{c}"] for c in found.columns], np.int64)

    types = counts.filter((every > 0) & (F.octet_length("word") > 0)).select("word")
    pieces = _maximised(types, Pieces.from_file(pieces_path), rounds)
    priced = staged(_priced(counts, pieces, totals, distinct), "priced")
    names = [c for c in priced.columns if c.startswith("p")]
    top = _head(priced, head)
    sent = spark.sparkContext.broadcast(({bytes(r["word"]): i for i, r in enumerate(top)},
                                         np.array([[r["n"] > 0, r["base"], *(r[c] for c in names)] for r in top], float).reshape(len(top), len(names) + 2)))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("word", pa.binary()), ("tf", pa.int64()),
                        ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), *((c, pa.float64()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_of, table = sent.value
        blank = (None,) * (3 + len(names))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows: list[tuple] = []
                for row, doc_id, held, text in zip(*(part.column(i).to_pylist() for i in range(4))):
                    words = words_of(text)
                    tf = Counter(words)
                    tf[END] += 1
                    rare = [w for w in tf if w not in at_of]
                    rows += [(row, None, None, word, tf.pop(word), *blank) for word in rare]
                    sums = np.fromiter(tf.values(), float, len(tf)) @ table[[at_of[w] for w in tf]] if tf else np.zeros(table.shape[1])
                    rows.append((row, doc_id, held, None, None, len(words) + 1, int(round(sums[0])), *sums[1:].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    parts = staged(source.mapInArrow(run, "row long, doc_id long, held_out boolean, word binary, tf long, n_tokens long, n_known long, base double"
                                     + "".join(f", {c} double" for c in names)), "parts")
    rare = parts.filter(F.col("word").isNotNull()).select("row", "word", "tf").join(priced, "word").select(
        "row", F.when(F.col("n") > 0, F.col("tf")).otherwise(0).alias("n_known"), *((F.col("tf") * F.col(c)).alias(c) for c in ("base", *names)))
    whole = parts.filter(F.col("word").isNull()).drop("word", "tf")
    summed = whole.unionByName(rare, allowMissingColumns=True).groupBy("row").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")), *(F.sum(c).alias(c) for c in ("n_known", "base", *names)))
    logs = [F.col(c) + math.log10(share) for c, share in zip(names, shares)]
    best = F.greatest(*logs) if len(logs) > 1 else logs[0]
    score = best + F.log10(sum((F.pow(F.lit(10.0), x - best) for x in logs), F.lit(0.0)))
    return summed.select("doc_id", "held_out", "n_tokens", F.col("n_known").cast("long").alias("n_known"),
                         F.lit(int(totals[-1])).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), score.alias("score"))
