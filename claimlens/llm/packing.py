"""Packing (5): padding-optimal length buckets, token-budget batches inside each bucket.

The global histogram of lengths (one row for each distinct length) goes to a
dynamic program that chooses at most ``buckets`` upper bounds so that the padding,
the sum over documents of bound minus length, is least. In prefix sums C of
counts and S of tokens,

    best[k][j] = min over i < j of best[k-1][i] + L[j] * (C[j] - C[i]) - (S[j] - S[i])

is a minimum over lines with slopes -C[i] at growing L[j], so each layer takes
linear time with a monotone hull; all numbers are exact integers.

Inside a bucket every sequence is padded to the bucket's bound, so a batch holds
``budget // bound`` documents (one if the bound exceeds the budget). Documents
are numbered within a bucket without gathering it: they are dealt by a hash to
slices of about ``slice_rows`` rows, numbered inside a slice in doc_id order, and
shifted by the sizes of the slices before. The number of slices depends on the
row count alone, so results do not depend on partitions.

Defined results: a null or empty text has its end token only; documents longer
than the budget form batches of one; equal lengths share a bucket; repeated rows
are packed each; rows without a doc_id come first in their slice; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlens.llm.stage import staged
from claimlens.llm.token_ids import encoder

BUCKETS = 16
BUDGET = 65_536
SLICE_ROWS = 1024


def best_bounds(histogram: dict[int, int], buckets: int) -> tuple[list[int], int]:
    """Bucket bounds with the least padding, and that padding."""
    lengths = sorted(histogram)
    n = len(lengths)
    if not n:
        return [], 0
    c, s = [0], [0]
    for x in lengths:
        c.append(c[-1] + histogram[x])
        s.append(s[-1] + histogram[x] * x)
    best = [0] + [None] * n  # with no bucket only the empty prefix is covered
    chosen: list[list[int]] = []
    for _ in range(min(buckets, n)):
        hull: deque = deque()  # (slope, intercept, i), slopes falling
        layer, back = [0] + [None] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                line = (-c[j - 1], best[j - 1] + s[j - 1], j - 1)
                while len(hull) > 1 and _useless(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            x = lengths[j - 1]
            while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            layer[j] = hull[0][0] * x + hull[0][1] + x * c[j] - s[j]
            back[j] = hull[0][2]
        best = layer
        chosen.append(back)
    bounds, j = [], n
    for back in reversed(chosen):
        if j == 0:
            break
        bounds.append(lengths[j - 1])
        j = back[j]
    return bounds[::-1], best[n]


def _useless(a, b, c) -> bool:
    """Whether line b is nowhere below both a and c (slopes fall from a to c)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def token_lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens (ids of the whole text and one end id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for got in enc.encode(batch.column(1)):
                n = np.diff(got.bounds) + 1
                yield pa.RecordBatch.from_arrays([batch.column(0)[got.first:got.first + len(n)], pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, n_tokens -> bucket, bound, batch (numbered within the bucket), slot, padding."""
    lengths = staged(lengths.select("doc_id", "n_tokens"), "lengths")
    # one row for each distinct length
    histogram = {r["n_tokens"]: r["n"] for r in lengths.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    bounds, _ = best_bounds(histogram, buckets)
    which, bound, slices = F.lit(None), F.lit(None), F.lit(1)
    for k in reversed(range(len(bounds))):
        rows = sum(n for x, n in histogram.items() if x <= bounds[k] and (k == 0 or x > bounds[k - 1]))
        inside = F.col("n_tokens") <= bounds[k]
        which, bound = F.when(inside, F.lit(k)).otherwise(which), F.when(inside, F.lit(bounds[k])).otherwise(bound)
        slices = F.when(inside, F.lit(-(-rows // slice_rows))).otherwise(slices)
    dealt = lengths.select("doc_id", "n_tokens", which.cast("int").alias("bucket"), bound.cast("long").alias("bound"),
                           F.pmod(F.xxhash64("doc_id", "n_tokens"), slices.cast("long")).alias("slice"))
    sizes = dealt.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(sizes.select("bucket", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    inside = Window.partitionBy("bucket", "slice").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens")
    ranked = dealt.withColumn("place", F.row_number().over(inside) - 1).join(offsets, ["bucket", "slice"])
    place = F.col("before") + F.col("place")
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bound")))
    return ranked.select("doc_id", "n_tokens", "bucket", "bound", F.floor(place / size).cast("long").alias("batch"), (place % size).cast("long").alias("slot"),
                         (F.col("bound") - F.col("n_tokens")).alias("padding"))
