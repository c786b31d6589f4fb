"""Exact quantiles without holding all values in one aggregation buffer.

``percentile`` keeps a map of every distinct value in the one task that merges
the partial results. Here the values are first counted (one row per distinct
value, combined map-side), the counts get running totals slice by slice
(``ranking.prefix_sums``), and the two neighbours of each wanted rank are picked
with a conditional minimum, so no task sees more than its slice.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators.ranking import prefix_sums
from claimlens.sources.materialize import materialize

#: Distinct values that one task sorts for its running totals.
VALUES_PER_SLICE = 250_000


def value_counts(df: DataFrame, series: str, value: str, weight: str | None = None) -> DataFrame:
    """(series, value, freq): one row per distinct non-NULL value, ``freq`` rows (or the sum of ``weight``)."""
    freq = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value"))
              .agg(freq.cast("bigint").alias("freq")).where(F.col("freq") > 0)
              .select(F.lit(series).alias("series"), "value", "freq"))


def exact_quantiles(counts: list[DataFrame], wanted: dict[str, tuple[str, float]]) -> dict[str, float | None]:
    """Quantiles with linear interpolation: ``wanted`` maps a result name to (series, p).

    ``counts`` are ``value_counts`` tables of different series. A series without
    values gives None. The result does not depend on the number of partitions.
    """
    table = materialize(reduce(DataFrame.unionByName, counts), "value_counts")
    # One row per series (their names are given by the caller, not by the data).
    sizes = table.groupBy("series").agg(F.sum("freq").alias("n"), F.count(F.lit(1)).alias("values")).collect()
    totals = {r["series"]: r["n"] for r in sizes}
    slices = -(-sum(r["values"] for r in sizes) // VALUES_PER_SLICE)
    running = prefix_sums(table, ["value"], {"cum": F.col("freq")}, ("series",), slices=max(1, slices))
    picks, places = [], {}
    for name, (series, p) in wanted.items():
        if series not in totals:
            continue
        place = p * (totals[series] - 1)
        places[name] = place
        for side, rank in (("lo", math.floor(place)), ("hi", math.ceil(place))):
            picks.append(F.min(F.when((F.col("series") == series) & (F.col("cum") > rank), F.col("value")))
                         .alias(f"{name}__{side}"))
    if not picks:
        return dict.fromkeys(wanted)
    row = running.agg(*picks).first()
    out: dict[str, float | None] = {}
    for name in wanted:
        if name not in places:
            out[name] = None
            continue
        place, lo, hi = places[name], row[f"{name}__lo"], row[f"{name}__hi"]
        below, above = math.floor(place), math.ceil(place)
        out[name] = lo if below == above else (above - place) * lo + (place - below) * hi
    return out
