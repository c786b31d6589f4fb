"""Categorical encodings (P24 label encoding, P25 one-hot with first level dropped).

The dictionary is fitted on the distinct values (a distributed ``distinct``),
ranked with the range-partitioned global rank (no single-task window), and
applied with a join that AQE broadcasts only when the measured size is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators.ranking import global_rank
from claimlens.sources.materialize import materialize

#: Levels of a one-hot column at most.
MAX_LEVELS = 1_000
MISSING_TEXT = "nan"  # a missing value is encoded as this text, as str() of NaN gives


def _as_text(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(MISSING_TEXT))


def fit_label_dictionary(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, code) with codes 0..n-1 in lexicographic (binary) order per column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _as_text(c).alias("value")) for c in cols]))
    long = df.select(pairs.alias("p")).select("p.column", "p.value").distinct()
    # Distinct values only, written once: slices, ranks and totals read them, then every column's lookup.
    ranked = global_rank(materialize(long, "levels"), ["value"], name="code1", partition_cols=("column",))
    return materialize(ranked.select("column", "value", (F.col("code1") - 1).cast("int").alias("code")), "dictionary")


def apply_label_dictionary(df: DataFrame, dictionary: DataFrame, cols: list[str],
                           unseen_code: int = -1) -> DataFrame:
    out = df
    for c in cols:
        d = dictionary.where(F.col("column") == c).select(F.col("value").alias(f"__val_{c}"),
                                                          F.col("code").alias(f"__code_{c}"))
        out = (out.withColumn(f"__val_{c}", _as_text(c))
                  .join(d, f"__val_{c}", "left")
                  .withColumn(c, F.coalesce(F.col(f"__code_{c}"), F.lit(unseen_code)))
                  .drop(f"__val_{c}", f"__code_{c}"))
    return out


def label_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    return apply_label_dictionary(df, fit_label_dictionary(df, cols), cols)


def fit_levels(df: DataFrame, col: str, limit: int = MAX_LEVELS) -> list[str]:
    """The sorted levels of a categorical column; an error above ``limit`` (each becomes an output column)."""
    text = F.col(col).cast("string")
    found = [r[0] for r in df.select(text).where(text.isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"column {col!r} has more than {limit} levels; encode it with label_encode")
    return sorted(found)


def one_hot_drop_first(df: DataFrame, cols: list[str], levels: dict[str, list[str]] | None = None) -> DataFrame:
    """One 0/1 column per level except the lexicographically first; source column dropped.

    ``levels`` may be given; otherwise ``fit_levels`` reads them from the data.
    """
    out = df
    for c in cols:
        lv = levels[c] if levels and c in levels else fit_levels(df, c)
        out = out.select("*", *[F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
                                for v in lv[1:]])
        out = out.drop(c)
    return out
