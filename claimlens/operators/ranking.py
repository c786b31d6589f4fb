"""Global ranks and prefix sums without a single-partition window.

A window with no ``partitionBy`` moves the whole table into one task. Instead:

1. give every row a *slice* number that is a deterministic, monotone function of
   its first order column (fitted quantile bounds for numbers and dates, the
   bytes after the shared prefix for strings, leading digits for hash keys);
2. compute the running sum inside each slice (window partitioned by slice);
3. total each slice (at most ``n`` rows per group), prefix-sum those totals on
   that small table, and add the offset back (a size-bounded broadcast).

The slice is computed from the row itself -- not from a sampled range
partitioner -- so every branch of the plan and every task retry agrees on it.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _slices(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _byte_number(col: str, skip: int) -> Column:
    """Eight UTF-8 bytes of a string after the first ``skip``, as a number: monotone in Spark's (binary) string
    order among strings that agree on the bytes skipped."""
    hex16 = F.rpad(F.hex(F.substring(F.encode(F.col(col), "UTF-8"), skip + 1, 8)), 16, "0")
    return F.conv(hex16, 16, 10).cast("decimal(20,0)").cast("double")


def _shared_bytes(df: DataFrame, col: str) -> int:
    """How many leading bytes all strings of a column share (those of its least and greatest)."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    if low is None:
        return 0
    low, high = (v if isinstance(v, (bytes, bytearray)) else v.encode("utf-8") for v in (low, high))
    return next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))


def slice_column(df: DataFrame, col: str, n: int, descending: bool = False, accuracy: int = 10000,
                 uniform: bool = False) -> tuple[DataFrame, str]:
    """Add ``__slice`` in [0, n): monotone in ``col`` (reversed when descending).

    Numbers, dates and strings get slice bounds from approximate quantiles of the
    value (strings through the 8 bytes that follow the prefix which all of them
    share). ``uniform=True`` (hex digests) skips the fit and slices on the first
    eight hex digits directly.
    """
    dtype = df.schema[col].dataType
    if n <= 1:
        return df.withColumn("__slice", F.lit(0)), "__slice"
    is_text = isinstance(dtype, (T.StringType, T.BinaryType))
    if is_text and uniform:
        lead = F.coalesce(F.conv(F.substring(F.col(col), 1, 8), 16, 10).cast("bigint"), F.lit(0))
        s = F.floor(lead * n / (1 << 32)).cast("int")
    else:
        if is_text:
            num = _byte_number(col, _shared_bytes(df, col))
        elif isinstance(dtype, T.NumericType):
            num = F.col(col).cast("double")
        else:
            num = F.unix_micros(F.col(col).cast("timestamp")).cast("double")
        probe = df.select(num.alias("__x")).where(F.col("__x").isNotNull())
        bounds = probe.agg(F.percentile_approx("__x", [i / n for i in range(1, n)], max(accuracy, 10 * n))).first()[0] or []
        splits = [float("-inf")] + sorted(set(float(b) for b in bounds)) + [float("inf")]
        if len(splits) < 3:
            splits = [float("-inf"), 0.0, float("inf")]
        df = Bucketizer(splits=splits, inputCol="__x", outputCol="__b", handleInvalid="keep") \
            .transform(df.withColumn("__x", num)).drop("__x")
        s = F.least(F.col("__b").cast("int"), F.lit(n - 1))
    if descending:
        s = F.lit(n - 1) - s
    # Spark sorts NULL first ascending and last descending: both map to the edge slice.
    s = F.when(F.col(col).isNull(), F.lit(n - 1 if descending else 0)).otherwise(s)
    out = df.withColumn("__slice", s.cast("int"))
    return (out.drop("__b") if "__b" in out.columns else out), "__slice"


def prefix_sums(df: DataFrame, order_cols: list[str], values: dict[str, Column],
                partition_cols: tuple[str, ...] = (), inclusive: bool = True, descending: bool = False,
                slices: int | None = None, uniform: bool = False) -> DataFrame:
    """Add ``name`` = running sum of ``values[name]`` in ``order_cols`` order within
    ``partition_cols``. ``order_cols`` must give a total order for stable results."""
    n = slices or _slices(df)
    tmp = df.select("*", *[v.alias(f"__v_{k}") for k, v in values.items()])
    tmp, sl = slice_column(tmp, order_cols[0], n, descending, uniform=uniform)
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    w = (Window.partitionBy(sl, *partition_cols).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for k in values:
        tmp = tmp.withColumn(f"__run_{k}", F.sum(f"__v_{k}").over(w))
    totals = tmp.groupBy(sl, *partition_cols).agg(*[F.sum(f"__v_{k}").alias(f"__tot_{k}") for k in values])
    # Small table: at most n rows per partition group.
    wt = Window.partitionBy(*partition_cols).orderBy(sl) if partition_cols else Window.orderBy(sl)
    wt = wt.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(sl, *partition_cols,
                            *[F.coalesce(F.sum(f"__tot_{k}").over(wt), F.lit(0)).alias(f"__off_{k}") for k in values])
    out = tmp.join(F.broadcast(offsets), [sl, *partition_cols], "left")
    for k in values:
        run = F.col(f"__run_{k}") + F.coalesce(F.col(f"__off_{k}"), F.lit(0))
        out = out.withColumn(k, run if inclusive else run - F.col(f"__v_{k}"))
    drop = [sl] + [f"__{t}_{k}" for k in values for t in ("v", "run", "off")]
    return out.drop(*drop)


def global_rank(df: DataFrame, order_cols: list[str], name: str = "rank", partition_cols: tuple[str, ...] = (),
                descending: bool = False, slices: int | None = None, uniform: bool = False) -> DataFrame:
    """1-based row number in ``order_cols`` order within ``partition_cols``."""
    return prefix_sums(df, order_cols, {name: F.lit(1).cast("bigint")}, partition_cols, True, descending, slices,
                       uniform)
