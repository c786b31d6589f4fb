"""Exact arithmetic helpers.

Money is decimal; means and variances are formed from exact decimal sums so the
result does not depend on partition order (a double running sum would).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
MONEY_SUM = "decimal(22,2)"
MONEY_MEAN = "decimal(18,2)"


def mean_round(sum_col: Column, cnt_col: Column, scale: int = 2, out: str = MONEY_MEAN) -> Column:
    """round(sum / count, scale) with HALF_UP on the exact quotient; NULL when count is 0."""
    return F.round(F.try_divide(sum_col, cnt_col), scale).cast(out)


def var_samp_exact(n: Column, s1: Column, s2: Column) -> Column:
    """Sample variance from count, exact sum and exact sum of squares."""
    num = n.cast("decimal(20,0)") * s2 - s1 * s1
    return F.try_divide(num.cast("double"), (n * (n - 1)).cast("double"))


def std_samp_exact(n: Column, s1: Column, s2: Column) -> Column:
    return F.sqrt(var_samp_exact(n, s1, s2))


def as_double(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("double")


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den in double precision; NULL on a zero or NULL denominator."""
    return F.try_divide(as_double(num), as_double(den))


def flag(pred: Column) -> Column:
    """Boolean -> 0/1 int with NULL treated as false (a NaN compare is False in pandas)."""
    return F.coalesce(pred, F.lit(False)).cast("int")
