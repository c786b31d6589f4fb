"""The 40-slot numeric vector built from one claims-table row.

Fixed values: slot constants (race 1, coverage 12/12, provider stats
5000/2000/50, claim/5000, claims x 3000, >10 claims, >10000 amount, <=1 day and
>3000, >14 days, age >= 70) are the application's seeding defaults.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return c.cast("double")


def compact_feature_columns() -> list[Column]:
    c = F.col
    amt, ded, days, age, claims = c("claim_amount"), c("deductible_paid"), c("hospital_stay_days"), \
        c("patient_age"), c("patient_total_claims")
    zero = F.lit(0.0)
    slots = [
        _d(amt), _d(ded), _d(c("gender")), F.lit(1.0), F.lit(12.0), F.lit(12.0), zero,
        _d(c("chronic_heartfailure")), _d(c("chronic_kidney")), _d(c("chronic_cancer")), zero, zero,
        _d(c("chronic_diabetes")), zero, zero, zero, zero,
        _d(amt * 2), _d(ded * 2), _d(amt), _d(ded), _d(age), zero, _d(days), _d(F.greatest(days, F.lit(1))),
        F.lit(5000.0), F.lit(2000.0), F.lit(50.0), _d(amt) / F.lit(5000.0), zero,
        _d(claims * 3000), _d(claims), _d(claims > 10),
        _d(ded) / _d(F.greatest(amt, F.lit(1))),
        _d(amt > 10000), _d((days <= 1) & (amt > 3000)), _d(days > 14), _d(age >= 70), zero,
        _d(c("chronic_kidney")),
    ]
    return [s.alias(f"v{i:02d}") for i, s in enumerate(slots)]


def assemble(df, cols: list[str], out: str = "features"):
    """Pack numeric columns into an MLlib vector (JVM-side VectorAssembler)."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)
