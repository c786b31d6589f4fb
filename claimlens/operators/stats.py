"""Group statistics and global quantiles (A2-A5) as a fitted, saveable object.

Provider and patient statistics are hash aggregates keyed by Provider / BeneID
and are joined back by key (never a whole-table window). Quantiles are computed
once and kept as scalars, so scoring a new batch does not recompute them on the
batch (``fit_on='saved'``), while ``fit_on='batch'`` reproduces the recompute-on-
the-data behaviour for parity.

Quantiles of provider- or patient-level values "over claim rows" are weighted by
the rows of each group on the small stats tables, so the large joined table is
not rescanned to compute them (``operators.quantiles``).
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions.exact import MONEY_SUM, as_double, mean_round, std_samp_exact
from claimlens.operators.quantiles import exact_quantiles, value_counts
from claimlens.sources.materialize import materialize

AMT = "InscClaimAmtReimbursed"

QUANTILE_NAMES = ("amt_q80", "amt_q90", "amt_q95", "amt_q99", "provider_count_q90",
                  "provider_std_q90", "patient_count_q95")


# A2
def provider_stats(df: DataFrame, key: str = "Provider", amt: str = AMT) -> DataFrame:
    a = F.col(amt)
    n = F.count(a)
    s1 = F.sum(a)
    s2 = F.sum(a * a)
    return (df.groupBy(key)
              .agg(n.alias("n"), s1.alias("s1"), s2.alias("s2"), F.count(F.lit(1)).alias("_rows"))
              .select(key,
                      F.col("n").alias("ProviderClaimCount"),
                      mean_round(F.col("s1"), F.col("n")).alias("ProviderAvgClaim"),
                      F.round(std_samp_exact(F.col("n"), F.col("s1"), F.col("s2")), 2).alias("ProviderStdClaim"),
                      F.coalesce(F.col("s1"), F.lit(0)).cast(MONEY_SUM).alias("ProviderTotalClaims"),
                      "_rows"))


# A3
def patient_stats(df: DataFrame, key: str = "BeneID", amt: str = AMT, provider: str = "Provider",
                  approx_distinct: bool = False) -> DataFrame:
    a = F.col(amt)
    distinct = F.approx_count_distinct(provider) if approx_distinct else F.countDistinct(provider)
    return (df.where(F.col(key).isNotNull())
              .groupBy(key)
              .agg(F.count(a).alias("PatientClaimCount"),
                   F.coalesce(F.sum(a), F.lit(0)).cast(MONEY_SUM).alias("PatientTotalSpend"),
                   mean_round(F.sum(a), F.count(a)).alias("PatientAvgClaim"),
                   distinct.alias("PatientProviderCount"),
                   F.count(F.lit(1)).alias("_rows")))


# A4
def fit_quantiles(claims: DataFrame, prov: DataFrame, pat: DataFrame, amt: str = AMT,
                  accuracy: int | None = None) -> dict[str, float | None]:
    """Every threshold the features need, by name.

    Exact by default; ``accuracy`` takes the claim amounts' ones from
    ``percentile_approx`` (the group-level ones stay exact)."""
    amounts = {"amt_q80": 0.8, "amt_q90": 0.9, "amt_q95": 0.95, "amt_q99": 0.99}
    wanted = {"provider_count_q90": ("provider_count", 0.9), "provider_std_q90": ("provider_std", 0.9),
              "patient_count_q95": ("patient_count", 0.95)}
    counts = [value_counts(prov, "provider_count", "ProviderClaimCount", "_rows"),
              value_counts(prov, "provider_std", "ProviderStdClaim", "_rows"),
              value_counts(pat, "patient_count", "PatientClaimCount", "_rows")]
    if accuracy is None:
        counts.append(value_counts(claims, "amt", amt))
        wanted |= {name: ("amt", p) for name, p in amounts.items()}
    out = exact_quantiles(counts, wanted)
    if accuracy is not None:
        out |= claims.agg(*[F.percentile_approx(as_double(amt), p, accuracy).alias(name)
                            for name, p in amounts.items()]).first().asDict()
    return {name: out[name] for name in QUANTILE_NAMES}


def global_quantiles(claims: DataFrame, prov: DataFrame, pat: DataFrame, amt: str = AMT,
                     accuracy: int | None = None) -> DataFrame:
    """One-row table of every threshold the features need."""
    fitted = fit_quantiles(claims, prov, pat, amt, accuracy)
    return claims.sparkSession.createDataFrame([tuple(fitted[n] for n in QUANTILE_NAMES)],
                                               ", ".join(f"{n} double" for n in QUANTILE_NAMES))


# A5
def fallback_stats(df: DataFrame, amt: str = AMT) -> tuple[DataFrame, DataFrame]:
    """Unrounded provider mean/std/count and patient sum/count (simplified feature path)."""
    a = F.col(amt)
    prov = (df.groupBy("Provider")
              .agg(F.count(a).alias("n"), F.sum(a).alias("s1"), F.sum(a * a).alias("s2"))
              .select("Provider",
                      F.try_divide(F.col("s1").cast("double"), F.col("n").cast("double")).alias("ProviderAvgClaim"),
                      std_samp_exact(F.col("n"), F.col("s1"), F.col("s2")).alias("ProviderStdClaim"),
                      F.col("n").alias("ProviderClaimCount")))
    pat = (df.where(F.col("BeneID").isNotNull()).groupBy("BeneID")
             .agg(F.coalesce(F.sum(a), F.lit(0)).cast(MONEY_SUM).alias("PatientTotalClaims"),
                  F.count(a).alias("PatientClaimCount")))
    return prov, pat


@dataclass
class ClaimStats:
    """Fitted statistics: provider/patient tables plus scalar thresholds."""
    provider: DataFrame
    patient: DataFrame
    quantiles: dict

    @classmethod
    def fit(cls, df: DataFrame, accuracy: int | None = None) -> "ClaimStats":
        # The quantiles and the join back both read them: written once.
        prov = materialize(provider_stats(df), "provider_stats")
        pat = materialize(patient_stats(df), "patient_stats")
        return cls(prov, pat, fit_quantiles(df, prov, pat, accuracy=accuracy))

    def save(self, path: str) -> None:
        self.provider.write.mode("overwrite").parquet(os.path.join(path, "provider"))
        self.patient.write.mode("overwrite").parquet(os.path.join(path, "patient"))
        spark = self.provider.sparkSession
        spark.createDataFrame([(json.dumps(self.quantiles),)], "q string") \
             .write.mode("overwrite").json(os.path.join(path, "quantiles"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ClaimStats":
        q = json.loads(spark.read.json(os.path.join(path, "quantiles")).first()["q"])
        return cls(spark.read.parquet(os.path.join(path, "provider")),
                   spark.read.parquet(os.path.join(path, "patient")), q)
