"""The offline feature build as one lazy plan.

scan -> union (J1) -> roll-up (A1) -> label join (J2) -> member join (J3)
-> clean (P1-P5) -> stats.fit (A2-A4) -> features (P6-P20) -> prune/encode/fill
(P18, P21-P24). Catalyst sees the whole chain; the only action is the one-row
quantile fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.config import DEFAULT_CONFIG, EngineConfig
from claimlens.functions import features as fx
from claimlens.operators import relational as rel
from claimlens.operators.stats import ClaimStats
from claimlens.sources import claim_views as cv
from claimlens.sources.materialize import materialize

AMT = "InscClaimAmtReimbursed"
DED = "DeductibleAmtPaid"


def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two claim tables stacked. Both come from one table here, so later steps read ``cv.claim_lines``."""
    return rel.union_claims(cv.inpatient_claims(spark, sf_dir), cv.outpatient_claims(spark, sf_dir))


def rolled_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = rel.claim_rollup(cv.claim_lines(spark, sf_dir, integer_key=True))
    return rolled.withColumn("ClaimID", F.col("ClaimID").cast("string"))


def rolled_claims_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolled-up claim table, written once (it is read by several joins downstream)."""
    return materialize(rolled_claims(spark, sf_dir), "rolled_claims")


def merged_claims(spark: SparkSession, sf_dir: str, claims: DataFrame | None = None) -> DataFrame:
    claims = claims if claims is not None else rolled_claims_table(spark, sf_dir)
    merged = rel.label_left_claims(cv.provider_labels(spark, sf_dir), claims)
    return rel.claims_left_beneficiary(merged, cv.beneficiary(spark, sf_dir))


def clean_claims(df: DataFrame, cfg: EngineConfig = DEFAULT_CONFIG) -> DataFrame:
    """Label to int, age, death flag, stay and claim durations; raw dates dropped."""
    out = df
    if "PotentialFraud" in df.columns:
        out = out.withColumn("PotentialFraud", fx.label_to_int(F.col("PotentialFraud")))
    if "DOB" in df.columns:
        out = out.withColumn("Age", fx.age_from_dob(fx.parse_date(df, "DOB"), cfg.reference_year))
    if "DOD" in df.columns:
        out = out.withColumn("IsDead", fx.is_dead(fx.parse_date(df, "DOD")))
    adm = fx.parse_date(df, "AdmissionDt") if "AdmissionDt" in df.columns else F.lit(None).cast("date")
    dis = fx.parse_date(df, "DischargeDt") if "DischargeDt" in df.columns else F.lit(None).cast("date")
    out = out.withColumn("HospitalStayDays", fx.day_diff(dis, adm))
    start = fx.parse_date(df, "ClaimStartDt") if "ClaimStartDt" in df.columns else F.lit(None).cast("date")
    end = fx.parse_date(df, "ClaimEndDt") if "ClaimEndDt" in df.columns else F.lit(None).cast("date")
    out = out.withColumn("ClaimDuration", fx.day_diff(end, start))
    return out.drop("DOB", "DOD", "AdmissionDt", "DischargeDt", "ClaimStartDt", "ClaimEndDt")


def with_claim_features(df: DataFrame, stats: ClaimStats) -> DataFrame:
    """P6-P20 on a cleaned claim table, using fitted stats."""
    q = {k: F.lit(v).cast("double") for k, v in stats.quantiles.items()}
    prov = stats.provider.drop("_rows")
    pat = stats.patient.drop("_rows")
    out = rel.stats_join_back(df, prov, "Provider")
    out = rel.stats_join_back(out, pat, "BeneID")
    amt = F.col(AMT)
    out = out.select("*", *fx.chronic_profile(out))
    total = F.col("TotalChronicConditions")
    cols = [
        *fx.provider_flags(F.col("ProviderClaimCount"), F.col("ProviderStdClaim"),
                           q["provider_count_q90"], q["provider_std_q90"]),
        *fx.patient_flags(F.col("PatientClaimCount"), F.col("PatientProviderCount"), q["patient_count_q95"]),
        *fx.claim_vs_provider(amt, F.col("ProviderAvgClaim")),
        *fx.cost_complexity(amt, total, q["amt_q80"]),
        fx.claim_amount_log(amt),
        *fx.value_flags(amt, q["amt_q95"], q["amt_q99"]),
    ]
    present = set(out.columns)
    if DED in present:
        cols += fx.deductible_flags(F.col(DED), amt)
    out = out.select("*", *cols).drop(DED)
    extra = []
    if "Age" in present:  # member data joined (optional, like the other probed columns)
        age = F.col("Age")
        extra += [*fx.age_flags(age, amt), fx.age_risk_group(age)]
    if "NoOfMonths_PartBCov" in present:
        def opt(c):
            return F.col(c) if c in present else F.lit(None).cast("double")
        extra += fx.coverage_features(opt("NoOfMonths_PartACov"), F.col("NoOfMonths_PartBCov"),
                                      opt("IPAnnualReimbursementAmt"), opt("OPAnnualReimbursementAmt"))
    phys = fx.multi_physician(out)
    if phys is not None:
        extra.append(phys)
    if "Race" in present:
        extra.append(fx.race_risk_group(F.col("Race")))
    if "Gender" in present:
        extra.append(fx.is_male(F.col("Gender")))
    return out.select("*", *extra)


def finalize_features(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Renal flag, prune ids, encode strings, drop leaky, fill 0."""
    out = df
    if "RenalDiseaseIndicator" in out.columns:
        out = out.withColumn("HasRenalDisease", fx.has_renal_disease(F.col("RenalDiseaseIndicator")))
        out = out.drop("RenalDiseaseIndicator")
    kept = out.select(*[F.col(k).alias(f"__key_{k}") for k in keep], "*") if keep else out
    kept = fx.drop_identifiers(kept)
    strings = [c for c in fx.string_columns(kept) if not c.startswith("__key_")]
    if strings:
        from claimlens.operators.encoding import label_encode
        kept = label_encode(kept, strings)
    kept = fx.drop_leaky(kept)
    kept = fx.fill_numeric_zero(kept)
    return kept.select(*[F.col(f"__key_{k}").alias(k) for k in keep],
                       *[c for c in kept.columns if not c.startswith("__key_") and c not in keep])


def cleaned_claims(spark: SparkSession, sf_dir: str, cfg: EngineConfig = DEFAULT_CONFIG) -> DataFrame:
    """Merged and cleaned claim table, written once: stats, quantiles and features all read it."""
    return materialize(clean_claims(merged_claims(spark, sf_dir), cfg), "cleaned_claims")


def feature_table(spark: SparkSession, sf_dir: str, cfg: EngineConfig = DEFAULT_CONFIG,
                  stats: ClaimStats | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    cleaned = cleaned_claims(spark, sf_dir, cfg)
    stats = stats or ClaimStats.fit(cleaned, accuracy=cfg.quantile_accuracy)
    return finalize_features(with_claim_features(cleaned, stats), keep)
