"""Operational tables (claims, fraud_predictions, investigations, settings, profiles).

In production these are stored tables appended by the scoring jobs (see
``sources.io``). For queries over the driver data they are derived from it:
claims = roll-up + member data + patient totals; predictions = rule score (R4)
-> tier (R1); investigations = R11 on those predictions, with status/outcome
spread by a fixture rule so every branch of the dashboard queries occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.config import DEFAULT_SETTINGS, PROVIDER_PROFILES
from claimlens.functions import features as fx
from claimlens.functions import rules
from claimlens.operators.stats import patient_stats
from claimlens.plans.pipeline import rolled_claims_table
from claimlens.sources import claim_views as cv
from claimlens.sources.materialize import materialize

CLAIMS_COLUMNS = (
    "claim_id", "provider_id", "patient_id", "claim_amount", "deductible_paid", "patient_age",
    "hospital_stay_days", "claim_duration", "gender", "chronic_alzheimer", "chronic_heartfailure",
    "chronic_kidney", "chronic_cancer", "chronic_diabetes", "claim_status", "submission_date", "updated_at",
    "patient_total_claims", "patient_provider_count", "race_risk_group", "op_annual_amount",
)


#: What ``score_claims`` reads of a claim.
SCORING_COLUMNS = ("claim_id", "claim_amount", "hospital_stay_days", "patient_total_claims", "patient_age",
                   "chronic_diabetes", "chronic_heartfailure", "chronic_cancer", "chronic_kidney", "submission_date")


def claims_table(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] | None = None,
                 materialized: bool = False) -> DataFrame:
    """The claims table, or the named columns of it; a lazy plan unless ``materialized``.

    ``materialized=True`` writes it once, bucketed by claim_id: for plans that read it several times."""
    df = _claims_plan(spark, sf_dir)
    if columns is not None:
        df = df.select(*columns)
    return materialize(df, "claims", bucket_by="claim_id") if materialized else df


def _claims_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The roll-up feeds both the claim rows and the per-patient totals: write it once.
    rolled = rolled_claims_table(spark, sf_dir)
    pat = patient_stats(rolled).select("BeneID", "PatientClaimCount", "PatientProviderCount")
    ben = cv.beneficiary(spark, sf_dir).select(
        "BeneID", "DOB", "Gender", "Race", "OPAnnualReimbursementAmt", "ChronicCond_Alzheimer",
        "ChronicCond_Heartfailure", "ChronicCond_KidneyDisease", "ChronicCond_Cancer", "ChronicCond_Diabetes")
    df = rolled.join(ben, "BeneID", "left").join(pat, "BeneID", "left")
    k = F.col("ClaimID").try_cast("bigint")
    claim_id = (F.when(k % 3 == 0, F.concat(F.lit("CLM_2024"), F.col("ClaimID")))
                 .when(k % 3 == 1, F.concat(F.lit("CLM2025"), F.col("ClaimID")))
                 .otherwise(F.concat(F.lit("CLM"), F.col("ClaimID"))))
    submitted = (F.col("ClaimStartDt").cast("timestamp_ntz")
                 + F.make_dt_interval(F.lit(0), (k % 24).cast("int"), F.lit(0), F.lit(0)))
    stay = F.date_diff("DischargeDt", "AdmissionDt")
    duration = F.date_diff("ClaimEndDt", "ClaimStartDt")
    return df.select(
        claim_id.alias("claim_id"),
        F.col("Provider").alias("provider_id"),
        F.col("BeneID").alias("patient_id"),
        F.col("InscClaimAmtReimbursed").cast("decimal(12,2)").alias("claim_amount"),
        F.col("DeductibleAmtPaid").cast("decimal(12,2)").alias("deductible_paid"),
        fx.age_from_dob(F.col("DOB")).alias("patient_age"),
        F.coalesce(stay, F.lit(0)).alias("hospital_stay_days"),
        F.coalesce(duration, F.lit(1)).alias("claim_duration"),
        F.coalesce(F.col("Gender"), F.lit(1)).alias("gender"),
        *[F.coalesce(F.col(src) == 1, F.lit(False)).alias(dst) for src, dst in (
            ("ChronicCond_Alzheimer", "chronic_alzheimer"), ("ChronicCond_Heartfailure", "chronic_heartfailure"),
            ("ChronicCond_KidneyDisease", "chronic_kidney"), ("ChronicCond_Cancer", "chronic_cancer"),
            ("ChronicCond_Diabetes", "chronic_diabetes"))],
        F.lit("PENDING").alias("claim_status"),
        submitted.alias("submission_date"),
        submitted.alias("updated_at"),
        F.coalesce(F.col("PatientClaimCount").cast("int"), F.lit(1)).alias("patient_total_claims"),
        F.coalesce(F.col("PatientProviderCount").cast("int"), F.lit(1)).alias("patient_provider_count"),
        F.coalesce(fx.race_risk_group(F.col("Race")).cast("int"), F.lit(1)).alias("race_risk_group"),
        F.coalesce(F.col("OPAnnualReimbursementAmt"), F.lit(0)).cast("decimal(12,2)").alias("op_annual_amount"),
    )


def chronic4(df: DataFrame):
    """Diabetes + heart failure + cancer + kidney flags as a count (rule inputs)."""
    return sum(F.col(c).cast("int") for c in ("chronic_diabetes", "chronic_heartfailure", "chronic_cancer",
                                             "chronic_kidney"))


def score_claims(claims: DataFrame, model_probability=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row's model probability where it has one, else the rule probability; then tier, score and factors.

    ``keep`` names claim columns to carry along."""
    c = F.col
    heur = rules.heuristic_probability(c("claim_amount"), c("hospital_stay_days"), c("patient_total_claims"),
                                       c("patient_age"), chronic4(claims))
    p = heur if model_probability is None else F.coalesce(model_probability.cast("decimal(5,4)"), heur)
    factors = rules.risk_factors_batch(c("claim_amount"), c("patient_age"), c("hospital_stay_days"),
                                       c("patient_total_claims"), chronic4(claims))
    return claims.select(
        F.md5(F.concat(F.lit("pred:"), c("claim_id"))).alias("prediction_id"),
        c("claim_id"),
        p.alias("fraud_probability"),
        rules.risk_tier(p).alias("risk_level"),
        F.floor(p * 100).cast("int").alias("risk_score"),
        F.to_json(factors).alias("risk_factors"),
        F.lit("v1.0").alias("model_version"),
        c("submission_date").alias("prediction_timestamp"),
        F.lit(False).alias("investigated"),
        *keep,
    )


def predictions_table(spark: SparkSession, sf_dir: str, claims: DataFrame | None = None) -> DataFrame:
    return score_claims(claims if claims is not None else claims_table(spark, sf_dir))


def create_investigations(predictions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Open an investigation per Critical/High/Medium prediction with p >= 0.6.

    The id is derived from the prediction id (replay-safe) and predictions that
    already have an investigation are skipped, so re-runs do not duplicate cases.
    """
    c = F.col
    todo = predictions.where(c("risk_level").isin("Critical Risk", "High Risk", "Medium Risk")
                             & (c("fraud_probability") >= 0.6))
    if existing is not None:
        todo = todo.join(existing.select("prediction_id").where(c("prediction_id").isNotNull()).distinct(),
                         "prediction_id", "left_anti")
    return todo.select(
        F.md5(F.concat(F.lit("inv:"), c("prediction_id"))).alias("investigation_id"),
        c("claim_id"), c("prediction_id"),
        rules.risk_priority(c("risk_level")).alias("priority_level"),
        F.lit("OPEN").alias("status"),
        F.lit(None).cast("string").alias("assigned_investigator"),
        F.lit(None).cast("string").alias("findings"),
        F.lit(None).cast("string").alias("investigation_outcome"),
        F.lit(0).cast("decimal(12,2)").alias("amount_recovered"),
        c("prediction_timestamp").alias("created_date"),
        F.lit(None).cast("timestamp_ntz").alias("completion_date"),
    )


def investigations_table(spark: SparkSession, sf_dir: str, predictions: DataFrame | None = None) -> DataFrame:
    """R11 output with status/outcome/investigator spread over all branches (fixture rule)."""
    inv = create_investigations(predictions if predictions is not None else predictions_table(spark, sf_dir))
    k = F.regexp_extract(F.col("claim_id"), r"(\d+)$", 1).try_cast("bigint")
    status = F.when(k % 3 == 0, "OPEN").when(k % 3 == 1, "IN_PROGRESS").otherwise("CLOSED")
    outcome = (F.when(k % 5 == 0, "FRAUD_CONFIRMED").when(k % 5 == 1, "FRAUD_DENIED")
                .when(k % 5 == 2, "INSUFFICIENT_EVIDENCE"))
    created = F.col("created_date") + F.make_dt_interval(F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return inv.select(
        "investigation_id", "claim_id", "prediction_id", "priority_level",
        status.alias("status"),
        F.when(status != "OPEN", F.concat(F.lit("INV"), (k % 7).cast("string"))).alias("assigned_investigator"),
        "findings",
        F.when(status == "CLOSED", outcome).alias("investigation_outcome"),
        "amount_recovered",
        created.alias("created_date"),
        F.when(status == "CLOSED", created + F.make_dt_interval(F.lit(7), F.lit(0), F.lit(0), F.lit(0)))
         .alias("completion_date"),
    )


def operational_tables(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] | None = None
                       ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, predictions, investigations) sharing one written claims table.

    ``extra`` names the claim columns read beside those for scoring; None writes all."""
    columns = None if extra is None else (*SCORING_COLUMNS, *extra)
    c = claims_table(spark, sf_dir, columns, materialized=True)
    p = predictions_table(spark, sf_dir, claims=c)
    return c, p, investigations_table(spark, sf_dir, predictions=p)


def settings_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(n, v, t, d) for n, v, t, d in DEFAULT_SETTINGS],
        "setting_name string, setting_value string, setting_type string, description string")


def provider_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, r, a, c) for p, r, a, c in PROVIDER_PROFILES],
                                 "provider_id string, risk string, base_avg int, base_count int")
