"""Registered feature, join and statistics queries (P1-P27, J1-J5, J9, A1-A5, full feature table)."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.config import CHRONIC_CONDITIONS
from claimlens.functions import features as fx
from claimlens.operators import encoding
from claimlens.operators import relational as rel
from claimlens.operators import stats as st
from claimlens.operators.quantiles import exact_quantiles, value_counts
from claimlens.plans import pipeline as pl
from claimlens.plans.oracle_views import TOTAL_CHRONIC, flag, ratio, std_exact, with_views
from claimlens.plans.registry import register
from claimlens.sources import claim_views as cv
from claimlens.sources import operational as op
from claimlens.sources.materialize import materialize

AMT = "InscClaimAmtReimbursed"
CHRONIC_COLS = [f"ChronicCond_{n}" for n in CHRONIC_CONDITIONS]


def _cleaned(spark, sf):
    return pl.cleaned_claims(spark, sf)


def _featured(spark, sf):
    cleaned = _cleaned(spark, sf)
    return pl.with_claim_features(cleaned, st.ClaimStats.fit(cleaned))


FINAL_FEATURES = [
    "PotentialFraud", AMT, "Gender", "Race", "NoOfMonths_PartACov", "NoOfMonths_PartBCov", *CHRONIC_COLS,
    "IPAnnualReimbursementAmt", "IPAnnualDeductibleAmt", "OPAnnualReimbursementAmt", "OPAnnualDeductibleAmt",
    "Age", "IsDead", "ClaimDuration", "PatientTotalSpend", "PatientAvgClaim", "PatientProviderCount",
    "TotalChronicConditions", "HasMultipleConditions", "NoChronicConditions", "HasHeartCondition", "HasDiabetes",
    "IsFrequentPatient", "PatientProviderShopping", "IsHighVsProviderAvg", "CostPerCondition",
    "HighCostLowComplexity", "ClaimAmountLog", "IsHighValueClaim", "IsExtremeValueClaim", "DeductibleRatio",
    "IsZeroDeductible", "IsLowDeductible", "IsHighDeductible", "IsElderly", "IsVeryElderly", "IsYoungHighCost",
    "AgeRiskGroup", "PartBCoverageRatio", "FullYearCoverage", "IPMonthlyAvg", "OPMonthlyAvg", "RaceRiskGroup",
    "IsMale", "HasRenalDisease",
]
# Logarithms differ in the last ulp between the JVM and C math libraries, so the
# registered queries present ClaimAmountLog rounded to 9 decimals on both engines.
LOG_DIGITS = 9
_final_sql = ",\n  ".join(f"round(coalesce({c}, 0), {LOG_DIGITS}) AS {c}" if c == "ClaimAmountLog"
                          else f"coalesce({c}, 0) AS {c}" for c in FINAL_FEATURES)


@register("feature_table", with_views(["featured"], f"SELECT ClaimID, Provider,\n  {_final_sql}\nFROM featured"),
          bench=True)
def q_feature_table(spark, sf):
    ft = pl.feature_table(spark, sf, keep=("ClaimID", "Provider"))
    return ft.withColumn("ClaimAmountLog", F.round("ClaimAmountLog", LOG_DIGITS))


# --- sources over the claim views -------------------------------------------------------------

@register("union_claims", with_views(["claim_lines"], "SELECT * FROM claim_lines"))
def q_union_claims(spark, sf):
    return pl.claim_lines(spark, sf)


@register("claim_rollup", with_views(["rollup"], "SELECT * FROM rollup"), bench=True)
def q_claim_rollup(spark, sf):
    return pl.rolled_claims(spark, sf)


@register("label_left_claims", with_views(["labels_v", "rollup"],
                                          "SELECT * FROM labels_v LEFT JOIN rollup USING (Provider)"))
def q_label_left_claims(spark, sf):
    return rel.label_left_claims(cv.provider_labels(spark, sf), pl.rolled_claims_table(spark, sf))


@register("claims_left_beneficiary", with_views(["rollup", "beneficiary"],
                                                "SELECT * FROM rollup LEFT JOIN beneficiary USING (BeneID)"))
def q_claims_left_beneficiary(spark, sf):
    return rel.claims_left_beneficiary(pl.rolled_claims(spark, sf), cv.beneficiary(spark, sf))


@register("claims_enriched", with_views(["rollup", "beneficiary", "labels_v"],
                                        "SELECT * FROM rollup LEFT JOIN beneficiary USING (BeneID) "
                                        "LEFT JOIN labels_v USING (Provider)"))
def q_claims_enriched(spark, sf):
    return rel.claims_enriched(pl.rolled_claims(spark, sf), cv.beneficiary(spark, sf), cv.provider_labels(spark, sf))


@register("stats_join_back", with_views(["with_stats"], """SELECT ClaimID, Provider, BeneID, ProviderClaimCount,
  ProviderAvgClaim, ProviderStdClaim, ProviderTotalClaims, PatientClaimCount, PatientTotalSpend, PatientAvgClaim,
  PatientProviderCount FROM with_stats"""))
def q_stats_join_back(spark, sf):
    cleaned = _cleaned(spark, sf)
    out = rel.stats_join_back(cleaned, st.provider_stats(cleaned).drop("_rows"), "Provider")
    out = rel.stats_join_back(out, st.patient_stats(cleaned).drop("_rows"), "BeneID")
    return out.select("ClaimID", "Provider", "BeneID", "ProviderClaimCount", "ProviderAvgClaim", "ProviderStdClaim",
                      "ProviderTotalClaims", "PatientClaimCount", "PatientTotalSpend", "PatientAvgClaim",
                      "PatientProviderCount")


@register("membership_filter", with_views(["predictions"], """SELECT claim_id, risk_level FROM predictions
WHERE risk_level IN ('Critical Risk', 'High Risk')"""))
def q_membership_filter(spark, sf):
    p = op.predictions_table(spark, sf).select("claim_id", "risk_level")
    return rel.membership_filter(p, "risk_level", ["Critical Risk", "High Risk"])


# --- aggregates ---------------------------------------------------------------------------------

@register("provider_stats", with_views(["prov_stats"], "SELECT * FROM prov_stats"))
def q_provider_stats(spark, sf):
    return st.provider_stats(_cleaned(spark, sf)).drop("_rows")


@register("patient_stats", with_views(["pat_stats"], "SELECT * FROM pat_stats"))
def q_patient_stats(spark, sf):
    return st.patient_stats(_cleaned(spark, sf)).drop("_rows")


@register("global_quantiles", with_views(["quants"], "SELECT " + ", ".join(
    f"round({c}, 6) AS {c}" for c in st.QUANTILE_NAMES) + " FROM quants"))
def q_global_quantiles(spark, sf):
    cleaned = _cleaned(spark, sf)
    q = st.global_quantiles(cleaned, st.provider_stats(cleaned), st.patient_stats(cleaned))
    return q.select(*[F.round(c, 6).alias(c) for c in st.QUANTILE_NAMES])


@register("fallback_stats", with_views(["cleaned"], f"""SELECT 'provider' AS level, Provider AS id,
  CAST(sum({AMT}) AS DOUBLE) / CAST(nullif(count({AMT}), 0) AS DOUBLE) AS mean_amount,
  {std_exact(f'count({AMT})', f'sum({AMT})', f'sum(CAST({AMT} AS DECIMAL(18,2)) * CAST({AMT} AS DECIMAL(18,2)))')} AS std_amount,
  CAST(NULL AS DECIMAL(22,2)) AS sum_amount, count({AMT}) AS n
FROM cleaned GROUP BY Provider
UNION ALL
SELECT 'patient', BeneID, NULL, NULL, CAST(coalesce(sum({AMT}), 0) AS DECIMAL(22,2)), count({AMT})
FROM cleaned WHERE BeneID IS NOT NULL GROUP BY BeneID"""))
def q_fallback_stats(spark, sf):
    prov, pat = st.fallback_stats(_cleaned(spark, sf))
    a = prov.select(F.lit("provider").alias("level"), F.col("Provider").alias("id"),
                    F.col("ProviderAvgClaim").alias("mean_amount"), F.col("ProviderStdClaim").alias("std_amount"),
                    F.lit(None).cast("decimal(22,2)").alias("sum_amount"), F.col("ProviderClaimCount").alias("n"))
    b = pat.select(F.lit("patient").alias("level"), F.col("BeneID").alias("id"),
                   F.lit(None).cast("double").alias("mean_amount"), F.lit(None).cast("double").alias("std_amount"),
                   F.col("PatientTotalClaims").alias("sum_amount"), F.col("PatientClaimCount").alias("n"))
    return rel.union_results(a, b)


# --- scalar features ----------------------------------------------------------------------------

@register("label_to_int", with_views(["labels_v"], """SELECT Provider,
  CASE WHEN PotentialFraud IN ('Yes', 'Y') THEN 1 WHEN PotentialFraud IN ('No', 'N') THEN 0 END AS PotentialFraud
FROM labels_v"""))
def q_label_to_int(spark, sf):
    lab = cv.provider_labels(spark, sf)
    return lab.select("Provider", fx.label_to_int(F.col("PotentialFraud")).alias("PotentialFraud"))


@register("age_from_dob", with_views(["beneficiary"], "SELECT BeneID, CAST(2023 - year(DOB) AS INTEGER) AS Age "
                                                      "FROM beneficiary"))
def q_age_from_dob(spark, sf):
    b = cv.beneficiary(spark, sf)
    return b.select("BeneID", fx.age_from_dob(fx.parse_date(b, "DOB")).alias("Age"))


@register("is_dead", with_views(["beneficiary"], "SELECT BeneID, CAST(DOD IS NOT NULL AS INTEGER) AS IsDead "
                                                 "FROM beneficiary"))
def q_is_dead(spark, sf):
    b = cv.beneficiary(spark, sf)
    return b.select("BeneID", fx.is_dead(fx.parse_date(b, "DOD")).alias("IsDead"))


@register("hospital_stay_days", with_views(["rollup"], "SELECT ClaimID, CAST(date_diff('day', AdmissionDt, "
                                                       "DischargeDt) AS INTEGER) AS HospitalStayDays FROM rollup"))
def q_hospital_stay_days(spark, sf):
    r = pl.rolled_claims(spark, sf)
    return r.select("ClaimID", fx.day_diff(F.col("DischargeDt"), F.col("AdmissionDt")).alias("HospitalStayDays"))


@register("claim_duration", with_views(["rollup"], "SELECT ClaimID, CAST(date_diff('day', ClaimStartDt, "
                                                   "ClaimEndDt) AS INTEGER) AS ClaimDuration FROM rollup"))
def q_claim_duration(spark, sf):
    r = pl.rolled_claims(spark, sf)
    return r.select("ClaimID", fx.day_diff(F.col("ClaimEndDt"), F.col("ClaimStartDt")).alias("ClaimDuration"))


@register("chronic_profile", with_views(["beneficiary"], f"""SELECT BeneID,
  {TOTAL_CHRONIC} AS TotalChronicConditions, {flag(TOTAL_CHRONIC + ' > 2')} AS HasMultipleConditions,
  {flag(TOTAL_CHRONIC + ' = 0')} AS NoChronicConditions, CAST(ChronicCond_Heartfailure AS INTEGER) AS HasHeartCondition,
  CAST(ChronicCond_Diabetes AS INTEGER) AS HasDiabetes FROM beneficiary"""))
def q_chronic_profile(spark, sf):
    b = cv.beneficiary(spark, sf)
    return b.select("BeneID", *fx.chronic_profile(b))


def _feature_query(cols):
    def fn(spark, sf):
        return _featured(spark, sf).select("ClaimID", "Provider", *[
            F.round(c, LOG_DIGITS).alias(c) if c == "ClaimAmountLog" else F.col(c) for c in cols])
    return fn


_FEATURE_GROUPS = {
    "claim_vs_provider": ["ClaimVsProviderAvg", "IsHighVsProviderAvg"],
    "cost_complexity": ["CostPerCondition", "HighCostLowComplexity"],
    "claim_amount_log": ["ClaimAmountLog"],
    "value_flags": ["IsHighValueClaim", "IsExtremeValueClaim"],
    "deductible_flags": ["DeductibleRatio", "IsZeroDeductible", "IsLowDeductible", "IsHighDeductible"],
    "age_flags": ["IsElderly", "IsVeryElderly", "IsYoungHighCost"],
    "age_risk_group": ["AgeRiskGroup"],
    "coverage_features": ["PartBCoverageRatio", "FullYearCoverage", "IPMonthlyAvg", "OPMonthlyAvg"],
    "race_risk_group": ["RaceRiskGroup"],
    "is_male": ["IsMale"],
    "provider_flags": ["IsHighVolumeProvider", "ProviderClaimStdHigh"],
    "patient_flags": ["IsFrequentPatient", "PatientProviderShopping"],
}
for _key, _cols in _FEATURE_GROUPS.items():
    _sel = ", ".join(f"round({c}, {LOG_DIGITS}) AS {c}" if c == "ClaimAmountLog" else c for c in _cols)
    register(_key, with_views(["featured"], f"SELECT ClaimID, Provider, {_sel} FROM featured"))(
        _feature_query(_cols))


@register("has_renal_disease", with_views(["beneficiary"], """SELECT BeneID,
  CAST(NOT (RenalDiseaseIndicator IS NOT DISTINCT FROM 'N') AS INTEGER) AS HasRenalDisease FROM beneficiary"""))
def q_has_renal_disease(spark, sf):
    b = cv.beneficiary(spark, sf)
    return b.select("BeneID", fx.has_renal_disease(F.col("RenalDiseaseIndicator")))


@register("multi_physician", with_views(["claim_lines"], """SELECT ClaimID, LineNo, ClaimSource,
  CAST(coalesce(len(list_distinct(list_filter([AttendingPhysician, OperatingPhysician, OtherPhysician],
       lambda x: x IS NOT NULL))) > 1, false) AS INTEGER) AS HasMultiplePhysicians FROM claim_lines"""))
def q_multi_physician(spark, sf):
    lines = cv.claim_lines(spark, sf)
    return lines.select("ClaimID", "LineNo", "ClaimSource", fx.multi_physician(lines))


@register("drop_identifiers", with_views(["cleaned"], "SELECT * EXCLUDE (ClaimID, BeneID, Provider, State, County) "
                                                      "FROM cleaned"))
def q_drop_identifiers(spark, sf):
    return fx.drop_identifiers(_cleaned(spark, sf))


@register("drop_leaky", with_views(["featured"], """SELECT ClaimID, Provider, PatientTotalSpend, PatientAvgClaim,
  PatientProviderCount, PatientProviderShopping, IsHighVsProviderAvg FROM featured"""))
def q_drop_leaky(spark, sf):
    out = fx.drop_leaky(_featured(spark, sf))
    keep = [c for c in out.columns if c.startswith("Provider") or c.startswith("Patient")]
    return out.select("ClaimID", *keep, "IsHighVsProviderAvg")


@register("fill_numeric_zero", with_views(["cleaned"], f"""SELECT ClaimID, coalesce({AMT}, 0) AS {AMT},
  coalesce(HospitalStayDays, 0) AS HospitalStayDays, coalesce(ClaimDuration, 0) AS ClaimDuration,
  coalesce(Age, 0) AS Age, coalesce(IsDead, 0) AS IsDead, coalesce(PotentialFraud, 0) AS PotentialFraud FROM cleaned"""))
def q_fill_numeric_zero(spark, sf):
    c = _cleaned(spark, sf).select("ClaimID", AMT, "HospitalStayDays", "ClaimDuration", "Age", "IsDead",
                                   "PotentialFraud")
    return fx.fill_numeric_zero(c)


@register("label_encode", with_views(["claim_lines"], """SELECT ClaimID, LineNo, ClaimSource,
  CAST(dense_rank() OVER (ORDER BY coalesce(AttendingPhysician, 'nan')) - 1 AS INTEGER) AS AttendingPhysician,
  CAST(dense_rank() OVER (ORDER BY coalesce(OperatingPhysician, 'nan')) - 1 AS INTEGER) AS OperatingPhysician
FROM claim_lines"""))
def q_label_encode(spark, sf):
    # Every column's distinct values, their ranks and the lookups read the lines: write them once.
    lines = materialize(cv.claim_lines(spark, sf).select("ClaimID", "LineNo", "ClaimSource", "AttendingPhysician",
                                                         "OperatingPhysician"), "encoded_lines")
    return encoding.label_encode(lines, ["AttendingPhysician", "OperatingPhysician"])


@register("one_hot_drop_first", with_views(["beneficiary"], """SELECT BeneID,
  CAST(coalesce(RenalDiseaseIndicator = 'Y', false) AS INTEGER) AS RenalDiseaseIndicator_Y FROM beneficiary"""))
def q_one_hot_drop_first(spark, sf):
    b = cv.beneficiary(spark, sf).select("BeneID", "RenalDiseaseIndicator")
    return encoding.one_hot_drop_first(b, ["RenalDiseaseIndicator"])


@register("fallback_features", with_views(["cleaned"], f"""SELECT c.ClaimID, c.Provider,
  {flag('p.n < 5')} AS IsNewProvider, {flag('b.n > 10')} AS IsFrequentClaimant,
  {ratio('c.DeductibleAmtPaid', f'CAST(c.{AMT} AS DOUBLE) + 1')} AS PatientPaymentRatio,
  {flag(f'CAST(c.{AMT} AS DOUBLE) > q.q90')} AS IsHighValueClaim,
  {flag('c.HospitalStayDays > 0 AND c.HospitalStayDays < 2')} AS IsShortStay,
  {flag('c.HospitalStayDays > 14')} AS IsLongStay, {flag('c.Age > 75')} AS IsElderly,
  CAST(c.IsDead AS INTEGER) AS DeathRelatedClaim, CAST(c.ChronicCond_KidneyDisease AS INTEGER) AS RenalDiseaseIndicator_Y
FROM cleaned c
LEFT JOIN (SELECT Provider, count({AMT}) AS n FROM cleaned GROUP BY Provider) p USING (Provider)
LEFT JOIN (SELECT BeneID, count({AMT}) AS n FROM cleaned WHERE BeneID IS NOT NULL GROUP BY BeneID) b USING (BeneID),
(SELECT quantile_cont(CAST({AMT} AS DOUBLE), 0.9) AS q90 FROM cleaned) q"""))
def q_fallback_features(spark, sf):
    cleaned = _cleaned(spark, sf)
    prov, pat = st.fallback_stats(cleaned)
    q90 = exact_quantiles([value_counts(cleaned, "amt", AMT)], {"q90": ("amt", 0.9)})["q90"]
    j = (cleaned.join(prov.select("Provider", "ProviderClaimCount"), "Provider", "left")
                .join(pat.select("BeneID", "PatientClaimCount"), "BeneID", "left"))
    c = F.col
    return j.select("ClaimID", "Provider", *fx.fallback_features(
        c(AMT), c("DeductibleAmtPaid"), c("HospitalStayDays"), c("Age"), c("IsDead"), c("ChronicCond_KidneyDisease"),
        c("ProviderClaimCount"), c("PatientClaimCount"), F.lit(q90).cast("double")))


_VEC_SQL = """CAST(claim_amount AS DOUBLE) AS v00, CAST(deductible_paid AS DOUBLE) AS v01, CAST(gender AS DOUBLE) AS v02,
  CAST(1.0 AS DOUBLE) AS v03, CAST(12.0 AS DOUBLE) AS v04, CAST(12.0 AS DOUBLE) AS v05, CAST(0.0 AS DOUBLE) AS v06, CAST(chronic_heartfailure AS DOUBLE) AS v07,
  CAST(chronic_kidney AS DOUBLE) AS v08, CAST(chronic_cancer AS DOUBLE) AS v09, CAST(0.0 AS DOUBLE) AS v10, CAST(0.0 AS DOUBLE) AS v11,
  CAST(chronic_diabetes AS DOUBLE) AS v12, CAST(0.0 AS DOUBLE) AS v13, CAST(0.0 AS DOUBLE) AS v14, CAST(0.0 AS DOUBLE) AS v15, CAST(0.0 AS DOUBLE) AS v16,
  CAST(claim_amount * 2 AS DOUBLE) AS v17, CAST(deductible_paid * 2 AS DOUBLE) AS v18, CAST(claim_amount AS DOUBLE) AS v19,
  CAST(deductible_paid AS DOUBLE) AS v20, CAST(patient_age AS DOUBLE) AS v21, CAST(0.0 AS DOUBLE) AS v22,
  CAST(hospital_stay_days AS DOUBLE) AS v23, CAST(greatest(hospital_stay_days, 1) AS DOUBLE) AS v24,
  CAST(5000.0 AS DOUBLE) AS v25, CAST(2000.0 AS DOUBLE) AS v26, CAST(50.0 AS DOUBLE) AS v27, CAST(claim_amount AS DOUBLE) / CAST(5000.0 AS DOUBLE) AS v28, CAST(0.0 AS DOUBLE) AS v29,
  CAST(patient_total_claims * 3000 AS DOUBLE) AS v30, CAST(patient_total_claims AS DOUBLE) AS v31,
  CAST(patient_total_claims > 10 AS DOUBLE) AS v32,
  CAST(deductible_paid AS DOUBLE) / CAST(greatest(claim_amount, 1) AS DOUBLE) AS v33,
  CAST(claim_amount > 10000 AS DOUBLE) AS v34, CAST(hospital_stay_days <= 1 AND claim_amount > 3000 AS DOUBLE) AS v35,
  CAST(hospital_stay_days > 14 AS DOUBLE) AS v36, CAST(patient_age >= 70 AS DOUBLE) AS v37, CAST(0.0 AS DOUBLE) AS v38,
  CAST(chronic_kidney AS DOUBLE) AS v39"""


@register("compact_feature_vector", with_views(["claims"], f"SELECT claim_id, {_VEC_SQL} FROM claims"))
def q_compact_feature_vector(spark, sf):
    from claimlens.functions.vectors import compact_feature_columns
    c = op.claims_table(spark, sf)
    return c.select("claim_id", *compact_feature_columns())


@register("live_indicators", with_views(["featured"], f"""SELECT ClaimID, Provider,
  coalesce(CAST({AMT} AS DOUBLE) / CAST(nullif(ProviderAvgClaim, 0) AS DOUBLE) > 3, false) AS high_vs_provider_avg,
  coalesce(PatientClaimCount > 20, false) AS frequent_patient,
  coalesce(PatientProviderCount > 5, false) AS provider_shopping,
  coalesce({AMT} > 75000, false) AS extreme_value,
  coalesce(FullYearCoverage = 1, false) AS reducer_full_coverage,
  coalesce(PatientTotalSpend > 100000, false) AS reducer_high_medical_need,
  coalesce(RaceRiskGroup = 1, false) AS reducer_low_risk_group,
  round(CASE WHEN CAST({AMT} AS DOUBLE) > -1 THEN ln(1 + CAST({AMT} AS DOUBLE)) END, {LOG_DIGITS}) AS claim_amount_log,
  CAST(PatientTotalSpend AS DOUBLE) / CAST(greatest(PatientClaimCount, 1) AS DOUBLE) AS patient_avg_claim,
  CAST(OPAnnualReimbursementAmt AS DOUBLE) / 12.0 AS op_monthly_avg
FROM featured"""))
def q_live_indicators(spark, sf):
    """The live page's risk indicators and reducers for every claim."""
    from claimlens.functions import rules
    f = _featured(spark, sf)
    c = F.col
    cols = rules.live_indicators(c(AMT), c("ProviderAvgClaim"), c("PatientClaimCount"), c("PatientProviderCount"),
                                 c("FullYearCoverage") == 1, c("PatientTotalSpend"), c("RaceRiskGroup"),
                                 c("OPAnnualReimbursementAmt"))
    out = f.select("ClaimID", "Provider", *cols)
    return out.withColumn("claim_amount_log", F.round("claim_amount_log", LOG_DIGITS))
