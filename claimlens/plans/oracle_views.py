"""DuckDB SQL for the claim-shaped views, used by the oracle check.

Each entry is one CTE; ``with_views(names, body)`` emits the CTEs a query needs
in dependency order. The SQL is an independent statement of the same semantics
as the Spark operators (it is the cross-engine check, not the implementation).
"""

from __future__ import annotations

from claimlens.config import CHRONIC_CONDITIONS, DEFAULT_SETTINGS, PROVIDER_PROFILES, RACE_RISK_MAP
from claimlens.sources.claim_views import CHRONIC_PRIMES

AMT = "InscClaimAmtReimbursed"


def round2_mean(s: str, n: str) -> str:
    """Exact HALF_UP round(s / n, 2) for a 2-decimal sum ``s`` and count ``n``."""
    return (f"CASE WHEN {n} > 0 THEN CAST(CAST(sign({s}) * ((abs(CAST(({s}) * 100 AS HUGEINT)) * 2 + {n}) "
            f"// (2 * {n})) AS DECIMAL(38,0)) * 0.01 AS DECIMAL(18,2)) END")


def std_exact(n: str, s1: str, s2: str) -> str:
    return (f"sqrt(CAST(CAST({n} AS DECIMAL(20,0)) * {s2} - {s1} * {s1} AS DOUBLE) "
            f"/ CAST(nullif({n} * ({n} - 1), 0) AS DOUBLE))")


def exact_avg(x: str) -> str:
    return f"CAST(sum({x}) AS DOUBLE) / CAST(nullif(count({x}), 0) AS DOUBLE)"


def race_group(x: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in RACE_RISK_MAP.items())
    return f"CAST(CASE CAST({x} AS INTEGER) {whens} ELSE 1 END AS DOUBLE)"


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


def ratio(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / CAST(nullif({den}, 0) AS DOUBLE))"


def _line_select(inpatient: bool) -> str:
    adm = ("CAST(o_orderdate AS DATE) AS AdmissionDt, CAST(l_shipdate AS DATE) AS DischargeDt,"
           if inpatient else "")
    return f"""SELECT CAST(l_orderkey AS VARCHAR) AS ClaimID, CAST(o_custkey AS VARCHAR) AS BeneID,
  CAST(l_suppkey AS VARCHAR) AS Provider,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS {AMT},
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(16,4)) AS DeductibleAmtPaid,
  {adm}
  CAST(o_orderdate AS DATE) AS ClaimStartDt, CAST(l_shipdate AS DATE) AS ClaimEndDt,
  'PHY' || CAST(l_partkey % 97 AS VARCHAR) AS AttendingPhysician,
  CASE WHEN l_linenumber % 2 = 0 THEN 'PHY' || CAST(l_suppkey % 97 AS VARCHAR) END AS OperatingPhysician,
  CASE WHEN l_linenumber % 3 = 0 THEN 'PHY' || CAST(l_partkey % 89 AS VARCHAR) END AS OtherPhysician,
  l_linenumber AS LineNo, {0 if inpatient else 1} AS ClaimSource
FROM lines_joined WHERE l_linestatus {'=' if inpatient else '<>'} 'F'"""


def _first(col: str) -> str:
    return f"min(CASE WHEN {col} IS NOT NULL THEN {{'s': ClaimSource, 'l': LineNo, 'v': {col}}} END).v"


def _beneficiary() -> str:
    chronic = ",\n  ".join(f"CAST((c_custkey // {p}) % 2 AS INTEGER) AS ChronicCond_{n}"
                           for n, p in zip(CHRONIC_CONDITIONS, CHRONIC_PRIMES))
    return f"""SELECT CAST(c_custkey AS VARCHAR) AS BeneID,
  make_date(CAST(1920 + c_custkey % 85 AS INTEGER), CAST(1 + c_custkey % 12 AS INTEGER), CAST(1 + c_custkey % 28 AS INTEGER)) AS DOB,
  CASE WHEN c_custkey % 50 = 0 THEN make_date(CAST(2015 + c_custkey % 8 AS INTEGER), CAST(1 + c_custkey % 12 AS INTEGER),
       CAST(1 + c_custkey % 28 AS INTEGER)) END AS DOD,
  CAST(1 + c_custkey % 2 AS INTEGER) AS Gender, CAST(c_custkey % 6 AS INTEGER) AS Race,
  CAST(c_nationkey AS INTEGER) AS State, CAST(c_custkey % 100 AS INTEGER) AS County,
  CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'Y' ELSE 'N' END AS RenalDiseaseIndicator,
  CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_custkey % 13 AS INTEGER) ELSE 12 END AS NoOfMonths_PartACov,
  CASE WHEN c_nationkey % 2 = 0 THEN CAST((c_custkey + 7) % 13 AS INTEGER) ELSE 12 END AS NoOfMonths_PartBCov,
  {chronic},
  CAST(CAST(abs(c_acctbal) AS DECIMAL(12,2)) * 3 AS DECIMAL(14,2)) AS IPAnnualReimbursementAmt,
  CAST(CAST(abs(c_acctbal) AS DECIMAL(12,2)) AS DECIMAL(14,2)) AS IPAnnualDeductibleAmt,
  CAST(CAST(abs(c_acctbal) AS DECIMAL(12,2)) * 2 AS DECIMAL(14,2)) AS OPAnnualReimbursementAmt,
  CAST(CAST(abs(c_acctbal) AS DECIMAL(12,2)) AS DECIMAL(14,2)) AS OPAnnualDeductibleAmt
FROM customer"""


CHRONIC_COLS = [f"ChronicCond_{n}" for n in CHRONIC_CONDITIONS]
TOTAL_CHRONIC = "CAST(" + " + ".join(f"coalesce({c}, 0)" for c in CHRONIC_COLS) + " AS INTEGER)"


def _heuristic(amount: str, stay: str, claims: str, age: str, chronic: str) -> str:
    return f"""CAST(least(0.10
      + CASE WHEN {amount} > 50000 THEN 0.40 WHEN {amount} > 20000 THEN 0.20 WHEN {amount} > 10000 THEN 0.10 ELSE 0.00 END
      + CASE WHEN {stay} <= 2 AND {amount} > 15000 THEN 0.30 ELSE 0.00 END
      + CASE WHEN {claims} > 20 THEN 0.20 WHEN {claims} > 10 THEN 0.10 ELSE 0.00 END
      + CASE WHEN {age} < 40 AND {amount} > 25000 THEN 0.20 ELSE 0.00 END
      + CASE WHEN {chronic} > 2 THEN 0.10 ELSE 0.00 END, 0.99) AS DECIMAL(5,4))"""


def tier_sql(p: str, tiers=(("Critical Risk", "0.95"), ("High Risk", "0.80"), ("Medium Risk", "0.60")),
             default: str = "Low Risk") -> str:
    whens = " ".join(f"WHEN {p} >= {t} THEN '{label}'" for label, t in tiers)
    return f"CASE {whens} ELSE '{default}' END"


CHRONIC4 = ("(CAST(chronic_diabetes AS INTEGER) + CAST(chronic_heartfailure AS INTEGER) "
            "+ CAST(chronic_cancer AS INTEGER) + CAST(chronic_kidney AS INTEGER))")

_settings_values = ", ".join(f"('{n}', '{v}', '{t}', '{d}')" for n, v, t, d in DEFAULT_SETTINGS)
_profile_values = ", ".join(f"('{p}', '{r}', {a}, {c})" for p, r, a, c in PROVIDER_PROFILES)

VIEWS: dict[str, tuple[list[str], str]] = {
    "lines_joined": ([], "SELECT l.*, o.o_custkey, o.o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"),
    "inpatient": (["lines_joined"], _line_select(True)),
    "outpatient": (["lines_joined"], _line_select(False)),
    "claim_lines": (["inpatient", "outpatient"], "SELECT * FROM inpatient UNION ALL BY NAME SELECT * FROM outpatient"),
    "rollup": (["claim_lines"], f"""SELECT ClaimID,
  CAST(coalesce(sum({AMT}), 0) AS DECIMAL(22,2)) AS {AMT},
  CAST(coalesce(sum(DeductibleAmtPaid), 0) AS DECIMAL(22,4)) AS DeductibleAmtPaid,
  {_first('Provider')} AS Provider, {_first('BeneID')} AS BeneID,
  min(AdmissionDt) AS AdmissionDt, max(DischargeDt) AS DischargeDt,
  min(ClaimStartDt) AS ClaimStartDt, max(ClaimEndDt) AS ClaimEndDt
FROM claim_lines GROUP BY ClaimID"""),
    "beneficiary": ([], _beneficiary()),
    "labels_v": ([], "SELECT CAST(s_suppkey AS VARCHAR) AS Provider, "
                     "CASE WHEN s_acctbal < 2000 THEN 'Yes' ELSE 'No' END AS PotentialFraud FROM supplier"),
    "merged": (["labels_v", "rollup", "beneficiary"],
               "SELECT * FROM labels_v LEFT JOIN rollup USING (Provider) LEFT JOIN beneficiary USING (BeneID)"),
    "cleaned": (["merged"], """SELECT * EXCLUDE (PotentialFraud, DOB, DOD, AdmissionDt, DischargeDt, ClaimStartDt, ClaimEndDt),
  CASE WHEN PotentialFraud IN ('Yes', 'Y') THEN 1 WHEN PotentialFraud IN ('No', 'N') THEN 0 END AS PotentialFraud,
  CAST(2023 - year(DOB) AS INTEGER) AS Age,
  CAST(DOD IS NOT NULL AS INTEGER) AS IsDead,
  CAST(date_diff('day', AdmissionDt, DischargeDt) AS INTEGER) AS HospitalStayDays,
  CAST(date_diff('day', ClaimStartDt, ClaimEndDt) AS INTEGER) AS ClaimDuration
FROM merged"""),
    "prov_stats": (["cleaned"], f"""SELECT Provider,
  count({AMT}) AS ProviderClaimCount,
  {round2_mean(f'sum({AMT})', f'count({AMT})')} AS ProviderAvgClaim,
  round({std_exact(f'count({AMT})', f'sum({AMT})', f'sum(CAST({AMT} AS DECIMAL(18,2)) * CAST({AMT} AS DECIMAL(18,2)))')}, 2) AS ProviderStdClaim,
  CAST(coalesce(sum({AMT}), 0) AS DECIMAL(22,2)) AS ProviderTotalClaims
FROM cleaned GROUP BY Provider"""),
    "pat_stats": (["cleaned"], f"""SELECT BeneID,
  count({AMT}) AS PatientClaimCount,
  CAST(coalesce(sum({AMT}), 0) AS DECIMAL(22,2)) AS PatientTotalSpend,
  {round2_mean(f'sum({AMT})', f'count({AMT})')} AS PatientAvgClaim,
  count(DISTINCT Provider) AS PatientProviderCount
FROM cleaned WHERE BeneID IS NOT NULL GROUP BY BeneID"""),
    "with_stats": (["cleaned", "prov_stats", "pat_stats"],
                   "SELECT * FROM cleaned LEFT JOIN prov_stats USING (Provider) LEFT JOIN pat_stats USING (BeneID)"),
    "quants": (["with_stats"], f"""SELECT
  quantile_cont(CAST({AMT} AS DOUBLE), 0.8) AS amt_q80,
  quantile_cont(CAST({AMT} AS DOUBLE), 0.9) AS amt_q90,
  quantile_cont(CAST({AMT} AS DOUBLE), 0.95) AS amt_q95,
  quantile_cont(CAST({AMT} AS DOUBLE), 0.99) AS amt_q99,
  quantile_cont(CAST(ProviderClaimCount AS DOUBLE), 0.9) AS provider_count_q90,
  quantile_cont(ProviderStdClaim, 0.9) AS provider_std_q90,
  quantile_cont(CAST(PatientClaimCount AS DOUBLE), 0.95) AS patient_count_q95
FROM with_stats"""),
    "featured": (["with_stats", "quants"], f"""SELECT w.*,
  {TOTAL_CHRONIC} AS TotalChronicConditions,
  {flag(TOTAL_CHRONIC + ' > 2')} AS HasMultipleConditions,
  {flag(TOTAL_CHRONIC + ' = 0')} AS NoChronicConditions,
  CAST(ChronicCond_Heartfailure AS INTEGER) AS HasHeartCondition,
  CAST(ChronicCond_Diabetes AS INTEGER) AS HasDiabetes,
  {flag('ProviderClaimCount > q.provider_count_q90')} AS IsHighVolumeProvider,
  {flag('ProviderStdClaim > q.provider_std_q90')} AS ProviderClaimStdHigh,
  {flag('PatientClaimCount > q.patient_count_q95')} AS IsFrequentPatient,
  {flag('PatientProviderCount > 3')} AS PatientProviderShopping,
  {ratio(AMT, 'CAST(ProviderAvgClaim AS DOUBLE) + 1')} AS ClaimVsProviderAvg,
  {flag(ratio(AMT, 'CAST(ProviderAvgClaim AS DOUBLE) + 1') + ' > 2.0')} AS IsHighVsProviderAvg,
  {ratio(AMT, TOTAL_CHRONIC + ' + 1')} AS CostPerCondition,
  {flag(f'{TOTAL_CHRONIC} <= 1 AND CAST({AMT} AS DOUBLE) > q.amt_q80')} AS HighCostLowComplexity,
  CASE WHEN CAST({AMT} AS DOUBLE) > -1 THEN ln(1 + CAST({AMT} AS DOUBLE)) END AS ClaimAmountLog,
  {flag(f'CAST({AMT} AS DOUBLE) > q.amt_q95')} AS IsHighValueClaim,
  {flag(f'CAST({AMT} AS DOUBLE) > q.amt_q99')} AS IsExtremeValueClaim,
  {ratio('DeductibleAmtPaid', f'CAST({AMT} AS DOUBLE) + 1')} AS DeductibleRatio,
  {flag('DeductibleAmtPaid = 0')} AS IsZeroDeductible,
  {flag(ratio('DeductibleAmtPaid', f'CAST({AMT} AS DOUBLE) + 1') + ' < 0.05')} AS IsLowDeductible,
  {flag(ratio('DeductibleAmtPaid', f'CAST({AMT} AS DOUBLE) + 1') + ' > 0.3')} AS IsHighDeductible,
  {flag('Age > 75')} AS IsElderly,
  {flag('Age > 85')} AS IsVeryElderly,
  {flag(f'Age < 35 AND {AMT} > 15000')} AS IsYoungHighCost,
  CASE WHEN Age > 0 AND Age <= 35 THEN 1.0 WHEN Age > 35 AND Age <= 65 THEN 2.0 WHEN Age > 65 AND Age <= 75 THEN 3.0
       WHEN Age > 75 AND Age <= 85 THEN 4.0 WHEN Age > 85 AND Age <= 100 THEN 5.0 END::DOUBLE AS AgeRiskGroup,
  {ratio('NoOfMonths_PartBCov', '12')} AS PartBCoverageRatio,
  {flag('NoOfMonths_PartACov = 12 AND NoOfMonths_PartBCov = 12')} AS FullYearCoverage,
  {ratio('IPAnnualReimbursementAmt', 'NoOfMonths_PartACov + 1')} AS IPMonthlyAvg,
  {ratio('OPAnnualReimbursementAmt', 'NoOfMonths_PartBCov + 1')} AS OPMonthlyAvg,
  coalesce({race_group('Race')}, 1.0) AS RaceRiskGroup,
  {flag('Gender = 1')} AS IsMale,
  CAST(NOT (RenalDiseaseIndicator IS NOT DISTINCT FROM 'N') AS INTEGER) AS HasRenalDisease
FROM with_stats w, quants q"""),
    "claims": (["rollup", "beneficiary"], f"""SELECT
  CASE WHEN try_cast(r.ClaimID AS BIGINT) % 3 = 0 THEN 'CLM_2024' || r.ClaimID
       WHEN try_cast(r.ClaimID AS BIGINT) % 3 = 1 THEN 'CLM2025' || r.ClaimID ELSE 'CLM' || r.ClaimID END AS claim_id,
  r.Provider AS provider_id, r.BeneID AS patient_id,
  CAST(r.{AMT} AS DECIMAL(12,2)) AS claim_amount,
  CAST(r.DeductibleAmtPaid AS DECIMAL(12,2)) AS deductible_paid,
  CAST(2023 - year(b.DOB) AS INTEGER) AS patient_age,
  coalesce(CAST(date_diff('day', r.AdmissionDt, r.DischargeDt) AS INTEGER), 0) AS hospital_stay_days,
  coalesce(CAST(date_diff('day', r.ClaimStartDt, r.ClaimEndDt) AS INTEGER), 1) AS claim_duration,
  coalesce(b.Gender, 1) AS gender,
  coalesce(b.ChronicCond_Alzheimer = 1, false) AS chronic_alzheimer,
  coalesce(b.ChronicCond_Heartfailure = 1, false) AS chronic_heartfailure,
  coalesce(b.ChronicCond_KidneyDisease = 1, false) AS chronic_kidney,
  coalesce(b.ChronicCond_Cancer = 1, false) AS chronic_cancer,
  coalesce(b.ChronicCond_Diabetes = 1, false) AS chronic_diabetes,
  'PENDING' AS claim_status,
  CAST(r.ClaimStartDt AS TIMESTAMP) + to_hours(CAST(try_cast(r.ClaimID AS BIGINT) % 24 AS INTEGER)) AS submission_date,
  CAST(r.ClaimStartDt AS TIMESTAMP) + to_hours(CAST(try_cast(r.ClaimID AS BIGINT) % 24 AS INTEGER)) AS updated_at,
  coalesce(CAST(p.pc AS INTEGER), 1) AS patient_total_claims,
  coalesce(CAST(p.pp AS INTEGER), 1) AS patient_provider_count,
  coalesce(CAST({race_group('b.Race')} AS INTEGER), 1) AS race_risk_group,
  CAST(coalesce(b.OPAnnualReimbursementAmt, 0) AS DECIMAL(12,2)) AS op_annual_amount
FROM rollup r LEFT JOIN beneficiary b ON r.BeneID = b.BeneID
LEFT JOIN (SELECT BeneID, count({AMT}) AS pc, count(DISTINCT Provider) AS pp FROM rollup
           WHERE BeneID IS NOT NULL GROUP BY BeneID) p ON r.BeneID = p.BeneID"""),
    "scored": (["claims"], f"""SELECT *, {_heuristic('claim_amount', 'hospital_stay_days', 'patient_total_claims',
                                                      'patient_age', CHRONIC4)} AS p, {CHRONIC4} AS chronic4
FROM claims"""),
    "predictions": (["scored"], f"""SELECT md5('pred:' || claim_id) AS prediction_id, claim_id,
  p AS fraud_probability, {tier_sql('p')} AS risk_level,
  CAST(floor(p * 100) AS INTEGER) AS risk_score,
  to_json({{'high_claim_amount': coalesce(claim_amount > 15000, false),
           'elderly_patient': coalesce(patient_age > 70, false),
           'short_stay_high_cost': coalesce(hospital_stay_days <= 2 AND claim_amount > 10000, false),
           'frequent_claimant': coalesce(patient_total_claims > 15, false),
           'multiple_chronic_conditions': coalesce(chronic4 > 1, false)}})::VARCHAR AS risk_factors,
  'v1.0' AS model_version, submission_date AS prediction_timestamp, false AS investigated
FROM scored"""),
    "inv_base": (["predictions"], """SELECT md5('inv:' || prediction_id) AS investigation_id, claim_id, prediction_id,
  CASE WHEN risk_level = 'Critical Risk' THEN 'CRITICAL' WHEN risk_level = 'High Risk' THEN 'HIGH' ELSE 'MEDIUM' END AS priority_level,
  prediction_timestamp AS created0,
  try_cast(regexp_extract(claim_id, '(\\d+)$', 1) AS BIGINT) AS k
FROM predictions
WHERE risk_level IN ('Critical Risk', 'High Risk', 'Medium Risk') AND fraud_probability >= 0.6"""),
    "investigations": (["inv_base"], """SELECT investigation_id, claim_id, prediction_id, priority_level,
  CASE WHEN k % 3 = 0 THEN 'OPEN' WHEN k % 3 = 1 THEN 'IN_PROGRESS' ELSE 'CLOSED' END AS status,
  CASE WHEN k % 3 <> 0 THEN 'INV' || CAST(k % 7 AS VARCHAR) END AS assigned_investigator,
  CAST(NULL AS VARCHAR) AS findings,
  CASE WHEN k % 3 = 2 THEN CASE WHEN k % 5 = 0 THEN 'FRAUD_CONFIRMED' WHEN k % 5 = 1 THEN 'FRAUD_DENIED'
                                WHEN k % 5 = 2 THEN 'INSUFFICIENT_EVIDENCE' END END AS investigation_outcome,
  CAST(0 AS DECIMAL(12,2)) AS amount_recovered,
  created0 + INTERVAL 1 DAY AS created_date,
  CASE WHEN k % 3 = 2 THEN created0 + INTERVAL 8 DAY END AS completion_date
FROM inv_base"""),
    "settings": ([], f"SELECT * FROM (VALUES {_settings_values}) t(setting_name, setting_value, setting_type, description)"),
    "profiles": ([], f"SELECT * FROM (VALUES {_profile_values}) t(provider_id, risk, base_avg, base_count)"),
}


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in VIEWS[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(names: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause holding ``names`` (and their dependencies), then ``body``.

    ``extra`` adds query-local CTEs (name, sql) after the shared ones."""
    parts = [f"{n} AS (\n{VIEWS[n][1]}\n)" for n in _order(names)]
    parts += [f"{n} AS (\n{sql}\n)" for n, sql in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" + body
