"""Engine configuration as frozen dataclasses.

Fixed values: the numbers below are the semantics of the claims-risk
application this engine reproduces (tiers, rule cut-offs, thresholds, model
presets, default settings). They are stated plainly, in natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
REFERENCE_YEAR = 2023

# (label, lower bound inclusive), highest first.
BATCH_TIERS = (("Critical Risk", 0.95), ("High Risk", 0.80), ("Medium Risk", 0.60))
BATCH_TIER_DEFAULT = "Low Risk"
LIVE_TIERS = (("High Risk", 0.80), ("Medium Risk", 0.20))
LIVE_TIER_DEFAULT = "Low Risk"
LIVE_TIER_CLASS = {"High Risk": "risk-high", "Medium Risk": "risk-medium", "Low Risk": "risk-low"}
POLICY_TIERS = (("Critical Risk", 0.90), ("High Risk", 0.70), ("Medium Risk", 0.50))
POLICY_TIER_DEFAULT = "Low Risk"
TIER_ORDER = ("Critical Risk", "High Risk", "Medium Risk", "Low Risk")

# Threshold policy table: (name, threshold, use case).
THRESHOLD_POLICIES = (
    ("Conservative (90%)", 0.9, "Immediate investigation"),
    ("Balanced (80%)", 0.8, "Standard workflow"),
    ("Aggressive (70%)", 0.7, "Enhanced review"),
    ("Surveillance (60%)", 0.6, "Monitoring only"),
)
BUSINESS_METRIC_THRESHOLDS = (0.5, 0.7, 0.8, 0.9)
MINUTES_PER_CASE = 30
RECOVERY_RATE = "0.6"
FLAG_THRESHOLD = 0.8

# Race code -> risk group; anything else -> 1.
RACE_RISK_MAP = {0: 1, 1: 1, 2: 1, 3: 2, 5: 1}

# Age bins (right-closed) -> group 1..5.
AGE_BINS = (0, 35, 65, 75, 85, 100)

CHRONIC_CONDITIONS = (
    "Alzheimer", "Heartfailure", "KidneyDisease", "Cancer", "ObstrPulmonary",
    "Depression", "Diabetes", "IschemicHeart", "Osteoporasis", "rheumatoidarthritis", "stroke",
)

PHYSICIAN_COLUMNS = ("AttendingPhysician", "OperatingPhysician", "OtherPhysician")

IDENTIFIER_COLUMNS = (
    "ClaimID", "BeneID", "Provider",
    "AttendingPhysician", "OperatingPhysician", "OtherPhysician",
    "ClmAdmitDiagnosisCode", "DiagnosisGroupCode",
    *[f"ClmDiagnosisCode_{i}" for i in range(1, 11)],
    *[f"ClmProcedureCode_{i}" for i in range(1, 7)],
    "State", "County",
)

LEAKY_COLUMNS = (
    "ProviderClaimCount", "ProviderStdClaim", "ProviderAvgClaim",
    "PatientClaimCount", "PatientTotalClaims", "ClaimVsProviderAvg", "DeductibleAmtPaid",
    "HospitalStayDays", "IsHighFraudRateProvider", "ProviderTotalClaims",
    "IsHighVolumeProvider", "ProviderClaimStdHigh",
)

# Feature-name categories, first match wins.
FEATURE_CATEGORIES = (
    ("custom", ("IsHighVsProviderAvg", "IsFrequentPatient", "PatientProviderShopping",
                "HighCostLowComplexity", "IsHighValueClaim", "IsExtremeValueClaim",
                "IsZeroDeductible", "IsLowDeductible", "IsHighDeductible")),
    ("financial", ("InscClaimAmtReimbursed", "DeductibleRatio", "CostPerCondition",
                   "PatientTotalSpend", "PatientAvgClaim")),
    ("time_age", ("ClaimDuration", "Age", "IsElderly", "IsVeryElderly")),
    ("medical", ("ChronicCond_", "TotalChronicConditions", "HasMultipleConditions")),
)
FEATURE_CATEGORY_DEFAULT = "other"
FORM_FEATURE_GROUPS = (
    ("Financial", ("InscClaimAmtReimbursed", "DeductibleAmtPaid", "IPAnnual", "OPAnnual")),
    ("Fraud Features", ("ProviderAvg", "ClaimVsProvider", "IsNew", "IsFrequent", "IsHigh", "IsShort")),
    ("Medical", ("Age", "HospitalStay", "Chronic")),
    ("Demographics", ("Gender", "Race", "NoOfMonths")),
)
REPORT_FEATURE_PATTERN = "ClaimVsProvider|IsNew|IsFrequent|Payment|IsHigh|IsShort|IsLong|IsElderly"

# Provider profiles: provider -> (risk, base average claim, base claim count).
PROVIDER_PROFILES = (
    ("PRV001", "low", 2800, 150),
    ("PRV002", "high", 25000, 45),
    ("PRV003", "medium", 4500, 80),
    ("PRV004", "low", 3200, 120),
    ("PRV005", "high", 18500, 35),
    ("PRV006", "medium", 6200, 90),
    ("PRV007", "critical", 35000, 25),
    ("PRV008", "suspicious", 8500, 200),
)
PROVIDER_RISK_POINTS = {"critical": 4, "suspicious": 3, "high": 2, "medium": 1, "low": 0}

# Default system settings: (name, value, type, description).
DEFAULT_SETTINGS = (
    ("fraud_threshold_conservative", "0.90", "DECIMAL", "Conservative fraud detection threshold (90%)"),
    ("fraud_threshold_balanced", "0.80", "DECIMAL", "Balanced fraud detection threshold (80%)"),
    ("fraud_threshold_aggressive", "0.70", "DECIMAL", "Aggressive fraud detection threshold (70%)"),
    ("max_investigation_capacity", "100", "INTEGER", "Maximum number of investigations per day"),
    ("auto_investigation_threshold", "0.95", "DECIMAL", "Auto-create investigation above this threshold"),
)

# Claims table column defaults applied on append.
CLAIM_DEFAULTS = {
    "deductible_paid": 0, "hospital_stay_days": 0, "claim_duration": 1, "gender": 1,
    "chronic_alzheimer": False, "chronic_heartfailure": False, "chronic_kidney": False,
    "chronic_cancer": False, "chronic_diabetes": False, "claim_status": "PENDING",
    "patient_total_claims": 1, "patient_provider_count": 1, "race_risk_group": 1,
    "op_annual_amount": 0,
}

# Boosted-tree presets (XGBoost names; mapped onto MLlib in operators.ml).
MODEL_PRESETS = {
    "optimized": dict(n_estimators=200, max_depth=10, learning_rate=0.2, subsample=0.9,
                      colsample_bytree=0.9, reg_alpha=0.5, reg_lambda=2.0, min_child_weight=5,
                      gamma=2.0, random_state=42),
    "conservative": dict(n_estimators=50, max_depth=4, learning_rate=0.1, subsample=0.8,
                         colsample_bytree=0.8, reg_alpha=1.0, reg_lambda=5.0, min_child_weight=5,
                         gamma=2.0, random_state=42),
    "very_conservative": dict(n_estimators=30, max_depth=3, learning_rate=0.05, subsample=0.7,
                              colsample_bytree=0.7, reg_alpha=2.0, reg_lambda=10.0, random_state=42),
    "balanced": dict(n_estimators=100, max_depth=6, learning_rate=0.15, subsample=0.8,
                     colsample_bytree=0.8, reg_alpha=0.5, reg_lambda=2.0, random_state=42),
}
COARSE_GRID = dict(n_estimators=(100, 200, 300), max_depth=(4, 6, 8, 10), learning_rate=(0.05, 0.1, 0.2))
COARSE_GRID_MAX_TRIALS = 31
OVERFIT_SIGNIFICANT_GAP = 0.02
OVERFIT_MODERATE_GAP = 0.01
DOMINANT_FEATURE_THRESHOLD = 0.5
CUSTOM_SHARE_BANDS = (30, 15)
PROVIDER_IMPORTANCE_THRESHOLD = 0.3
PATIENT_IMPORTANCE_THRESHOLD = 0.3
RECALL_MINIMUM = 0.65
RECALL_STRETCH = 0.75
BALANCE_BAND = (0.05, 0.95)
SEED = 42
# --- end fixed values -------------------------------------------------------


@dataclass(frozen=True)
class EngineConfig:
    reference_year: int = REFERENCE_YEAR
    seed: int = SEED
    # Quantiles: exact and distributed by default (parity); set an accuracy to use
    # ``percentile_approx`` at very large scale.
    quantile_accuracy: int | None = None
    extra: dict = field(default_factory=dict)


DEFAULT_CONFIG = EngineConfig()
