"""Scoring rules, tiers and display projections (R1-R8, P28-P32) as Column builders.

Rule probabilities are formed from decimal literals so that a cut such as
0.1 + 0.4 + 0.3 lands exactly on 0.80 (a double sum gives 0.7999999999999999
and would fall into the lower tier; the original float code has that wobble).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlens.config import (BATCH_TIER_DEFAULT, BATCH_TIERS, FEATURE_CATEGORIES, FEATURE_CATEGORY_DEFAULT,
                              LIVE_TIER_CLASS, LIVE_TIER_DEFAULT, LIVE_TIERS, POLICY_TIER_DEFAULT, POLICY_TIERS,
                              PROVIDER_RISK_POINTS, TIER_ORDER)


def _d(x: str) -> Column:
    return F.lit(Decimal(x))


def _when_chain(pairs, default: Column) -> Column:
    expr = None
    for cond, value in pairs:
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return default if expr is None else expr.otherwise(default)


# R1 / R2 / R3
def risk_tier(p: Column, tiers=BATCH_TIERS, default: str = BATCH_TIER_DEFAULT) -> Column:
    return _when_chain([(p >= _d(str(t)), F.lit(label)) for label, t in tiers], F.lit(default))


def risk_tier_live(p: Column) -> Column:
    return risk_tier(p, LIVE_TIERS, LIVE_TIER_DEFAULT)


def risk_tier_class(level: Column) -> Column:
    return _when_chain([(level == F.lit(k), F.lit(v)) for k, v in LIVE_TIER_CLASS.items()], F.lit(None).cast("string"))


def risk_tier_policy(p: Column) -> Column:
    return risk_tier(p, POLICY_TIERS, POLICY_TIER_DEFAULT)


def tier_ordinal(level: Column, order=TIER_ORDER) -> Column:
    """Critical=1 < High=2 < Medium=3 < anything else=4."""
    return _when_chain([(level == F.lit(v), F.lit(i + 1)) for i, v in enumerate(order[:-1])], F.lit(len(order)))


# R4
def heuristic_probability(amount: Column, stay_days: Column, patient_claims: Column, age: Column,
                          chronic_count: Column) -> Column:
    zero = _d("0.00")
    score = (_d("0.10")
             + _when_chain([(amount > 50000, _d("0.40")), (amount > 20000, _d("0.20")), (amount > 10000, _d("0.10"))], zero)
             + _when_chain([((stay_days <= 2) & (amount > 15000), _d("0.30"))], zero)
             + _when_chain([(patient_claims > 20, _d("0.20")), (patient_claims > 10, _d("0.10"))], zero)
             + _when_chain([((age < 40) & (amount > 25000), _d("0.20"))], zero)
             + _when_chain([(chronic_count > 2, _d("0.10"))], zero))
    return F.least(score, _d("0.99")).cast("decimal(5,4)")


# R5
def expected_risk_level(amount: Column, provider_risk: Column, total_claims: Column, provider_count: Column,
                        stay_days: Column, age: Column) -> Column:
    risk_points = F.create_map(*[x for k, v in PROVIDER_RISK_POINTS.items() for x in (F.lit(k), F.lit(v))])
    score = (_when_chain([(amount > 100000, F.lit(4)), (amount > 50000, F.lit(3)), (amount > 20000, F.lit(2))], F.lit(0))
             + F.coalesce(F.element_at(risk_points, provider_risk), F.lit(0))
             + _when_chain([(total_claims > 50, F.lit(4)), (total_claims > 20, F.lit(2))], F.lit(0))
             + _when_chain([(provider_count > 8, F.lit(3)), (provider_count > 5, F.lit(2))], F.lit(0))
             + _when_chain([((stay_days <= 2) & (amount > 15000), F.lit(2))], F.lit(0))
             + _when_chain([((age < 40) & (amount > 25000), F.lit(2))], F.lit(0)))
    return _when_chain([(score >= 10, F.lit("Critical Risk")), (score >= 6, F.lit("High Risk")),
                        (score >= 3, F.lit("Medium Risk"))], F.lit("Low Risk"))


def _b(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# R6
def risk_factors_batch(amount, age, stay_days, patient_claims, chronic_count) -> Column:
    return F.struct(_b(amount > 15000).alias("high_claim_amount"),
                    _b(age > 70).alias("elderly_patient"),
                    _b((stay_days <= 2) & (amount > 10000)).alias("short_stay_high_cost"),
                    _b(patient_claims > 15).alias("frequent_claimant"),
                    _b(chronic_count > 1).alias("multiple_chronic_conditions"))


def risk_factors_live(amount, age, stay_days, patient_claims, chronic_count) -> Column:
    return F.struct(_b(amount > 25000).alias("high_claim_amount"),
                    _b(age > 75).alias("elderly_patient"),
                    _b((stay_days < 2) & (amount > 20000)).alias("short_stay_high_cost"),
                    _b(patient_claims > 10).alias("frequent_claimant"),
                    _b(chronic_count > 2).alias("chronic_conditions"))


# R7
def live_indicators(amount, provider_avg, patient_claims, patient_providers, full_coverage, total_spend,
                    race_group, op_annual) -> list[Column]:
    vs = F.try_divide(amount.cast("double"), provider_avg.cast("double"))
    return [
        _b(vs > 3).alias("high_vs_provider_avg"),
        _b(patient_claims > 20).alias("frequent_patient"),
        _b(patient_providers > 5).alias("provider_shopping"),
        _b(amount > 75000).alias("extreme_value"),
        _b(full_coverage).alias("reducer_full_coverage"),
        _b(total_spend > 100000).alias("reducer_high_medical_need"),
        _b(race_group == 1).alias("reducer_low_risk_group"),
        F.log1p(amount.cast("double")).alias("claim_amount_log"),
        F.try_divide(total_spend.cast("double"), F.greatest(patient_claims, F.lit(1)).cast("double"))
         .alias("patient_avg_claim"),
        F.try_divide(op_annual.cast("double"), F.lit(12.0)).alias("op_monthly_avg"),
    ]


# R8
def risk_explanations(p, amount, patient_claims, stay_days, age, patient_providers, chronic_count,
                      high_cut: float = 0.8, medium_cut: float = 0.21) -> Column:
    def msg(cond, text):
        return F.when(_b(cond), F.lit(text))
    high = F.array_compact(F.array(
        msg(amount > 50000, "Very high claim amount"),
        msg(patient_claims > 15, "Frequent claimant pattern"),
        msg((stay_days < 2) & (amount > 20000), "Short stay with expensive treatment")))
    medium = F.array_compact(F.array(
        msg(amount > 25000, "Above-average claim amount"),
        msg((age < 30) & (amount > 30000), "Young patient with high claim"),
        msg(patient_providers > 5, "Multiple providers used by patient"),
        msg((stay_days < 2) & (amount > 20000), "Short hospital stay with high cost"),
        msg(patient_claims > 5, "Multiple previous claims")))
    low = F.array_compact(F.array(
        F.lit("Normal claim amount range"), F.lit("Reasonable patient history"),
        msg(chronic_count > 0, "Medical conditions justify costs")))
    return F.when(p >= _d(str(high_cut)), high).when(p >= _d(str(medium_cut)), medium).otherwise(low)


# P28
def claim_id_provenance(claim_id: Column) -> tuple[Column, Column]:
    return (_b(claim_id.contains("CLM_202")).alias("is_manual"), _b(claim_id.contains("CLM202")).alias("is_seeded"))


# P29
ROW_COLORS = (("Critical Risk", "#dc3545"), ("High Risk", "#fd7e14"), ("Medium Risk", "#ffc107"))
ROW_COLOR_DEFAULT = "#28a745"


def display_amount(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount.cast("decimal(18,2)"), 2))


def display_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def row_color(level: Column) -> Column:
    return _when_chain([(level == F.lit(k), F.lit(v)) for k, v in ROW_COLORS], F.lit(ROW_COLOR_DEFAULT))


# P30
def typed_value(value: Column, setting_type: Column) -> list[Column]:
    return [
        F.when(setting_type == "DECIMAL", value.try_cast("double")).alias("decimal_value"),
        F.when(setting_type == "INTEGER", value.try_cast("int")).alias("integer_value"),
        F.when(setting_type == "BOOLEAN", F.lower(value).isin("true", "1", "yes")).alias("boolean_value"),
        F.when(~setting_type.isin("DECIMAL", "INTEGER", "BOOLEAN") | setting_type.isNull(), value).alias("string_value"),
    ]


# P31
def risk_priority(level: Column) -> Column:
    return _when_chain([(level == "Critical Risk", F.lit("CRITICAL")), (level == "High Risk", F.lit("HIGH"))],
                       F.lit("MEDIUM"))


def priority_ordinal(priority: Column) -> Column:
    return _when_chain([(priority == "CRITICAL", F.lit(1)), (priority == "HIGH", F.lit(2)),
                        (priority == "MEDIUM", F.lit(3))], F.lit(4))


# P32
def feature_category(name: Column, categories=FEATURE_CATEGORIES, default: str = FEATURE_CATEGORY_DEFAULT) -> Column:
    pairs = []
    for cat, needles in categories:
        cond = None
        for n in needles:
            c = name.contains(n)
            cond = c if cond is None else (cond | c)
        pairs.append((cond, F.lit(cat)))
    return _when_chain(pairs, F.lit(default))
