"""Claim risk features as pure Column builders.

Each builder is a JVM-side expression (no Python UDF), so a whole feature
projection stays inside one whole-stage-codegen span. Column lists that depend
on the input schema (chronic conditions, physicians) are discovered on the
driver from ``df.columns`` before the plan is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.config import (AGE_BINS, IDENTIFIER_COLUMNS, LEAKY_COLUMNS, PHYSICIAN_COLUMNS,
                              RACE_RISK_MAP, REFERENCE_YEAR)
from claimlens.functions.exact import as_double, flag, ratio

AMT = "InscClaimAmtReimbursed"
DED = "DeductibleAmtPaid"


# P1
def label_to_int(label: Column) -> Column:
    """Yes/Y -> 1, No/N -> 0, anything else -> NULL."""
    return (F.when(label.isin("Yes", "Y"), F.lit(1))
             .when(label.isin("No", "N"), F.lit(0))
             .otherwise(F.lit(None).cast("int")))


def parse_date(df: DataFrame, name: str) -> Column:
    """Column as DATE; strings are parsed leniently (bad value -> NULL)."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.DateType):
        return F.col(name)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(name)
    return F.to_date(F.try_to_timestamp(F.col(name).cast("string")))


# P2
def age_from_dob(dob: Column, year: int = REFERENCE_YEAR) -> Column:
    return (F.lit(year) - F.year(dob)).cast("int")


# P3
def is_dead(dod: Column | None) -> Column:
    return F.lit(0) if dod is None else dod.isNotNull().cast("int")


# P4 / P5
def day_diff(end: Column, start: Column) -> Column:
    return F.date_diff(end, start)


# P6
def chronic_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "ChronicCond_" in c]


def chronic_profile(df: DataFrame) -> list[Column]:
    cols = chronic_columns(df)
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in cols]) if cols else F.lit(0)
    total = total.cast("int")
    heart = F.col("ChronicCond_Heartfailure") if "ChronicCond_Heartfailure" in df.columns else F.lit(0)
    diab = F.col("ChronicCond_Diabetes") if "ChronicCond_Diabetes" in df.columns else F.lit(0)
    return [
        total.alias("TotalChronicConditions"),
        flag(total > 2).alias("HasMultipleConditions"),
        flag(total == 0).alias("NoChronicConditions"),
        heart.cast("int").alias("HasHeartCondition"),
        diab.cast("int").alias("HasDiabetes"),
    ]


# P7
def claim_vs_provider(amt: Column, provider_avg: Column) -> tuple[Column, Column]:
    r = ratio(amt, as_double(provider_avg) + 1)
    return r.alias("ClaimVsProviderAvg"), flag(r > 2.0).alias("IsHighVsProviderAvg")


# P8
def cost_complexity(amt: Column, total_chronic: Column, q80: Column) -> tuple[Column, Column]:
    return (ratio(amt, total_chronic + 1).alias("CostPerCondition"),
            flag((total_chronic <= 1) & (as_double(amt) > q80)).alias("HighCostLowComplexity"))


# P9
def claim_amount_log(amt: Column) -> Column:
    return F.log1p(as_double(amt)).alias("ClaimAmountLog")


# P10
def value_flags(amt: Column, q95: Column, q99: Column) -> tuple[Column, Column]:
    return (flag(as_double(amt) > q95).alias("IsHighValueClaim"),
            flag(as_double(amt) > q99).alias("IsExtremeValueClaim"))


# P11
def deductible_flags(ded: Column, amt: Column) -> list[Column]:
    r = ratio(ded, as_double(amt) + 1)
    return [r.alias("DeductibleRatio"),
            flag(ded == 0).alias("IsZeroDeductible"),
            flag(r < 0.05).alias("IsLowDeductible"),
            flag(r > 0.3).alias("IsHighDeductible")]


# P12
def age_flags(age: Column, amt: Column) -> list[Column]:
    return [flag(age > 75).alias("IsElderly"),
            flag(age > 85).alias("IsVeryElderly"),
            flag((age < 35) & (amt > 15000)).alias("IsYoungHighCost")]


# P13
def age_risk_group(age: Column) -> Column:
    """Right-closed bins (0,35],(35,65],(65,75],(75,85],(85,100] -> 1..5, else NULL."""
    expr = None
    for i in range(1, len(AGE_BINS)):
        cond = (age > AGE_BINS[i - 1]) & (age <= AGE_BINS[i])
        expr = F.when(cond, F.lit(float(i))) if expr is None else expr.when(cond, F.lit(float(i)))
    return expr.otherwise(F.lit(None).cast("double")).alias("AgeRiskGroup")


# P14
def coverage_features(part_a: Column, part_b: Column, ip_annual: Column, op_annual: Column) -> list[Column]:
    return [ratio(part_b, F.lit(12)).alias("PartBCoverageRatio"),
            flag((part_a == 12) & (part_b == 12)).alias("FullYearCoverage"),
            ratio(ip_annual, part_a + 1).alias("IPMonthlyAvg"),
            ratio(op_annual, part_b + 1).alias("OPMonthlyAvg")]


# P15
def multi_physician(df: DataFrame) -> Column | None:
    cols = [c for c in PHYSICIAN_COLUMNS if c in df.columns]
    if not cols:
        return None
    distinct = F.array_distinct(F.array_compact(F.array(*[F.col(c) for c in cols])))
    return flag(F.size(distinct) > 1).alias("HasMultiplePhysicians")


# P16
def race_risk_group(race: Column) -> Column:
    m = F.create_map(*[x for k, v in RACE_RISK_MAP.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, race.cast("int")), F.lit(1)).cast("double").alias("RaceRiskGroup")


# P17
def is_male(gender: Column) -> Column:
    return flag(gender == 1).alias("IsMale")


# P18
def has_renal_disease(indicator: Column) -> Column:
    """indicator != 'N', with a missing value counting as 1 (as a NaN compare does)."""
    return (~indicator.eqNullSafe(F.lit("N"))).cast("int").alias("HasRenalDisease")


# P19
def provider_flags(count: Column, std: Column, q_count: Column, q_std: Column) -> list[Column]:
    return [flag(count > q_count).alias("IsHighVolumeProvider"),
            flag(std > q_std).alias("ProviderClaimStdHigh")]


# P20
def patient_flags(pcount: Column, pproviders: Column, q_pcount: Column) -> list[Column]:
    return [flag(pcount > q_pcount).alias("IsFrequentPatient"),
            flag(pproviders > 3).alias("PatientProviderShopping")]


# P21
def drop_identifiers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in IDENTIFIER_COLUMNS if c in df.columns])


# P22
def drop_leaky(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*[c for c in (*LEAKY_COLUMNS, *extra) if c in df.columns])


# P23
def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def fill_numeric_zero(df: DataFrame) -> DataFrame:
    fields = df.schema.fields  # one schema round trip, not one per column
    return df.select(*[F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name)
                       if isinstance(f.dataType, T.NumericType) else F.col(f.name) for f in fields])


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


# P26 (simplified feature set over group statistics)
def fallback_features(amt: Column, ded: Column, stay: Column, age: Column, dead: Column, kidney: Column,
                      provider_count: Column, patient_count: Column, q90: Column) -> list[Column]:
    return [
        flag(provider_count < 5).alias("IsNewProvider"),
        flag(patient_count > 10).alias("IsFrequentClaimant"),
        ratio(ded, as_double(amt) + 1).alias("PatientPaymentRatio"),
        flag(as_double(amt) > q90).alias("IsHighValueClaim"),
        flag((stay > 0) & (stay < 2)).alias("IsShortStay"),
        flag(stay > 14).alias("IsLongStay"),
        flag(age > 75).alias("IsElderly"),
        dead.cast("int").alias("DeathRelatedClaim"),
        kidney.cast("int").alias("RenalDiseaseIndicator_Y"),
    ]
