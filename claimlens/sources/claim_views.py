"""Claim-shaped views over the driver's TPC-H-like tables.

The claims application reads inpatient/outpatient claim lines, a beneficiary
table and a per-provider label table. The driver ships TPC-H-shaped tables, so
this module maps them onto that data model (mapping documented in FIXTURES.md
section 3). Each builder is a lazy DataFrame with only the needed columns read.

Operational tables (claims, fraud_predictions, investigations) are derived from
the same data so that the dashboard queries scale with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.config import CHRONIC_CONDITIONS
from claimlens.sources.tables import read_table

AMT = "InscClaimAmtReimbursed"
DED = "DeductibleAmtPaid"

# Fixture parameters: the prime used to derive each chronic-condition flag.
CHRONIC_PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31)


def _lines_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        "l_discount", "l_linestatus", "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")


def _line_columns(inpatient: bool, claim_id: Column | None = None, stays: Column | None = None) -> list[Column]:
    """Claim-line columns; ``stays`` limits the admission dates to the rows where it holds."""
    amt = F.col("l_extendedprice").cast("decimal(12,2)")
    cols = [
        (F.col("l_orderkey").cast("string") if claim_id is None else claim_id).alias("ClaimID"),
        F.col("o_custkey").cast("string").alias("BeneID"),
        F.col("l_suppkey").cast("string").alias("Provider"),
        amt.alias(AMT),
        (amt * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(16,4)").alias(DED),
    ]
    if inpatient:
        admitted, discharged = F.to_date("o_orderdate"), F.to_date("l_shipdate")
        if stays is not None:
            admitted, discharged = F.when(stays, admitted), F.when(stays, discharged)
        cols += [admitted.alias("AdmissionDt"), discharged.alias("DischargeDt")]
    cols += [
        F.to_date("o_orderdate").alias("ClaimStartDt"),
        F.to_date("l_shipdate").alias("ClaimEndDt"),
        F.concat(F.lit("PHY"), (F.col("l_partkey") % 97).cast("string")).alias("AttendingPhysician"),
        F.when(F.col("l_linenumber") % 2 == 0,
               F.concat(F.lit("PHY"), (F.col("l_suppkey") % 97).cast("string"))).alias("OperatingPhysician"),
        F.when(F.col("l_linenumber") % 3 == 0,
               F.concat(F.lit("PHY"), (F.col("l_partkey") % 89).cast("string"))).alias("OtherPhysician"),
        F.col("l_linenumber").alias("LineNo"),
    ]
    return cols


def inpatient_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inpatient claim lines: lines with status F; carry admission/discharge dates."""
    j = _lines_joined(spark, sf_dir).where(F.col("l_linestatus") == "F")
    return j.select(*_line_columns(True), F.lit(0).alias("ClaimSource"))


def outpatient_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outpatient claim lines: no admission/discharge columns."""
    j = _lines_joined(spark, sf_dir).where(F.col("l_linestatus") != "F")
    return j.select(*_line_columns(False), F.lit(1).alias("ClaimSource"))


def claim_lines(spark: SparkSession, sf_dir: str, integer_key: bool = False) -> DataFrame:
    """All claim lines in one scan and one join: the rows of the inpatient and outpatient views stacked.

    With ``integer_key`` the claim id stays the integer that the orders join is dealt by, so a
    later aggregate on it needs no further exchange."""
    j = _lines_joined(spark, sf_dir).where(F.col("l_linestatus").isNotNull())
    stays = F.col("l_linestatus") == "F"
    key = F.col("l_orderkey") if integer_key else None
    return j.select(*_line_columns(True, key, stays), F.when(stays, 0).otherwise(1).alias("ClaimSource"))


def beneficiary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")

    def dob_like(base: int) -> Column:
        return F.make_date((F.lit(base) + k % 85).cast("int"), (1 + k % 12).cast("int"), (1 + k % 28).cast("int"))

    even_nation = F.col("c_nationkey") % 2 == 0
    annual = F.abs(F.col("c_acctbal")).cast("decimal(12,2)")
    cols = [
        k.cast("string").alias("BeneID"),
        dob_like(1920).alias("DOB"),
        F.when(k % 50 == 0, F.make_date((2015 + k % 8).cast("int"), (1 + k % 12).cast("int"),
                                        (1 + k % 28).cast("int"))).alias("DOD"),
        (1 + k % 2).cast("int").alias("Gender"),
        (k % 6).cast("int").alias("Race"),
        F.col("c_nationkey").cast("int").alias("State"),
        (k % 100).cast("int").alias("County"),
        F.when(k % 97 == 0, F.lit(None).cast("string"))
         .when(F.col("c_mktsegment") == "MACHINERY", F.lit("Y")).otherwise(F.lit("N")).alias("RenalDiseaseIndicator"),
        F.when(even_nation, (k % 13).cast("int")).otherwise(F.lit(12)).alias("NoOfMonths_PartACov"),
        F.when(even_nation, ((k + 7) % 13).cast("int")).otherwise(F.lit(12)).alias("NoOfMonths_PartBCov"),
    ]
    cols += [(F.floor(k / p) % 2).cast("int").alias(f"ChronicCond_{name}")
             for name, p in zip(CHRONIC_CONDITIONS, CHRONIC_PRIMES)]
    cols += [
        (annual * 3).cast("decimal(14,2)").alias("IPAnnualReimbursementAmt"),
        annual.cast("decimal(14,2)").alias("IPAnnualDeductibleAmt"),
        (annual * 2).cast("decimal(14,2)").alias("OPAnnualReimbursementAmt"),
        annual.cast("decimal(14,2)").alias("OPAnnualDeductibleAmt"),
    ]
    return c.select(*cols)


def provider_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return s.select(
        F.col("s_suppkey").cast("string").alias("Provider"),
        F.when(F.col("s_acctbal") < 2000, F.lit("Yes")).otherwise(F.lit("No")).alias("PotentialFraud"),
    )


def provider_profile_key(provider: Column) -> Column:
    """Fixture mapping of a provider id onto one of the eight provider profiles."""
    return F.concat(F.lit("PRV00"), ((provider.try_cast("bigint") % 8) + 1).cast("string"))
