"""Dashboard queries over the operational tables.

Means of decimals are ``cast(sum as double) / count``: the sum is exact, so the
result does not depend on how rows were split across tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions import rules
from claimlens.functions.exact import MONEY_SUM


def exact_avg(col: Column) -> Column:
    return F.try_divide(F.sum(col).cast("double"), F.count(col).cast("double"))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("_k", F.lit(1))


# A6
def dashboard_metrics(claims: DataFrame, predictions: DataFrame, investigations: DataFrame) -> DataFrame:
    lvl = F.col("risk_level")
    a = _one(claims.agg(F.count(F.lit(1)).alias("total_claims")))
    b = _one(predictions.agg(count_if(lvl == "Critical Risk").alias("critical_cases"),
                             count_if(lvl == "High Risk").alias("high_risk_cases"),
                             count_if(lvl == "Medium Risk").alias("medium_risk_cases")))
    c = _one(investigations.agg(count_if(F.col("status") == "OPEN").alias("open_investigations")))
    return a.join(b, "_k").join(c, "_k").drop("_k")


# A7
def predictions_summary(predictions: DataFrame) -> DataFrame:
    p = F.col("fraud_probability")
    return (predictions.groupBy("risk_level")
            .agg(F.count(F.lit(1)).alias("count"), F.coalesce(exact_avg(p), F.lit(0.0)).alias("avg_probability")))


# A8
def seed_summary(claims: DataFrame, predictions: DataFrame, investigations: DataFrame) -> DataFrame:
    amt = F.col("claim_amount")
    a = _one(claims.agg(F.count(F.lit(1)).alias("total_claims"), exact_avg(amt).alias("avg_amount"),
                        F.max(amt).alias("max_amount"), F.min(amt).alias("min_amount")))
    per_level = (predictions.groupBy("risk_level")
                 .agg(F.count(F.lit(1)).alias("count"), exact_avg(F.col("fraud_probability")).alias("avg_prob"))
                 .withColumn("risk_order", rules.tier_ordinal(F.col("risk_level"))))
    c = _one(investigations.agg(count_if(F.col("status") == "OPEN").alias("open_investigations")))
    return _one(per_level).join(a, "_k").join(c, "_k").drop("_k")


# J6
def claims_with_predictions(claims: DataFrame, predictions: DataFrame) -> DataFrame:
    p = predictions.select("claim_id", "risk_level", "fraud_probability")
    return (claims.join(p, "claim_id", "left")
            .select("claim_id", "claim_amount", "submission_date",
                    F.coalesce(F.col("risk_level"), F.lit("Not Analyzed")).alias("risk_level"),
                    F.coalesce(F.col("fraud_probability"), F.lit(0).cast("decimal(5,4)")).alias("fraud_probability")))


# J7
def investigations_join(investigations: DataFrame, claims: DataFrame, predictions: DataFrame) -> DataFrame:
    i = investigations.select("investigation_id", "claim_id", "prediction_id", "priority_level", "status",
                              "assigned_investigator", "created_date")
    c = claims.select("claim_id", "claim_amount")
    fp = predictions.select("prediction_id", "fraud_probability", "risk_level")
    return i.join(c, "claim_id", "inner").join(fp, "prediction_id", "left")


# J8
def claims_pred_inv(claims: DataFrame, predictions: DataFrame, investigations: DataFrame) -> DataFrame:
    fp = predictions.select("claim_id", "risk_level", "fraud_probability")
    i = investigations.select("claim_id", "investigation_outcome")
    return claims.join(fp, "claim_id", "left").join(i, "claim_id", "left")


# A9
def provider_statistics(claims: DataFrame, predictions: DataFrame, investigations: DataFrame,
                        dedupe: bool = False) -> DataFrame:
    """Per-provider claims, money, high-risk and confirmed counts.

    Like the SQL view, joined rows are counted: a claim with several predictions
    or investigations counts several times. ``dedupe=True`` counts each claim once.
    """
    j = claims_pred_inv(claims, predictions, investigations)
    if dedupe:
        j = (j.groupBy("claim_id", "provider_id", "claim_amount")
              .agg(F.max(F.col("risk_level").isin("Critical Risk", "High Risk")).alias("hi"),
                   F.max(F.col("fraud_probability")).alias("fraud_probability"),
                   F.max(F.col("investigation_outcome") == "FRAUD_CONFIRMED").alias("conf"))
              .select("provider_id", "claim_amount", "fraud_probability",
                      F.when(F.col("hi"), "High Risk").alias("risk_level"),
                      F.when(F.col("conf"), "FRAUD_CONFIRMED").alias("investigation_outcome")))
    amt = F.col("claim_amount")
    return (j.groupBy("provider_id")
            .agg(F.count(F.lit(1)).alias("total_claims"),
                 exact_avg(amt).alias("avg_claim_amount"),
                 F.sum(amt).cast(MONEY_SUM).alias("total_claim_amount"),
                 count_if(F.col("risk_level").isin("Critical Risk", "High Risk")).alias("critical_cases"),
                 exact_avg(F.col("fraud_probability")).alias("avg_fraud_prob"),
                 count_if(F.col("investigation_outcome") == "FRAUD_CONFIRMED").alias("confirmed_fraud_cases"))
            .where(F.col("total_claims") > 0))


# A10
def daily_fraud_summary(claims: DataFrame, predictions: DataFrame) -> DataFrame:
    fp = predictions.select("claim_id", "risk_level", "fraud_probability")
    j = claims.select("claim_id", "submission_date", "claim_amount").join(fp, "claim_id", "left")
    lvl = F.col("risk_level")
    amt = F.col("claim_amount")
    return (j.groupBy(F.to_date("submission_date").alias("report_date"))
            .agg(F.count(F.lit(1)).alias("total_claims"),
                 count_if(lvl == "Critical Risk").alias("critical_risk_claims"),
                 count_if(lvl == "High Risk").alias("high_risk_claims"),
                 count_if(lvl == "Medium Risk").alias("medium_risk_claims"),
                 count_if(lvl == "Low Risk").alias("low_risk_claims"),
                 exact_avg(amt).alias("avg_claim_amount"),
                 F.sum(amt).cast(MONEY_SUM).alias("total_claim_amount"),
                 exact_avg(F.col("fraud_probability")).alias("avg_fraud_probability"))
            .orderBy(F.col("report_date").desc()))


# T1
def recent_claims(claims: DataFrame, predictions: DataFrame, limit: int = 10) -> DataFrame:
    return (claims_with_predictions(claims, predictions)
            .orderBy(F.col("submission_date").desc_nulls_last(), F.col("claim_id").asc())
            .limit(limit))


# T2
def investigation_queue(investigations: DataFrame, claims: DataFrame, predictions: DataFrame,
                        limit: int = 20) -> DataFrame:
    j = investigations_join(investigations, claims, predictions).where(F.col("status").isin("OPEN", "IN_PROGRESS"))
    return (j.orderBy(rules.priority_ordinal(F.col("priority_level")), F.col("created_date").desc_nulls_last(),
                      F.col("investigation_id").asc())
             .limit(limit)
             .select("investigation_id", "claim_id", "priority_level", "status", "assigned_investigator",
                     "created_date", "claim_amount", "fraud_probability", "risk_level"))


# T3
def risk_ordinal_sort(df: DataFrame, level_col: str = "risk_level") -> DataFrame:
    return df.orderBy(rules.tier_ordinal(F.col(level_col)), F.col(level_col))


# T4
def top_critical_cases(scored: DataFrame, prob_col: str, key_col: str, n: int = 5) -> DataFrame:
    p = F.col(prob_col)
    return (scored.where(rules.risk_tier(p) == "Critical Risk")
            .orderBy(p.desc(), F.col(key_col).asc()).limit(n))
