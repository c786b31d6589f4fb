"""Registered source/sink round trips (S1-S9, S11) and streaming jobs (ST1-ST3)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from claimlens.operators import metrics as mt
from claimlens.operators import relational as rel
from claimlens.plans import pipeline as pl
from claimlens.plans.oracle_views import with_views
from claimlens.plans.queries_features import FINAL_FEATURES, LOG_DIGITS, _final_sql
from claimlens.plans.registry import register
from claimlens.session import ensure_checkpoint_dir
from claimlens.sources import claim_views as cv
from claimlens.sources import io
from claimlens.sources import operational as op
from claimlens.sources.materialize import materialize
from claimlens.streaming import jobs


def _scratch(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), "io", f"{name}-{uuid.uuid4().hex}")


def _write_raw(spark, sf, test: bool) -> str:
    """Write the claim views as the application's raw CSV files (dates as text)."""
    raw = _scratch(spark, "raw")
    p = "test_" if test else ""
    io.write_csv(cv.inpatient_claims(spark, sf), os.path.join(raw, io.RAW_FILES[f"{p}inpatient"]))
    io.write_csv(cv.outpatient_claims(spark, sf), os.path.join(raw, io.RAW_FILES[f"{p}outpatient"]))
    io.write_csv(cv.beneficiary(spark, sf), os.path.join(raw, io.RAW_FILES[f"{p}beneficiary"]))
    labels = cv.provider_labels(spark, sf)
    io.write_csv(labels.select("Provider") if test else labels,
                 os.path.join(raw, io.RAW_FILES["test_main" if test else "train"]))
    return raw


def _cleaned_from_csv(spark, sf, test: bool):
    t = io.scan_claims_csv(spark, _write_raw(spark, sf, test), test)
    claims = rel.claim_rollup(rel.union_claims(t["inpatient"], t["outpatient"]))
    merged = rel.claims_left_beneficiary(rel.label_left_claims(t["main"], claims), t["beneficiary"])
    return pl.clean_claims(merged)


@register("scan_claims_csv", with_views(["cleaned"], "SELECT * FROM cleaned"))
def q_scan_claims_csv(spark, sf):
    return _cleaned_from_csv(spark, sf, test=False)


@register("scan_test_csv", with_views(["cleaned"], "SELECT * EXCLUDE (PotentialFraud) FROM cleaned"))
def q_scan_test_csv(spark, sf):
    return _cleaned_from_csv(spark, sf, test=True)


@register("scan_feature_table", with_views(["featured"], f"SELECT ClaimID, Provider,\n  {_final_sql}\nFROM featured"))
def q_scan_feature_table(spark, sf):
    """S5 then S3: write the feature table, read it back."""
    path = _scratch(spark, "features")
    io.sink_features(pl.feature_table(spark, sf, keep=("ClaimID", "Provider")), path)
    ft = io.scan_feature_table(spark, path)
    return ft.withColumn("ClaimAmountLog", F.round("ClaimAmountLog", LOG_DIGITS))


@register("sink_features", None)
def q_sink_features(spark, sf):
    """S5 as CSV: write, then read back the row count per label."""
    path = _scratch(spark, "features_csv")
    io.sink_features(pl.feature_table(spark, sf).select(*FINAL_FEATURES), path, fmt="csv")
    back = spark.read.option("header", True).csv(path)
    return back.groupBy("PotentialFraud").agg(F.count(F.lit(1)).alias("rows"))


@register("scan_claims_table", with_views(["claims"], "SELECT * FROM claims ORDER BY submission_date DESC"))
def q_scan_claims_table(spark, sf):
    return op.claims_table(spark, sf).orderBy(F.col("submission_date").desc())


@register("append_claims", with_views(["claims"], "SELECT * FROM claims"))
def q_append_claims(spark, sf):
    """Append with defaults, twice; the key anti-join keeps one row per claim."""
    claims = materialize(op.claims_table(spark, sf), "claims_to_append")
    path = _scratch(spark, "claims_table")
    rows = io.with_claim_defaults(claims, claims.schema)
    io.append_with_key(rows, path, "claim_id")
    io.append_with_key(rows, path, "claim_id")
    return spark.read.parquet(path)


@register("clear_tables", None)
def q_clear_tables(spark, sf):
    """Investigations, then predictions, then claims are emptied (schemas kept)."""
    c, p, i = op.operational_tables(spark, sf)
    base = _scratch(spark, "clear")
    tables = [(os.path.join(base, n), df) for n, df in (("claims", c), ("predictions", p), ("investigations", i))]
    for path, df in tables:
        df.write.mode("overwrite").parquet(path)
    io.clear_tables(spark, [(path, df.schema) for path, df in reversed(tables)])
    return rel.union_results(*[spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))
                               .select(F.lit(os.path.basename(path)).alias("table"), "rows") for path, _ in tables])


_REPORT_SQL = """SELECT 'risk_distribution' AS section, risk_level AS name, CAST(coalesce(c, 0) AS DOUBLE) AS value
FROM (VALUES ('Low Risk', 1), ('Medium Risk', 2), ('High Risk', 3), ('Critical Risk', 4)) t(risk_level, tier_order)
LEFT JOIN (SELECT CASE WHEN fraud_probability >= 0.95 THEN 4 WHEN fraud_probability >= 0.8 THEN 3
                       WHEN fraud_probability >= 0.6 THEN 2 ELSE 1 END AS tier_order, count(*) AS c
           FROM predictions GROUP BY 1) x USING (tier_order)
UNION ALL
SELECT 'summary', 'total', CAST(count(fraud_probability) AS DOUBLE) FROM predictions
UNION ALL
SELECT 'summary', 'high_confidence', CAST(count(CASE WHEN fraud_probability >= 0.9 THEN 1 END) AS DOUBLE) FROM predictions
UNION ALL
SELECT 'summary', 'low_risk', CAST(count(CASE WHEN fraud_probability < 0.3 THEN 1 END) AS DOUBLE) FROM predictions"""


@register("report_tables", with_views(["predictions"], _REPORT_SQL))
def q_report_tables(spark, sf):
    """Long-format report written as JSON and read back."""
    p = materialize(op.predictions_table(spark, sf).select("fraud_probability"), "probabilities")
    dist = mt.risk_distribution(p, "fraud_probability").select("risk_level", "count")
    summ = mt.probability_summary(p, "fraud_probability")
    summ_long = summ.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
                                               for c in ("total", "high_confidence", "low_risk")])))
    report = io.report_table({"risk_distribution": dist, "summary": summ_long})
    path = _scratch(spark, "report")
    io.write_report(report, path)
    return spark.read.schema("section string, name string, value double").json(path)


# --- streaming --------------------------------------------------------------------------------------

@register("stream_score_claims", with_views(["predictions"], """SELECT prediction_id, claim_id, fraud_probability,
  risk_level, risk_score, risk_factors, model_version, prediction_timestamp, investigated FROM predictions"""))
def q_stream_score_claims(spark, sf):
    return jobs.run_stream_score(spark, sf)


@register("stream_score_model", None)
def q_stream_score_model(spark, sf):
    """ST1 by the stored model: equals batch scoring with the same state."""
    return jobs.run_stream_by_model(spark, sf)


@register("stream_daily_summary", with_views(["claims", "predictions"], """
SELECT * FROM (
SELECT CAST(c.submission_date AS DATE) AS report_date, count(*) AS total_claims,
  count(CASE WHEN fp.risk_level = 'Critical Risk' THEN 1 END) AS critical_risk_claims,
  count(CASE WHEN fp.risk_level = 'High Risk' THEN 1 END) AS high_risk_claims,
  count(CASE WHEN fp.risk_level = 'Medium Risk' THEN 1 END) AS medium_risk_claims,
  count(CASE WHEN fp.risk_level = 'Low Risk' THEN 1 END) AS low_risk_claims,
  CAST(sum(c.claim_amount) AS DOUBLE) / CAST(nullif(count(c.claim_amount), 0) AS DOUBLE) AS avg_claim_amount,
  CAST(sum(c.claim_amount) AS DECIMAL(22,2)) AS total_claim_amount,
  CAST(sum(fp.fraud_probability) AS DOUBLE) / CAST(nullif(count(fp.fraud_probability), 0) AS DOUBLE) AS avg_fraud_probability
FROM claims c LEFT JOIN predictions fp ON c.claim_id = fp.claim_id
GROUP BY CAST(c.submission_date AS DATE)) d
WHERE CAST(report_date AS TIMESTAMP) + INTERVAL 2 DAY <= (SELECT max(submission_date) FROM claims)"""))
def q_stream_daily_summary(spark, sf):
    """Closed days only: a day is emitted once the watermark (max time - 1 day) passes its end."""
    return jobs.run_stream_daily(spark, sf)


@register("stream_dashboard", with_views(["predictions"], """SELECT risk_level, count(*) AS count,
  coalesce(CAST(sum(fraud_probability) AS DOUBLE) / CAST(nullif(count(fraud_probability), 0) AS DOUBLE), 0.0)
    AS avg_probability FROM predictions GROUP BY risk_level"""))
def q_stream_dashboard(spark, sf):
    return jobs.run_stream_dashboard(spark, sf)
