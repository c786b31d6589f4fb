"""Registered dashboard / operational queries."""

from __future__ import annotations

import os
import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from claimlens.functions import rules
from claimlens.operators import dashboard as dash
from claimlens.operators import relational as rel
from claimlens.plans.oracle_views import VIEWS, exact_avg, tier_sql, with_views
from claimlens.plans.registry import register
from claimlens.session import ensure_checkpoint_dir
from claimlens.sources import io
from claimlens.sources import operational as op
from claimlens.sources.claim_views import provider_profile_key
from claimlens.sources.materialize import materialize


def _tables(spark, sf, *extra):
    """The three tables with the claim columns for scoring and ``extra``."""
    return op.operational_tables(spark, sf, extra)


@register("provider_statistics", with_views(["claims", "predictions", "investigations"], f"""
SELECT c.provider_id, count(*) AS total_claims,
  {exact_avg('c.claim_amount')} AS avg_claim_amount,
  CAST(sum(c.claim_amount) AS DECIMAL(22,2)) AS total_claim_amount,
  count(CASE WHEN fp.risk_level IN ('Critical Risk', 'High Risk') THEN 1 END) AS critical_cases,
  {exact_avg('fp.fraud_probability')} AS avg_fraud_prob,
  count(CASE WHEN i.investigation_outcome = 'FRAUD_CONFIRMED' THEN 1 END) AS confirmed_fraud_cases
FROM claims c LEFT JOIN predictions fp ON c.claim_id = fp.claim_id
LEFT JOIN investigations i ON c.claim_id = i.claim_id
GROUP BY c.provider_id HAVING count(*) > 0"""), bench=True)
def q_provider_statistics(spark, sf):
    return dash.provider_statistics(*_tables(spark, sf, "provider_id"))


@register("daily_fraud_summary", with_views(["claims", "predictions"], f"""
SELECT CAST(c.submission_date AS DATE) AS report_date, count(*) AS total_claims,
  count(CASE WHEN fp.risk_level = 'Critical Risk' THEN 1 END) AS critical_risk_claims,
  count(CASE WHEN fp.risk_level = 'High Risk' THEN 1 END) AS high_risk_claims,
  count(CASE WHEN fp.risk_level = 'Medium Risk' THEN 1 END) AS medium_risk_claims,
  count(CASE WHEN fp.risk_level = 'Low Risk' THEN 1 END) AS low_risk_claims,
  {exact_avg('c.claim_amount')} AS avg_claim_amount,
  CAST(sum(c.claim_amount) AS DECIMAL(22,2)) AS total_claim_amount,
  {exact_avg('fp.fraud_probability')} AS avg_fraud_probability
FROM claims c LEFT JOIN predictions fp ON c.claim_id = fp.claim_id
GROUP BY CAST(c.submission_date AS DATE) ORDER BY report_date DESC"""), bench=True)
def q_daily_fraud_summary(spark, sf):
    c, p, _ = _tables(spark, sf)
    return dash.daily_fraud_summary(c, p)


@register("dashboard_metrics", with_views(["claims", "predictions", "investigations"], """
SELECT a.total_claims, b.critical_cases, b.high_risk_cases, b.medium_risk_cases, c.open_investigations
FROM (SELECT count(*) AS total_claims FROM claims) a,
     (SELECT count(CASE WHEN risk_level = 'Critical Risk' THEN 1 END) AS critical_cases,
             count(CASE WHEN risk_level = 'High Risk' THEN 1 END) AS high_risk_cases,
             count(CASE WHEN risk_level = 'Medium Risk' THEN 1 END) AS medium_risk_cases FROM predictions) b,
     (SELECT count(CASE WHEN status = 'OPEN' THEN 1 END) AS open_investigations FROM investigations) c"""))
def q_dashboard_metrics(spark, sf):
    return dash.dashboard_metrics(*_tables(spark, sf))


@register("predictions_summary", with_views(["predictions"], f"""
SELECT risk_level, count(*) AS count, coalesce({exact_avg('fraud_probability')}, 0.0) AS avg_probability
FROM predictions GROUP BY risk_level"""))
def q_predictions_summary(spark, sf):
    return dash.predictions_summary(op.predictions_table(spark, sf))


@register("seed_summary", with_views(["claims", "predictions", "investigations"], f"""
SELECT pl.risk_level, pl.count, pl.avg_prob, pl.risk_order, a.total_claims, a.avg_amount, a.max_amount, a.min_amount,
       c.open_investigations
FROM (SELECT risk_level, count(*) AS count, {exact_avg('fraud_probability')} AS avg_prob,
             CASE risk_level WHEN 'Critical Risk' THEN 1 WHEN 'High Risk' THEN 2 WHEN 'Medium Risk' THEN 3 ELSE 4 END AS risk_order
      FROM predictions GROUP BY risk_level) pl,
     (SELECT count(*) AS total_claims, {exact_avg('claim_amount')} AS avg_amount, max(claim_amount) AS max_amount,
             min(claim_amount) AS min_amount FROM claims) a,
     (SELECT count(CASE WHEN status = 'OPEN' THEN 1 END) AS open_investigations FROM investigations) c
ORDER BY pl.risk_order"""))
def q_seed_summary(spark, sf):
    return dash.risk_ordinal_sort(dash.seed_summary(*_tables(spark, sf)))


@register("claims_with_predictions", with_views(["claims", "predictions"], """
SELECT c.claim_id, c.claim_amount, c.submission_date,
  coalesce(fp.risk_level, 'Not Analyzed') AS risk_level,
  coalesce(fp.fraud_probability, CAST(0 AS DECIMAL(5,4))) AS fraud_probability
FROM claims c LEFT JOIN predictions fp ON c.claim_id = fp.claim_id"""))
def q_claims_with_predictions(spark, sf):
    c, p, _ = _tables(spark, sf)
    return dash.claims_with_predictions(c, p)


@register("recent_claims", with_views(["claims", "predictions"], """
SELECT c.claim_id, c.claim_amount, c.submission_date,
  coalesce(fp.risk_level, 'Not Analyzed') AS risk_level,
  coalesce(fp.fraud_probability, CAST(0 AS DECIMAL(5,4))) AS fraud_probability
FROM claims c LEFT JOIN predictions fp ON c.claim_id = fp.claim_id
ORDER BY c.submission_date DESC NULLS LAST, c.claim_id ASC LIMIT 20"""))
def q_recent_claims(spark, sf):
    c, p, _ = _tables(spark, sf)
    return dash.recent_claims(c, p, limit=20)


@register("investigations_join", with_views(["claims", "predictions", "investigations"], """
SELECT i.prediction_id, i.claim_id, i.investigation_id, i.priority_level, i.status, i.assigned_investigator,
  i.created_date, c.claim_amount, fp.fraud_probability, fp.risk_level
FROM investigations i JOIN claims c ON i.claim_id = c.claim_id
LEFT JOIN predictions fp ON i.prediction_id = fp.prediction_id"""))
def q_investigations_join(spark, sf):
    c, p, i = _tables(spark, sf)
    return dash.investigations_join(i, c, p)


@register("investigation_queue", with_views(["claims", "predictions", "investigations"], """
SELECT i.investigation_id, i.claim_id, i.priority_level, i.status, i.assigned_investigator, i.created_date,
  c.claim_amount, fp.fraud_probability, fp.risk_level
FROM investigations i JOIN claims c ON i.claim_id = c.claim_id
LEFT JOIN predictions fp ON i.prediction_id = fp.prediction_id
WHERE i.status IN ('OPEN', 'IN_PROGRESS')
ORDER BY CASE i.priority_level WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END,
  i.created_date DESC NULLS LAST, i.investigation_id ASC
LIMIT 20"""), bench=True)
def q_investigation_queue(spark, sf):
    c, p, i = _tables(spark, sf)
    return dash.investigation_queue(i, c, p, limit=20)


@register("claims_pred_inv", with_views(["claims", "predictions", "investigations"], """
SELECT c.*, fp.risk_level, fp.fraud_probability, i.investigation_outcome
FROM claims c LEFT JOIN predictions fp ON c.claim_id = fp.claim_id
LEFT JOIN investigations i ON c.claim_id = i.claim_id"""))
def q_claims_pred_inv(spark, sf):
    return dash.claims_pred_inv(*op.operational_tables(spark, sf))  # every column of a claim


@register("risk_ordinal_sort", with_views(["predictions"], """
SELECT risk_level, count(*) AS n FROM predictions GROUP BY risk_level
ORDER BY CASE risk_level WHEN 'Critical Risk' THEN 1 WHEN 'High Risk' THEN 2 WHEN 'Medium Risk' THEN 3 ELSE 4 END"""))
def q_risk_ordinal_sort(spark, sf):
    p = op.predictions_table(spark, sf)
    return dash.risk_ordinal_sort(p.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n")))


@register("top_critical_cases", with_views(["claims", "predictions"], """
SELECT fp.claim_id, fp.fraud_probability, c.claim_amount FROM predictions fp JOIN claims c ON fp.claim_id = c.claim_id
WHERE fp.fraud_probability >= 0.95 ORDER BY fp.fraud_probability DESC, fp.claim_id ASC LIMIT 5"""))
def q_top_critical_cases(spark, sf):
    c, p, _ = _tables(spark, sf)
    scored = p.select("claim_id", "fraud_probability").join(c.select("claim_id", "claim_amount"), "claim_id")
    return dash.top_critical_cases(scored, "fraud_probability", "claim_id", 5)


# Fixture: claims whose number is divisible by 4 have a case already; every second claim has a model probability.
_NUMBER_SQL = "try_cast(regexp_extract(claim_id, '(\\d+)$', 1) AS BIGINT)"


def _number(col="claim_id"):
    return F.regexp_extract(F.col(col), r"(\d+)$", 1).try_cast("bigint")


@register("create_investigations", with_views(["predictions"], f"""
SELECT md5('inv:' || prediction_id) AS investigation_id, claim_id, prediction_id,
  CASE WHEN risk_level = 'Critical Risk' THEN 'CRITICAL' WHEN risk_level = 'High Risk' THEN 'HIGH' ELSE 'MEDIUM' END AS priority_level,
  'OPEN' AS status, CAST(NULL AS VARCHAR) AS assigned_investigator, CAST(NULL AS VARCHAR) AS findings,
  CAST(NULL AS VARCHAR) AS investigation_outcome, CAST(0 AS DECIMAL(12,2)) AS amount_recovered,
  prediction_timestamp AS created_date, CAST(NULL AS TIMESTAMP) AS completion_date
FROM predictions WHERE risk_level IN ('Critical Risk', 'High Risk', 'Medium Risk') AND fraud_probability >= 0.6
  AND {_NUMBER_SQL} % 4 <> 0"""))
def q_create_investigations(spark, sf):
    """R11 against existing cases: predictions that have one get no second."""
    p = materialize(op.predictions_table(spark, sf), "predictions")
    existing = op.create_investigations(p.where(_number() % 4 == 0))
    return op.create_investigations(p, existing)


@register("append_predictions", with_views(["predictions"], """
SELECT prediction_id, claim_id, fraud_probability, risk_level, risk_score, risk_factors, model_version,
  prediction_timestamp, investigated FROM predictions"""))
def q_append_predictions(spark, sf):
    """A first run stores a part, a second one everything; the key rule keeps one row per prediction."""
    p = materialize(op.predictions_table(spark, sf), "predictions")
    path = os.path.join(ensure_checkpoint_dir(spark), "io", f"predictions-{uuid.uuid4().hex}")
    io.append_with_key(p.where(_number() % 4 == 0), path, "prediction_id")
    io.append_with_key(p, path, "prediction_id")
    return spark.read.parquet(path)


@register("heuristic_probability", with_views(["scored"], """
SELECT claim_id, p AS fraud_probability FROM scored"""))
def q_heuristic_probability(spark, sf):
    c = op.claims_table(spark, sf)
    col = F.col
    return c.select("claim_id", rules.heuristic_probability(
        col("claim_amount"), col("hospital_stay_days"), col("patient_total_claims"), col("patient_age"),
        op.chronic4(c)).alias("fraud_probability"))


@register("risk_tier", with_views(["scored"], """
SELECT claim_id, CASE WHEN p >= 0.95 THEN 'Critical Risk' WHEN p >= 0.80 THEN 'High Risk'
  WHEN p >= 0.60 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_level FROM scored"""))
def q_risk_tier(spark, sf):
    p = op.predictions_table(spark, sf)
    return p.select("claim_id", rules.risk_tier(F.col("fraud_probability")).alias("risk_level"))


@register("risk_tier_live", with_views(["scored"], """
SELECT claim_id, CASE WHEN p >= 0.80 THEN 'High Risk' WHEN p >= 0.20 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_level,
  CASE WHEN p >= 0.80 THEN 'risk-high' WHEN p >= 0.20 THEN 'risk-medium' ELSE 'risk-low' END AS risk_class FROM scored"""))
def q_risk_tier_live(spark, sf):
    p = op.predictions_table(spark, sf)
    lvl = rules.risk_tier_live(F.col("fraud_probability"))
    return p.select("claim_id", lvl.alias("risk_level"), rules.risk_tier_class(lvl).alias("risk_class"))


@register("risk_tier_policy", with_views(["scored"], """
SELECT claim_id, CASE WHEN p >= 0.90 THEN 'Critical Risk' WHEN p >= 0.70 THEN 'High Risk'
  WHEN p >= 0.50 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_level FROM scored"""))
def q_risk_tier_policy(spark, sf):
    p = op.predictions_table(spark, sf)
    return p.select("claim_id", rules.risk_tier_policy(F.col("fraud_probability")).alias("risk_level"))


VIEWS["scored_by_model"] = (["scored"], f"""SELECT * REPLACE (CASE WHEN {_NUMBER_SQL} % 2 = 0
  THEN CAST(least(claim_amount * 0.00001, 0.99) AS DECIMAL(5,4)) ELSE p END AS p) FROM scored""")


@register("score_with_fallback", with_views(["scored_by_model"], f"""
SELECT claim_id, p AS fraud_probability, {tier_sql('p')} AS risk_level, CAST(floor(p * 100) AS INTEGER) AS risk_score,
  to_json({{'high_claim_amount': coalesce(claim_amount > 15000, false),
           'elderly_patient': coalesce(patient_age > 70, false),
           'short_stay_high_cost': coalesce(hospital_stay_days <= 2 AND claim_amount > 10000, false),
           'frequent_claimant': coalesce(patient_total_claims > 15, false),
           'multiple_chronic_conditions': coalesce(chronic4 > 1, false)}})::VARCHAR AS risk_factors
FROM scored_by_model"""))
def q_score_with_fallback(spark, sf):
    """R10 with both branches: every second claim has a probability of an (amount) model, the rest take the rule."""
    amount_model = F.least(F.col("claim_amount") * F.lit(Decimal("0.00001")), F.lit(Decimal("0.99")))
    p = op.score_claims(op.claims_table(spark, sf), model_probability=F.when(_number() % 2 == 0, amount_model))
    return p.select("claim_id", "fraud_probability", "risk_level", "risk_score", "risk_factors")


@register("risk_factors", with_views(["scored"], """
SELECT claim_id,
  to_json({'high_claim_amount': coalesce(claim_amount > 15000, false), 'elderly_patient': coalesce(patient_age > 70, false),
           'short_stay_high_cost': coalesce(hospital_stay_days <= 2 AND claim_amount > 10000, false),
           'frequent_claimant': coalesce(patient_total_claims > 15, false),
           'multiple_chronic_conditions': coalesce(chronic4 > 1, false)})::VARCHAR AS batch_factors,
  to_json({'high_claim_amount': coalesce(claim_amount > 25000, false), 'elderly_patient': coalesce(patient_age > 75, false),
           'short_stay_high_cost': coalesce(hospital_stay_days < 2 AND claim_amount > 20000, false),
           'frequent_claimant': coalesce(patient_total_claims > 10, false),
           'chronic_conditions': coalesce(chronic4 > 2, false)})::VARCHAR AS live_factors
FROM scored"""))
def q_risk_factors(spark, sf):
    c = op.claims_table(spark, sf)
    col = F.col
    args = (col("claim_amount"), col("patient_age"), col("hospital_stay_days"), col("patient_total_claims"), op.chronic4(c))
    return c.select("claim_id", F.to_json(rules.risk_factors_batch(*args)).alias("batch_factors"),
                    F.to_json(rules.risk_factors_live(*args)).alias("live_factors"))


@register("expected_risk_level", with_views(["claims", "profiles"], """
SELECT c.claim_id, CASE WHEN s >= 10 THEN 'Critical Risk' WHEN s >= 6 THEN 'High Risk' WHEN s >= 3 THEN 'Medium Risk'
  ELSE 'Low Risk' END AS expected_level
FROM (SELECT c.claim_id,
  CASE WHEN claim_amount > 100000 THEN 4 WHEN claim_amount > 50000 THEN 3 WHEN claim_amount > 20000 THEN 2 ELSE 0 END
  + coalesce(CASE pr.risk WHEN 'critical' THEN 4 WHEN 'suspicious' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1
                          WHEN 'low' THEN 0 END, 0)
  + CASE WHEN patient_total_claims > 50 THEN 4 WHEN patient_total_claims > 20 THEN 2 ELSE 0 END
  + CASE WHEN patient_provider_count > 8 THEN 3 WHEN patient_provider_count > 5 THEN 2 ELSE 0 END
  + CASE WHEN hospital_stay_days <= 2 AND claim_amount > 15000 THEN 2 ELSE 0 END
  + CASE WHEN patient_age < 40 AND claim_amount > 25000 THEN 2 ELSE 0 END AS s
  FROM claims c LEFT JOIN profiles pr
    ON pr.provider_id = 'PRV00' || CAST(try_cast(c.provider_id AS BIGINT) % 8 + 1 AS VARCHAR)) c"""))
def q_expected_risk_level(spark, sf):
    c = op.claims_table(spark, sf)
    j = rel.provider_profile_lookup(c, op.provider_profiles(spark).withColumnRenamed("provider_id", "profile_id"),
                                    provider_profile_key(F.col("provider_id")), "profile_id")
    col = F.col
    return j.select("claim_id", rules.expected_risk_level(
        col("claim_amount"), col("risk"), col("patient_total_claims"), col("patient_provider_count"),
        col("hospital_stay_days"), col("patient_age")).alias("expected_level"))


@register("provider_profile_lookup", with_views(["claims", "profiles"], """
SELECT c.provider_id, pr.risk, pr.base_avg, pr.base_count, count(*) AS claims
FROM claims c LEFT JOIN profiles pr
  ON pr.provider_id = 'PRV00' || CAST(try_cast(c.provider_id AS BIGINT) % 8 + 1 AS VARCHAR)
GROUP BY c.provider_id, pr.risk, pr.base_avg, pr.base_count"""))
def q_provider_profile_lookup(spark, sf):
    c = op.claims_table(spark, sf)
    j = rel.provider_profile_lookup(c, op.provider_profiles(spark).withColumnRenamed("provider_id", "profile_id"),
                                    provider_profile_key(F.col("provider_id")), "profile_id")
    return j.groupBy("provider_id", "risk", "base_avg", "base_count").agg(F.count(F.lit(1)).alias("claims"))


@register("orphan_check", with_views(["claims", "predictions", "investigations"], """
SELECT 'predictions->claims' AS edge, count(*) AS orphans FROM predictions p
  WHERE p.claim_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.claim_id = p.claim_id)
UNION ALL
SELECT 'investigations->claims', count(*) FROM investigations i
  WHERE i.claim_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.claim_id = i.claim_id)
UNION ALL
SELECT 'investigations->predictions', count(*) FROM investigations i
  WHERE i.prediction_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM predictions p WHERE p.prediction_id = i.prediction_id)"""))
def q_orphan_check(spark, sf):
    c, p, i = _tables(spark, sf)
    edges = [("predictions->claims", rel.orphan_rows(p, c, "claim_id")),
             ("investigations->claims", rel.orphan_rows(i, c, "claim_id")),
             ("investigations->predictions", rel.orphan_rows(i, p, "prediction_id"))]
    return rel.union_results(*[df.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(e).alias("edge"), "orphans")
                               for e, df in edges])


@register("risk_priority", with_views(["predictions"], """
SELECT prediction_id, CASE WHEN risk_level = 'Critical Risk' THEN 'CRITICAL' WHEN risk_level = 'High Risk' THEN 'HIGH'
  ELSE 'MEDIUM' END AS priority_level FROM predictions"""))
def q_risk_priority(spark, sf):
    p = op.predictions_table(spark, sf)
    return p.select("prediction_id", rules.risk_priority(F.col("risk_level")).alias("priority_level"))


@register("claim_id_provenance", with_views(["claims"], """
SELECT count(CASE WHEN coalesce(contains(claim_id, 'CLM_202'), false) THEN 1 END) AS manual_claims,
       count(CASE WHEN coalesce(contains(claim_id, 'CLM202'), false) THEN 1 END) AS seeded_claims,
       count(*) AS total_claims FROM claims"""))
def q_claim_id_provenance(spark, sf):
    c = op.claims_table(spark, sf)
    manual, seeded = rules.claim_id_provenance(F.col("claim_id"))
    return c.agg(dash.count_if(manual).alias("manual_claims"), dash.count_if(seeded).alias("seeded_claims"),
                 F.count(F.lit(1)).alias("total_claims"))


@register("claims_display", with_views(["claims", "predictions"], """
SELECT c.claim_id, '$' || format('{:,.2f}', CAST(c.claim_amount AS DECIMAL(18,2))) AS amount_display,
  strftime(c.submission_date, '%Y-%m-%d %H:%M') AS submitted_display,
  coalesce(fp.risk_level, 'Not Analyzed') AS risk_level,
  CASE coalesce(fp.risk_level, 'Not Analyzed') WHEN 'Critical Risk' THEN '#dc3545' WHEN 'High Risk' THEN '#fd7e14'
       WHEN 'Medium Risk' THEN '#ffc107' ELSE '#28a745' END AS row_color
FROM claims c LEFT JOIN predictions fp ON c.claim_id = fp.claim_id"""))
def q_claims_display(spark, sf):
    c, p, _ = _tables(spark, sf)
    j = dash.claims_with_predictions(c, p)
    return j.select("claim_id", rules.display_amount(F.col("claim_amount")).alias("amount_display"),
                    rules.display_timestamp(F.col("submission_date")).alias("submitted_display"),
                    "risk_level", rules.row_color(F.col("risk_level")).alias("row_color"))


@register("typed_setting", with_views(["predictions", "settings"], """
SELECT s.setting_name, count(p.prediction_id) AS flagged
FROM settings s LEFT JOIN predictions p
  ON s.setting_type = 'DECIMAL' AND p.fraud_probability >= try_cast(s.setting_value AS DOUBLE)
GROUP BY s.setting_name"""))
def q_typed_setting(spark, sf):
    """Predictions at or above each DECIMAL threshold setting (settings read with typed casts)."""
    s = op.settings_table(spark).select("setting_name", *rules.typed_value(F.col("setting_value"), F.col("setting_type")))
    p = op.predictions_table(spark, sf).select("prediction_id", "fraud_probability")
    # One pass over the predictions with a count per threshold; settings is a fixed five-row table.
    levels = [(r["setting_name"], r["decimal_value"]) for r in s.collect() if r["decimal_value"] is not None]
    named = [F.struct(F.lit(n).alias("setting_name"), F.count_if(F.col("fraud_probability").cast("double") >= F.lit(v)).alias("flagged"))
             for n, v in levels]
    counts = p.agg(F.array(*named).alias("all")).select(F.inline("all"))
    return (s.select("setting_name").join(counts, "setting_name", "left")
             .select("setting_name", F.coalesce(F.col("flagged"), F.lit(0)).alias("flagged")))


_REASONS_SQL = """CASE WHEN fp.fraud_probability >= 0.8 THEN concat_ws('; ',
    CASE WHEN c.claim_amount > 50000 THEN 'Very high claim amount' END,
    CASE WHEN c.patient_total_claims > 15 THEN 'Frequent claimant pattern' END,
    CASE WHEN c.hospital_stay_days < 2 AND c.claim_amount > 20000 THEN 'Short stay with expensive treatment' END)
  WHEN fp.fraud_probability >= 0.21 THEN concat_ws('; ',
    CASE WHEN c.claim_amount > 25000 THEN 'Above-average claim amount' END,
    CASE WHEN c.patient_age < 30 AND c.claim_amount > 30000 THEN 'Young patient with high claim' END,
    CASE WHEN c.patient_provider_count > 5 THEN 'Multiple providers used by patient' END,
    CASE WHEN c.hospital_stay_days < 2 AND c.claim_amount > 20000 THEN 'Short hospital stay with high cost' END,
    CASE WHEN c.patient_total_claims > 5 THEN 'Multiple previous claims' END)
  ELSE concat_ws('; ', 'Normal claim amount range', 'Reasonable patient history',
    CASE WHEN (CAST(c.chronic_diabetes AS INTEGER) + CAST(c.chronic_heartfailure AS INTEGER)
               + CAST(c.chronic_cancer AS INTEGER) + CAST(c.chronic_kidney AS INTEGER)) > 0
         THEN 'Medical conditions justify costs' END) END"""


@register("risk_explanations", with_views(["claims", "predictions"], f"""
SELECT fp.claim_id, fp.risk_level, {_REASONS_SQL} AS reasons
FROM predictions fp JOIN claims c ON fp.claim_id = c.claim_id"""))
def q_risk_explanations(spark, sf):
    c, p, _ = _tables(spark, sf, "patient_provider_count")
    j = p.select("claim_id", "risk_level", "fraud_probability").join(c, "claim_id")
    col = F.col
    reasons = rules.risk_explanations(col("fraud_probability"), col("claim_amount"), col("patient_total_claims"),
                                      col("hospital_stay_days"), col("patient_age"), col("patient_provider_count"),
                                      op.chronic4(c))
    return j.select("claim_id", "risk_level", F.concat_ws("; ", reasons).alias("reasons"))


@register("upsert_settings", with_views(["predictions", "settings"], """
SELECT setting_name, setting_value, setting_type, description FROM (
  SELECT 'fraud_threshold_balanced' AS setting_name, CAST(max(fraud_probability) AS VARCHAR) AS setting_value,
         'DECIMAL' AS setting_type, 'highest observed probability' AS description FROM predictions) e
UNION ALL
SELECT s.* FROM settings s WHERE s.setting_name <> 'fraud_threshold_balanced'"""))
def q_upsert_settings(spark, sf):
    """Defaults inserted where absent; an existing (data-derived) setting is kept."""
    from claimlens.sources import io
    p = op.predictions_table(spark, sf)
    existing = p.agg(F.max("fraud_probability").cast("string").alias("setting_value")).select(
        F.lit("fraud_threshold_balanced").alias("setting_name"), "setting_value",
        F.lit("DECIMAL").alias("setting_type"), F.lit("highest observed probability").alias("description"))
    return io.upsert_settings(existing, op.settings_table(spark))
