"""Registered metric and profiling queries.

Scored rows: label = the provider's PotentialFraud flag, score = the rule
probability (R4) of each claim -- coarse scores with many ties -- and, for the
leaderboard, two more scorers over the same claims.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.config import CHRONIC_CONDITIONS, FEATURE_CATEGORIES, FEATURE_CATEGORY_DEFAULT, REPORT_FEATURE_PATTERN, THRESHOLD_POLICIES
from claimlens.functions import rules
from claimlens.operators import dashboard as dash
from claimlens.operators import metrics as mt
from claimlens.operators import ml
from claimlens.operators import profiling as pf
from claimlens.plans import pipeline as pl
from claimlens.plans.oracle_views import VIEWS, with_views
from claimlens.plans.queries_features import FINAL_FEATURES
from claimlens.plans.registry import register
from claimlens.sources import claim_views as cv
from claimlens.sources import operational as op
from claimlens.sources.materialize import materialize

VIEWS["scored_labels"] = (["predictions", "claims", "labels_v"], """SELECT fp.claim_id, c.provider_id,
  CASE WHEN l.PotentialFraud = 'Yes' THEN 1 ELSE 0 END AS label,
  CAST(fp.fraud_probability AS DOUBLE) AS score, fp.fraud_probability, fp.risk_level, c.claim_amount
FROM predictions fp JOIN claims c ON fp.claim_id = c.claim_id JOIN labels_v l ON c.provider_id = l.Provider""")
VIEWS["score_counts"] = (["scored_labels"], """SELECT score, count(CASE WHEN label = 1 THEN 1 END) AS pos,
  count(CASE WHEN label = 0 THEN 1 END) AS neg FROM scored_labels
WHERE score IS NOT NULL AND label IN (0, 1) GROUP BY score""")
VIEWS["cum_desc"] = (["score_counts"], """SELECT *,
  sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
  sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp
FROM score_counts""")
VIEWS["totals"] = (["score_counts"], "SELECT sum(pos) AS n1, sum(neg) AS n0 FROM score_counts")


def sdiv(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / CAST(nullif({b}, 0) AS DOUBLE), 0.0)"


def scored_labels(spark, sf) -> DataFrame:
    """Lazy: scores come with their claim's provider and amount in one projection, then one label join."""
    claims = op.claims_table(spark, sf)
    p = op.score_claims(claims, keep=("provider_id", "claim_amount"))
    j = p.join(cv.provider_labels(spark, sf), F.col("provider_id") == F.col("Provider"))
    return j.select("claim_id", "provider_id", F.when(F.col("PotentialFraud") == "Yes", 1).otherwise(0).alias("label"),
                    F.col("fraud_probability").cast("double").alias("score"), "fraud_probability", "risk_level",
                    "claim_amount")


def _labels_table(spark, sf) -> DataFrame:
    """(claim_id, label, score) written once: splits and folds read their rows for slices, ranks and totals."""
    return materialize(scored_labels(spark, sf).select("claim_id", "label", "score"), "scored_labels")


@register("roc_auc", with_views(["score_counts"], """SELECT
  CAST(sum(CAST(pos AS HUGEINT) * (2 * negle - neg)) AS DOUBLE) / (2.0 * CAST(sum(neg) AS DOUBLE) * CAST(sum(pos) AS DOUBLE))
    AS roc_auc, CAST(sum(pos) AS BIGINT) AS n1, CAST(sum(neg) AS BIGINT) AS n0
FROM (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS negle
      FROM score_counts) t"""), bench=True)
def q_roc_auc(spark, sf):
    return mt.roc_auc(scored_labels(spark, sf), "label", "score")


@register("roc_curve", with_views(["cum_desc", "totals"], f"""SELECT score AS threshold, CAST(tp AS BIGINT) AS tp,
  CAST(fp AS BIGINT) AS fp,
  {sdiv('tp', 'n1')} AS tpr, {sdiv('fp', 'n0')} AS fpr FROM cum_desc, totals"""))
def q_roc_curve(spark, sf):
    return mt.roc_curve(scored_labels(spark, sf), "label", "score")


@register("average_precision", with_views(["cum_desc"], """SELECT
  round(sum(CAST(pos AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)) / CAST(sum(pos) AS DOUBLE), 12)
    AS average_precision FROM cum_desc"""))
def q_average_precision(spark, sf):
    return mt.average_precision(scored_labels(spark, sf), "label", "score")


_F1_PTS = f"""SELECT score, {sdiv('tp', 'tp + fp')} AS p, {sdiv('tp', 'n1')} AS r FROM cum_desc, totals"""


@register("best_f1_threshold", with_views(["cum_desc", "totals", "scored_labels"], f"""
SELECT b.*, d.* FROM
 (SELECT score AS best_threshold, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS best_f1,
         p AS best_precision, r AS best_recall FROM ({_F1_PTS}) t
  ORDER BY best_f1 DESC, score ASC LIMIT 1) b,
 (SELECT {sdiv('tp', 'tp + fp')} AS default_precision, {sdiv('tp', 'tp + fn')} AS default_recall FROM
   (SELECT count(CASE WHEN label = 1 AND score >= 0.5 THEN 1 END) AS tp,
           count(CASE WHEN label = 0 AND score >= 0.5 THEN 1 END) AS fp,
           count(CASE WHEN label = 1 AND NOT (score >= 0.5) THEN 1 END) AS fn FROM scored_labels) c) d"""))
def q_best_f1_threshold(spark, sf):
    return mt.best_f1_threshold(scored_labels(spark, sf), "label", "score")


_CM = """count(CASE WHEN label = 0 AND NOT (score >= 0.5) THEN 1 END) AS tn,
  count(CASE WHEN label = 0 AND score >= 0.5 THEN 1 END) AS fp,
  count(CASE WHEN label = 1 AND NOT (score >= 0.5) THEN 1 END) AS fn,
  count(CASE WHEN label = 1 AND score >= 0.5 THEN 1 END) AS tp"""


@register("confusion_matrix", with_views(["scored_labels"], f"SELECT {_CM} FROM scored_labels"))
def q_confusion_matrix(spark, sf):
    return mt.confusion_matrix(scored_labels(spark, sf), "label", F.col("score") >= 0.5)


_METRICS = f"""{sdiv('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {sdiv('tp', 'tp + fp')} AS precision,
  {sdiv('tp', 'tp + fn')} AS recall,
  CASE WHEN {sdiv('tp', 'tp + fp')} + {sdiv('tp', 'tp + fn')} > 0
       THEN 2 * {sdiv('tp', 'tp + fp')} * {sdiv('tp', 'tp + fn')} / ({sdiv('tp', 'tp + fp')} + {sdiv('tp', 'tp + fn')})
       ELSE 0.0 END AS f1,
  {sdiv('tp + fp', 'tp + fp + fn + tn')} AS predicted_rate, {sdiv('tp + fn', 'tp + fp + fn + tn')} AS actual_rate"""


@register("classification_metrics", with_views(["scored_labels"], f"""SELECT *, {_METRICS}
FROM (SELECT {_CM} FROM scored_labels) c"""))
def q_classification_metrics(spark, sf):
    return mt.classification_metrics(scored_labels(spark, sf), "label", "score")


@register("class_report", with_views(["scored_labels"], f"""SELECT 0 AS class, {sdiv('tn', 'tn + fn')} AS precision,
  {sdiv('tn', 'tn + fp')} AS recall,
  CASE WHEN {sdiv('tn', 'tn + fn')} + {sdiv('tn', 'tn + fp')} > 0 THEN 2 * {sdiv('tn', 'tn + fn')} * {sdiv('tn', 'tn + fp')}
       / ({sdiv('tn', 'tn + fn')} + {sdiv('tn', 'tn + fp')}) ELSE 0.0 END AS f1, tn + fp AS support
FROM (SELECT {_CM} FROM scored_labels) c
UNION ALL
SELECT 1, {sdiv('tp', 'tp + fp')}, {sdiv('tp', 'tp + fn')},
  CASE WHEN {sdiv('tp', 'tp + fp')} + {sdiv('tp', 'tp + fn')} > 0 THEN 2 * {sdiv('tp', 'tp + fp')} * {sdiv('tp', 'tp + fn')}
       / ({sdiv('tp', 'tp + fp')} + {sdiv('tp', 'tp + fn')}) ELSE 0.0 END, tp + fn
FROM (SELECT {_CM} FROM scored_labels) c"""))
def q_class_report(spark, sf):
    return mt.class_report(scored_labels(spark, sf), "label", "score")


_POLICY_SQL = "\nUNION ALL\n".join(
    f"SELECT '{n}' AS policy, CAST({t} AS DOUBLE) AS threshold, c{i} AS fraud_count, {sdiv(f'c{i}', 'n')} AS fraud_rate, "
    f"'{u}' AS use_case, CAST(c{i} * 30 AS DOUBLE) / 60.0 AS workload_hours FROM agg"
    for i, (n, t, u) in enumerate(THRESHOLD_POLICIES))


@register("threshold_policy", with_views(["scored_labels"], _POLICY_SQL, extra=[("agg", "SELECT count(*) AS n, " + ", ".join(
    f"count(CASE WHEN score >= {t} THEN 1 END) AS c{i}" for i, (_, t, _) in enumerate(THRESHOLD_POLICIES))
    + " FROM scored_labels")]))
def q_threshold_policy(spark, sf):
    return mt.threshold_policy(scored_labels(spark, sf), "score")


@register("probability_summary", with_views(["predictions"], """SELECT count(fraud_probability) AS total,
  CAST(sum(fraud_probability) AS DOUBLE) / CAST(nullif(count(fraud_probability), 0) AS DOUBLE) AS mean_probability,
  count(CASE WHEN fraud_probability >= 0.9 THEN 1 END) AS high_confidence,
  count(CASE WHEN fraud_probability >= 0.7 AND fraud_probability < 0.9 THEN 1 END) AS medium_confidence,
  count(CASE WHEN fraud_probability < 0.3 THEN 1 END) AS low_risk FROM predictions"""))
def q_probability_summary(spark, sf):
    return mt.probability_summary(op.predictions_table(spark, sf), "fraud_probability")


@register("risk_distribution", with_views(["predictions"], """SELECT * FROM (VALUES ('Low Risk', 1), ('Medium Risk', 2),
  ('High Risk', 3), ('Critical Risk', 4)) t(risk_level, tier_order)
LEFT JOIN (SELECT CASE WHEN fraud_probability >= 0.95 THEN 4 WHEN fraud_probability >= 0.8 THEN 3
                       WHEN fraud_probability >= 0.6 THEN 2 ELSE 1 END AS tier_order, count(*) AS c
           FROM predictions GROUP BY 1) c USING (tier_order)""".replace("SELECT * FROM", "SELECT risk_level, tier_order, coalesce(c, 0) AS count FROM")))
def q_risk_distribution(spark, sf):
    return mt.risk_distribution(op.predictions_table(spark, sf), "fraud_probability")


@register("probability_histogram", with_views(["predictions"], """SELECT CAST(r.bin AS INTEGER) AS bin,
  lo + CAST(r.bin AS DOUBLE) * (hi - lo) / 50 AS bin_start, coalesce(n, 0) AS count
FROM range(50) r(bin) CROSS JOIN bounds
LEFT JOIN (SELECT CASE WHEN (hi - lo) / 50 > 0 THEN least(floor((CAST(fraud_probability AS DOUBLE) - lo) / ((hi - lo) / 50)), 49)
                       ELSE 0 END AS bin, count(*) AS n
           FROM predictions, bounds WHERE fraud_probability IS NOT NULL GROUP BY 1) c ON c.bin = r.bin""", extra=[
    ("bounds", "SELECT min(CAST(fraud_probability AS DOUBLE)) AS lo, max(CAST(fraud_probability AS DOUBLE)) AS hi "
               "FROM predictions")]))
def q_probability_histogram(spark, sf):
    return mt.probability_histogram(op.predictions_table(spark, sf), "fraud_probability")


@register("business_value", with_views(["scored_labels"], """SELECT avg_suspicious_amount, flagged_cases,
  CAST(flagged_cases AS DOUBLE) * avg_suspicious_amount * CAST(0.6 AS DOUBLE) AS potential_savings,
  flagged_cases * 30 AS review_minutes
FROM (SELECT CAST(sum(CASE WHEN risk_level IN ('High Risk', 'Critical Risk') THEN claim_amount END) AS DOUBLE)
        / CAST(nullif(count(CASE WHEN risk_level IN ('High Risk', 'Critical Risk') THEN 1 END), 0) AS DOUBLE)
        AS avg_suspicious_amount,
      count(CASE WHEN score >= 0.8 THEN 1 END) AS flagged_cases FROM scored_labels) t"""))
def q_business_value(spark, sf):
    return mt.business_value(scored_labels(spark, sf), "risk_level", "claim_amount", "score")


@register("business_metrics", with_views(["scored_labels", "cum_desc"], "\nUNION ALL\n".join(
    f"""SELECT CAST({t} AS DOUBLE) AS threshold, {sdiv(f'tp{i}', f'f{i}')} AS precision, {sdiv(f'tp{i}', 'p')} AS recall,
  {sdiv(f'f{i}', 'n')} AS flagged_rate, ap.average_precision FROM agg, ap"""
    for i, t in enumerate((0.5, 0.7, 0.8, 0.9))), extra=[
    ("agg", "SELECT count(*) AS n, count(CASE WHEN label = 1 THEN 1 END) AS p, " + ", ".join(
        f"count(CASE WHEN score >= {t} AND label = 1 THEN 1 END) AS tp{i}, count(CASE WHEN score >= {t} THEN 1 END) AS f{i}"
        for i, t in enumerate((0.5, 0.7, 0.8, 0.9))) + " FROM scored_labels"),
    ("ap", "SELECT round(sum(CAST(pos AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)) / "
           "CAST(sum(pos) AS DOUBLE), 12) AS average_precision FROM cum_desc")]))
def q_business_metrics(spark, sf):
    return mt.business_metrics(scored_labels(spark, sf), "label", "score")


@register("class_weight", with_views(["scored_labels"], """SELECT n0, n1,
  CAST(n0 AS DOUBLE) / CAST(nullif(n1, 0) AS DOUBLE) AS scale_pos_weight
FROM (SELECT count(CASE WHEN label = 0 THEN 1 END) AS n0, count(CASE WHEN label = 1 THEN 1 END) AS n1
      FROM scored_labels) t"""))
def q_class_weight(spark, sf):
    return mt.class_weight(scored_labels(spark, sf), "label")


@register("class_distribution", with_views(["scored_labels"], """SELECT label, count(*) AS count,
  CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM scored_labels) AS DOUBLE) AS share
FROM scored_labels GROUP BY label"""))
def q_class_distribution(spark, sf):
    return mt.class_distribution(scored_labels(spark, sf), "label")


@register("class_balance_check", with_views(["scored_labels"], """SELECT positive_rate,
  (positive_rate < 0.05 OR positive_rate > 0.95) AS severe_imbalance
FROM (SELECT CAST(count(CASE WHEN label = 1 THEN 1 END) AS DOUBLE) / CAST(nullif(count(label), 0) AS DOUBLE)
      AS positive_rate FROM scored_labels) t"""))
def q_class_balance_check(spark, sf):
    return mt.class_balance_check(scored_labels(spark, sf), "label")


_RECALL_AT = "score >= 0.5"
_BASELINE_AT = "claim_amount >= 50000"


@register("recall_goal_check", with_views(["scored_labels"], f"""SELECT recall, recall - base AS improvement,
  recall >= 0.65 AS meets_minimum, recall >= 0.75 AS meets_stretch
FROM (SELECT {sdiv('tp', 'p')} AS recall, {sdiv('btp', 'p')} AS base
      FROM (SELECT count(CASE WHEN label = 1 THEN 1 END) AS p, count(CASE WHEN label = 1 AND {_RECALL_AT} THEN 1 END) AS tp,
                   count(CASE WHEN label = 1 AND {_BASELINE_AT} THEN 1 END) AS btp FROM scored_labels) c) t"""))
def q_recall_goal_check(spark, sf):
    """The rule score's recall against the goals and against a plain amount limit as the baseline."""
    fraud = F.col("label") == 1
    counts = scored_labels(spark, sf).agg(mt.count_if(fraud).alias("p"),
                                          mt.count_if(fraud & F.expr(_RECALL_AT)).alias("tp"),
                                          mt.count_if(fraud & F.expr(_BASELINE_AT)).alias("btp"))
    recalls = counts.select(mt.safe_div(F.col("tp"), F.col("p")).alias("recall"),
                            mt.safe_div(F.col("btp"), F.col("p")).alias("base"))
    return mt.recall_goal_check(recalls, F.col("base"))


# --- multi-model leaderboard ----------------------------------------------------------------------

def _models(spark, sf) -> DataFrame:
    s = scored_labels(spark, sf)
    amount = F.least(F.col("claim_amount").cast("double") / F.lit(100000.0), F.lit(1.0))
    return s.select("claim_id", "label", F.explode(F.array(
        F.struct(F.lit("rule").alias("model"), F.col("score").alias("score")),
        F.struct(F.lit("amount").alias("model"), amount.alias("score")))).alias("m")) \
        .select("claim_id", "label", "m.model", "m.score")


VIEWS["model_scores"] = (["scored_labels"], """SELECT claim_id, label, 'rule' AS model, score FROM scored_labels
UNION ALL SELECT claim_id, label, 'amount', least(CAST(claim_amount AS DOUBLE) / 100000.0, 1.0) FROM scored_labels""")


@register("leaderboard", with_views(["model_scores"], f"""SELECT a.model, a.roc_auc, m.precision, m.recall, m.f1,
  m.tp AS caught, m.fn AS missed
FROM (SELECT model, CAST(sum(CAST(pos AS HUGEINT) * (2 * negle - neg)) AS DOUBLE)
        / (2.0 * CAST(sum(neg) AS DOUBLE) * CAST(sum(pos) AS DOUBLE)) AS roc_auc
      FROM (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  AS negle
            FROM (SELECT model, score, count(CASE WHEN label = 1 THEN 1 END) AS pos,
                         count(CASE WHEN label = 0 THEN 1 END) AS neg FROM model_scores GROUP BY model, score) x) y
      GROUP BY model) a
JOIN (SELECT model, tp, fn, {_METRICS} FROM (SELECT model, {_CM} FROM model_scores GROUP BY model) c) m USING (model)
ORDER BY a.roc_auc DESC, a.model"""))
def q_leaderboard(spark, sf):
    return mt.leaderboard(_models(spark, sf), "label", "score")


@register("select_best_scores", with_views(["model_scores"], """SELECT model AS best_model, roc_auc AS best_mean_auc
FROM (SELECT model, CAST(sum(CAST(pos AS HUGEINT) * (2 * negle - neg)) AS DOUBLE)
        / (2.0 * CAST(sum(neg) AS DOUBLE) * CAST(sum(pos) AS DOUBLE)) AS roc_auc
      FROM (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  AS negle
            FROM (SELECT model, score, count(CASE WHEN label = 1 THEN 1 END) AS pos,
                         count(CASE WHEN label = 0 THEN 1 END) AS neg FROM model_scores GROUP BY model, score) x) y
      GROUP BY model) a ORDER BY roc_auc DESC, model DESC LIMIT 1"""))
def q_select_best_scores(spark, sf):
    """M17 over the AUCs of the two score columns."""
    aucs = mt.roc_auc(_models(spark, sf), "label", "score", ("model",)).select("model", F.col("roc_auc").alias("value"))
    return ml.select_best_model(aucs)


# --- splits, folds, samples (M1, M2, M7) and CV summary (A32) ------------------------------------

_RANKED = """SELECT claim_id, label,
  row_number() OVER (PARTITION BY label ORDER BY md5(claim_id || ':42')) AS r,
  count(*) OVER (PARTITION BY label) AS n_label FROM scored_labels"""


@register("stratified_split", with_views(["scored_labels"], """SELECT claim_id, label,
  CASE WHEN r <= CAST(floor(n_label * 0.2 + 0.5) AS BIGINT) THEN 'test' ELSE 'train' END AS split
FROM ranked""", extra=[("ranked", _RANKED)]))
def q_stratified_split(spark, sf):
    s = _labels_table(spark, sf).select("claim_id", "label")
    return ml.stratified_split(s, "label", "claim_id", test_fraction=0.2).select("claim_id", "label", "split")


@register("stratified_split_70", with_views(["scored_labels"], """SELECT claim_id, label,
  CASE WHEN r <= CAST(floor(n_label * 0.3 + 0.5) AS BIGINT) THEN 'test' ELSE 'train' END AS split
FROM ranked""", extra=[("ranked", _RANKED)]))
def q_stratified_split_70(spark, sf):
    """M1, 70/30."""
    s = _labels_table(spark, sf).select("claim_id", "label")
    return ml.stratified_split(s, "label", "claim_id", test_fraction=0.3).select("claim_id", "label", "split")


@register("nested_split", with_views(["scored_labels"], """SELECT claim_id, label, CASE WHEN r <= n_test THEN 'test'
  WHEN r2 <= CAST(floor((n_label - n_test) * 0.2 + 0.5) AS BIGINT) THEN 'validation' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY label, r <= n_test ORDER BY md5(claim_id || ':43')) AS r2
      FROM (SELECT *, CAST(floor(n_label * 0.2 + 0.5) AS BIGINT) AS n_test FROM ranked) a) b""", extra=[("ranked", _RANKED)]))
def q_nested_split(spark, sf):
    """M1, 80/20 and 80/20 of the rest: train, validation, test."""
    s = materialize(_labels_table(spark, sf).select("claim_id", "label"), "split_labels")
    return ml.nested_split(s, "label", "claim_id").select("claim_id", "label", "split")


@register("stratified_kfold", with_views(["scored_labels"], """SELECT claim_id, label,
  CAST((r - 1) % 5 AS INTEGER) AS fold FROM ranked""", extra=[("ranked", _RANKED)]))
def q_stratified_kfold(spark, sf):
    s = _labels_table(spark, sf).select("claim_id", "label")
    return ml.stratified_kfold(s, "label", "claim_id", k=5).select("claim_id", "label", "fold")


@register("sample_rows", with_views(["scored_labels"], """SELECT claim_id, label, score FROM scored_labels
ORDER BY md5(claim_id || ':42') LIMIT 1000"""))
def q_sample_rows(spark, sf):
    return ml.hash_sample(scored_labels(spark, sf).select("claim_id", "label", "score"), "claim_id", 1000)


@register("cv_summary", with_views(["scored_labels"], """SELECT 'rule' AS model, 'roc_auc' AS metric,
  round(avg(auc), 12) AS mean, round(stddev_pop(auc), 12) AS std, count(auc) AS folds
FROM (SELECT fold, CAST(sum(CAST(pos AS HUGEINT) * (2 * negle - neg)) AS DOUBLE)
        / (2.0 * CAST(sum(neg) AS DOUBLE) * CAST(sum(pos) AS DOUBLE)) AS auc
      FROM (SELECT *, sum(neg) OVER (PARTITION BY fold ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS negle
            FROM (SELECT fold, score, count(CASE WHEN label = 1 THEN 1 END) AS pos, count(CASE WHEN label = 0 THEN 1 END) AS neg
                  FROM (SELECT s.*, CAST((r - 1) % 5 AS INTEGER) AS fold FROM scored_labels s JOIN ranked USING (claim_id)) f
                  GROUP BY fold, score) x) y
      GROUP BY fold) t""", extra=[("ranked", _RANKED)]))
def q_cv_summary(spark, sf):
    folds = ml.stratified_kfold(_labels_table(spark, sf), "label", "claim_id", k=5)
    per_fold = mt.roc_auc(folds, "label", "score", ("fold",)).select(
        F.lit("rule").alias("model"), F.lit("roc_auc").alias("metric"), "fold", F.col("roc_auc").alias("value"))
    out = mt.cv_summary(per_fold)
    return out.select("model", "metric", F.round("mean", 12).alias("mean"), F.round("std", 12).alias("std"), "folds")


# --- profiling (A12-A17, P32, P33, W1) ------------------------------------------------------------

# Column order of the merged claim table (key of each left join first, as Spark's USING join emits).
MERGED_COLUMNS = ["BeneID", "Provider", "PotentialFraud", "ClaimID", "InscClaimAmtReimbursed", "DeductibleAmtPaid",
                  "AdmissionDt", "DischargeDt", "ClaimStartDt", "ClaimEndDt", "DOB", "DOD", "Gender", "Race", "State",
                  "County", "RenalDiseaseIndicator", "NoOfMonths_PartACov", "NoOfMonths_PartBCov",
                  *[f"ChronicCond_{c}" for c in CHRONIC_CONDITIONS],
                  "IPAnnualReimbursementAmt", "IPAnnualDeductibleAmt", "OPAnnualReimbursementAmt",
                  "OPAnnualDeductibleAmt"]


@register("null_profile", with_views(["merged"], "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count FROM merged" for c in MERGED_COLUMNS)))
def q_null_profile(spark, sf):
    return pf.null_profile(pl.merged_claims(spark, sf))


@register("table_profile", with_views(["merged"], "SELECT column_name, position, (SELECT count(*) FROM merged) AS row_count, "
                                      f"{len(MERGED_COLUMNS)} AS column_count FROM (VALUES "
                                      + ", ".join(f"('{c}', {i + 1})" for i, c in enumerate(MERGED_COLUMNS))
                                      + ") t(column_name, position)"))
def q_table_profile(spark, sf):
    """Row and column counts and column positions (types are engine-specific names: see operator)."""
    return pf.table_profile(pl.merged_claims(spark, sf)).drop("data_type")


@register("cardinality_profile", with_views(["merged"], """SELECT column_name, count(DISTINCT value) AS distinct_values
FROM (UNPIVOT (SELECT ClaimID, Provider, BeneID, PotentialFraud, RenalDiseaseIndicator FROM merged)
      ON ClaimID, Provider, BeneID, PotentialFraud, RenalDiseaseIndicator INTO NAME column_name VALUE value) t
GROUP BY column_name"""))
def q_cardinality_profile(spark, sf):
    return pf.cardinality_profile(pl.merged_claims(spark, sf))


CONTRAST_FEATURES = [c for c in FINAL_FEATURES if c != "PotentialFraud"]
# Doubles are summed as decimals of six places on both engines; the queries present nine digits of ratios and
# statistics and six of means: a mean in the millions has sixteen digits at nine places, the end of a double.
DOUBLE_FEATURES = ("CostPerCondition", "ClaimAmountLog", "DeductibleRatio", "AgeRiskGroup", "PartBCoverageRatio",
                   "IPMonthlyAvg", "OPMonthlyAvg", "RaceRiskGroup")
_CONTRAST_FT = ("SELECT coalesce(PotentialFraud, 0) AS PotentialFraud, " + ", ".join(
    f"CAST(coalesce({c}, 0) AS DECIMAL(18,6)) AS {c}" if c in DOUBLE_FEATURES else f"coalesce({c}, 0) AS {c}"
    for c in CONTRAST_FEATURES) + " FROM featured")


MEANS = ("fraud_avg", "normal_avg", "fraud_mean", "normal_mean")


def _digits(df, *cols):
    return df.select(*[F.round(c, 6 if c in MEANS else 9).alias(c) if c in cols else F.col(c) for c in df.columns])


_LC_BODY = """SELECT feature, round(fraud_avg, 6) AS fraud_avg, round(normal_avg, 6) AS normal_avg,
  round(fraud_avg / normal_avg, 9) AS ratio,
  CASE WHEN fraud_avg / normal_avg > 1.5 THEN 'higher' WHEN fraud_avg / normal_avg < 0.7 THEN 'lower'
       ELSE 'similar' END AS band
FROM means WHERE normal_avg <> 0"""


def _contrast_sql(body: str) -> str:
    unions = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, CAST(sum(CASE WHEN PotentialFraud = 1 THEN {c} END) AS DOUBLE) "
        f"/ CAST(nullif(count(CASE WHEN PotentialFraud = 1 THEN {c} END), 0) AS DOUBLE) AS fraud_avg, "
        f"CAST(sum(CASE WHEN PotentialFraud = 0 THEN {c} END) AS DOUBLE) "
        f"/ CAST(nullif(count(CASE WHEN PotentialFraud = 0 THEN {c} END), 0) AS DOUBLE) AS normal_avg FROM ft"
        for c in CONTRAST_FEATURES)
    return with_views(["featured"], body, extra=[("ft", _CONTRAST_FT), ("means", unions)])


@register("label_contrast", _contrast_sql(_LC_BODY + " ORDER BY ratio DESC, feature"))
def q_label_contrast(spark, sf):
    ft = pl.feature_table(spark, sf)
    return _digits(pf.label_contrast(ft, "PotentialFraud", CONTRAST_FEATURES), "fraud_avg", "normal_avg", "ratio")


def _any(needles) -> str:
    return " OR ".join(f"contains(feature, '{n}')" for n in needles)


_CATEGORY_SQL = "CASE " + " ".join(f"WHEN {_any(needles)} THEN '{cat}'" for cat, needles in FEATURE_CATEGORIES) \
    + f" ELSE '{FEATURE_CATEGORY_DEFAULT}' END"


@register("feature_category", _contrast_sql(f"SELECT *, {_CATEGORY_SQL} AS category FROM ({_LC_BODY}) t"))
def q_feature_category(spark, sf):
    lc = q_label_contrast(spark, sf)
    return lc.withColumn("category", rules.feature_category(F.col("feature")))


@register("feature_name_regex", _contrast_sql(
    f"SELECT count(*) AS matching_features, round(sum(ratio), 9) AS ratio_sum FROM ({_LC_BODY}) t "
    f"WHERE regexp_matches(feature, '{REPORT_FEATURE_PATTERN}')"))
def q_feature_name_regex(spark, sf):
    lc = q_label_contrast(spark, sf)
    return pf.feature_name_regex(lc, "feature", REPORT_FEATURE_PATTERN, "ratio", digits=9)


@register("rank_rows", with_views(["claims", "predictions", "investigations"], """SELECT
  CAST(row_number() OVER (ORDER BY total_claim_amount DESC, provider_id) AS INTEGER) AS rank, provider_id,
  total_claim_amount
FROM (SELECT c.provider_id, CAST(sum(c.claim_amount) AS DECIMAL(22,2)) AS total_claim_amount
      FROM claims c LEFT JOIN predictions fp ON c.claim_id = fp.claim_id
      LEFT JOIN investigations i ON c.claim_id = i.claim_id GROUP BY c.provider_id) t
ORDER BY rank LIMIT 10"""))
def q_rank_rows(spark, sf):
    ps = dash.provider_statistics(*op.operational_tables(spark, sf, ("provider_id",)))
    top = ps.orderBy(F.col("total_claim_amount").desc(), "provider_id").limit(10)
    # Window over a ten-row result: bounded, so a global order here is safe.
    w = Window.orderBy(F.col("total_claim_amount").desc(), "provider_id")
    return top.select(F.row_number().over(w).alias("rank"), "provider_id", "total_claim_amount")


@register("label_date_spread", with_views(["merged"], """SELECT PotentialFraud AS label, min(d) AS min_day,
  round(quantile_cont(d, 0.25), 6) AS q1_day, round(quantile_cont(d, 0.5), 6) AS median_day,
  round(quantile_cont(d, 0.75), 6) AS q3_day, max(d) AS max_day
FROM (SELECT PotentialFraud, CAST(date_diff('day', DATE '1970-01-01', ClaimEndDt) AS INTEGER) AS d FROM merged
      WHERE ClaimEndDt IS NOT NULL) t GROUP BY PotentialFraud"""))
def q_label_date_spread(spark, sf):
    return pf.label_date_spread(pl.merged_claims(spark, sf), "PotentialFraud", "ClaimEndDt")


def _ttest_sql() -> str:
    def agg(c):
        parts = []
        for g in (1, 0):
            v = f"CASE WHEN PotentialFraud = {g} THEN {c} END"
            wide = f"CAST({v} AS DECIMAL(26,6))" if c in DOUBLE_FEATURES else v
            n, s, q = f"count({v})", f"sum({v})", f"sum({wide} * {wide})"
            if c in DOUBLE_FEATURES:
                var = (f"(CAST({q} AS DOUBLE) - CAST({s} AS DOUBLE) * CAST({s} AS DOUBLE) / CAST(nullif({n}, 0) AS DOUBLE)) "
                       f"/ CAST(nullif({n} - 1, 0) AS DOUBLE)")
            else:
                var = (f"CAST(CAST({n} AS DECIMAL(20,0)) * {q} - {s} * {s} AS DOUBLE) "
                       f"/ CAST(nullif({n} * ({n} - 1), 0) AS DOUBLE)")
            parts += [f"{n} AS n{g}", f"CAST({s} AS DOUBLE) / CAST(nullif({n}, 0) AS DOUBLE) AS m{g}", f"{var} AS v{g}"]
        return f"SELECT '{c}' AS feature, " + ", ".join(parts) + " FROM ft"
    unions = "\nUNION ALL\n".join(agg(c) for c in CONTRAST_FEATURES)
    ratio = "CASE WHEN m0 <> 0 THEN m1 / m0 WHEN m1 <> 0 THEN m1 ELSE 1.0 END"
    body = f"""SELECT feature, round(m1, 6) AS fraud_mean, round(m0, 6) AS normal_mean, round(ratio, 9) AS ratio,
  round((m1 - m0) / nullif(sqrt(sp2 * (1.0 / CAST(n1 AS DOUBLE) + 1.0 / CAST(n0 AS DOUBLE))), 0), 9) AS t_stat, dof,
  CASE WHEN ratio > 2 THEN 'much_higher' WHEN ratio < 0.5 THEN 'much_lower' ELSE 'moderate' END AS band
FROM (SELECT *, (CAST(n1 - 1 AS DOUBLE) * v1 + CAST(n0 - 1 AS DOUBLE) * v0) / CAST(nullif(dof, 0) AS DOUBLE) AS sp2
      FROM (SELECT *, n1 + n0 - 2 AS dof, CAST({ratio} AS DOUBLE) AS ratio FROM sums) a) b"""
    return with_views(["featured"], body, extra=[("ft", _CONTRAST_FT), ("sums", unions)])


@register("label_ttest", _ttest_sql())
def q_label_ttest(spark, sf):
    """Pooled two-sample t statistic and degrees of freedom per feature (p-value: label_ttest_pvalue)."""
    ft = pl.feature_table(spark, sf)
    out = pf.label_ttest(ft, "PotentialFraud", CONTRAST_FEATURES, with_p=False)
    return _digits(out, "fraud_mean", "normal_mean", "ratio", "t_stat")


@register("label_ttest_pvalue", None)
def q_label_ttest_pvalue(spark, sf):
    ft = pl.feature_table(spark, sf)
    return pf.label_ttest(ft, "PotentialFraud", CONTRAST_FEATURES).select("feature", "t_stat", "dof", "p_value",
                                                                          "significant")


@register("union_results", with_views(["model_scores"], f"""SELECT 'rule' AS model, {_METRICS}, tp, fp, fn, tn
FROM (SELECT {_CM} FROM model_scores WHERE model = 'rule') c
UNION ALL
SELECT 'amount' AS model, {_METRICS}, tp, fp, fn, tn
FROM (SELECT {_CM} FROM model_scores WHERE model = 'amount') c"""))
def q_union_results(spark, sf):
    """Two models' result sets computed separately, merged by name."""
    from claimlens.operators import relational as rel
    m = _models(spark, sf)
    parts = [mt.classification_metrics(m.where(F.col("model") == name), "label", "score")
             .select(F.lit(name).alias("model"), "*") for name in ("rule", "amount")]
    return rel.union_results(*parts)
