"""Model-evaluation and business metrics over (label, score[, group]) rows.

Curve metrics first collapse to one row per distinct score (a hash aggregate
with map-side combine), then take running sums with the range-partitioned
``prefix_sums`` helper, so no step puts the table into one task. Counts are
exact integers; AUC is an exact rank-sum divided once in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.config import (BALANCE_BAND, BUSINESS_METRIC_THRESHOLDS, FLAG_THRESHOLD, MINUTES_PER_CASE,
                              RECALL_MINIMUM, RECALL_STRETCH, RECOVERY_RATE, THRESHOLD_POLICIES)
from claimlens.operators.ranking import prefix_sums
from claimlens.sources.materialize import materialize


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def safe_div(a: Column, b: Column) -> Column:
    """a / b in double; 0 when b is 0 (a zero-division guard, as the reports use)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _stack(row: DataFrame, names: list[str], cols: list[list[Column]], out: list[str]) -> DataFrame:
    """Turn one wide row into len(names) rows without a join (an inline array explode)."""
    structs = [F.struct(F.lit(n).alias("__name"), *[c.alias(o) for c, o in zip(cs, out)]) for n, cs in zip(names, cols)]
    return row.select(F.inline(F.array(*structs)))


# A11
def class_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1)).alias("__n")).withColumn("__k", F.lit(1))
    return (counts.withColumn("__k", F.lit(1)).join(F.broadcast(total), "__k")
            .select(label, "count", (F.col("count") / F.col("__n")).alias("share")))


# A18
def business_value(df: DataFrame, level: str, amount: str, score: str) -> DataFrame:
    hi = _c(level).isin("High Risk", "Critical Risk")
    flagged = count_if(_c(score) >= FLAG_THRESHOLD)
    avg_hi = F.try_divide(F.sum(F.when(hi, _c(amount))).cast("double"), count_if(hi).cast("double"))
    return (df.agg(avg_hi.alias("avg_suspicious_amount"), flagged.alias("flagged_cases"))
              .select("avg_suspicious_amount", "flagged_cases",
                      (F.col("flagged_cases") * F.col("avg_suspicious_amount") * float(RECOVERY_RATE))
                      .alias("potential_savings"),
                      (F.col("flagged_cases") * MINUTES_PER_CASE).alias("review_minutes")))


# A19
def threshold_policy(df: DataFrame, score: str) -> DataFrame:
    s = _c(score)
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[count_if(s >= t).alias(f"__c{i}") for i, (_, t, _) in enumerate(THRESHOLD_POLICIES)])
    cols = [[F.lit(t), F.col(f"__c{i}"), safe_div(F.col(f"__c{i}"), F.col("__n")), F.lit(u),
             F.col(f"__c{i}") * MINUTES_PER_CASE / 60.0]
            for i, (_, t, u) in enumerate(THRESHOLD_POLICIES)]
    out = _stack(row, [n for n, _, _ in THRESHOLD_POLICIES], cols,
                 ["threshold", "fraud_count", "fraud_rate", "use_case", "workload_hours"])
    return out.withColumnRenamed("__name", "policy")


# A20
def probability_summary(df: DataFrame, score: str) -> DataFrame:
    s = _c(score)
    return df.agg(F.count(s).alias("total"),
                  F.try_divide(F.sum(s).cast("double"), F.count(s).cast("double")).alias("mean_probability"),
                  count_if(s >= 0.9).alias("high_confidence"),
                  count_if((s >= 0.7) & (s < 0.9)).alias("medium_confidence"),
                  count_if(s < 0.3).alias("low_risk"))


# A21
TIERS_4 = (("Low Risk", 1), ("Medium Risk", 2), ("High Risk", 3), ("Critical Risk", 4))


def risk_distribution(df: DataFrame, score: str) -> DataFrame:
    s = _c(score)
    row = df.agg(count_if(s < 0.6).alias("c1"), count_if((s >= 0.6) & (s < 0.8)).alias("c2"),
                 count_if((s >= 0.8) & (s < 0.95)).alias("c3"), count_if(s >= 0.95).alias("c4"))
    out = _stack(row, [t for t, _ in TIERS_4], [[F.lit(o), F.col(f"c{o}")] for _, o in TIERS_4], ["tier_order", "count"])
    return out.withColumnRenamed("__name", "risk_level")


# A22
def probability_histogram(df: DataFrame, score: str, bins: int = 50) -> DataFrame:
    """Counts of ``bins`` equal bins between the least and the greatest score; empty bins count 0."""
    s = _c(score).cast("double")
    lo, hi = df.agg(F.min(s), F.max(s)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, count bigint")
    width = (hi - lo) / bins
    b = F.least(F.floor((s - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
    counts = df.where(s.isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("__n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(hi - lo) / bins).alias("bin_start"),
        F.coalesce("__n", F.lit(0)).alias("count"))


# A23
def confusion_matrix(df: DataFrame, label: str, pred: Column, group: tuple[str, ...] = ()) -> DataFrame:
    y = _c(label)
    aggs = [count_if((y == 0) & ~pred).alias("tn"), count_if((y == 0) & pred).alias("fp"),
            count_if((y == 1) & ~pred).alias("fn"), count_if((y == 1) & pred).alias("tp")]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


# A24
def metrics_from_counts(cm: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    p = safe_div(tp, tp + fp)
    r = safe_div(tp, tp + fn)
    return cm.select("*", safe_div(tp + tn, n).alias("accuracy"), p.alias("precision"), r.alias("recall"),
                     F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"),
                     safe_div(tp + fp, n).alias("predicted_rate"), safe_div(tp + fn, n).alias("actual_rate"))


def classification_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5,
                           group: tuple[str, ...] = ()) -> DataFrame:
    return metrics_from_counts(confusion_matrix(df, label, _c(score) >= threshold, group))


def class_report(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Per-class precision / recall / F1 / support (class 0 treats 'negative' as the positive side)."""
    cm = confusion_matrix(df, label, _c(score) >= threshold)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def cls(pos_tp, pos_fp, pos_fn):
        p, r = safe_div(pos_tp, pos_tp + pos_fp), safe_div(pos_tp, pos_tp + pos_fn)
        return [p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)), pos_tp + pos_fn]
    out = _stack(cm, ["0", "1"], [cls(tn, fn, fp), cls(tp, fp, fn)], ["precision", "recall", "f1", "support"])
    return out.select(F.col("__name").cast("int").alias("class"), "precision", "recall", "f1", "support")


# per-distinct-score counts and running sums
def score_counts(df: DataFrame, label: str, score: str, group: tuple[str, ...] = ()) -> DataFrame:
    """One row per (group, distinct score) with positive/negative counts, written once.

    The table is bounded by the number of distinct scores; writing it means the
    scan/join chain behind ``df`` runs once although the curve helpers read the
    counts several times (slice bounds, running sums, totals)."""
    y = _c(label)
    counts = (df.where(_c(score).isNotNull() & y.isin(0, 1))
                .groupBy(*group, _c(score).cast("double").alias("score"))
                .agg(count_if(y == 1).cast("bigint").alias("pos"), count_if(y == 0).cast("bigint").alias("neg")))
    return materialize(counts, "score_counts")


def _desc_cumulative(c: DataFrame, group: tuple[str, ...]) -> DataFrame:
    return prefix_sums(c, ["score"], {"tp": F.col("pos"), "fp": F.col("neg")}, group, descending=True)


def _totals(c: DataFrame, group: tuple[str, ...]) -> DataFrame:
    return c.groupBy(*group).agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))


# A25
def roc_curve(df: DataFrame, label: str, score: str, group: tuple[str, ...] = ()) -> DataFrame:
    c = score_counts(df, label, score, group)
    cum, tot = _desc_cumulative(c, group), _totals(c, group)
    if group:
        j = cum.join(tot, list(group), "inner")
    else:
        j = cum.withColumn("__k", F.lit(1)).join(F.broadcast(tot.withColumn("__k", F.lit(1))), "__k")
    return j.select(*group, F.col("score").alias("threshold"), "tp", "fp",
                    safe_div(F.col("tp"), F.col("n1")).alias("tpr"), safe_div(F.col("fp"), F.col("n0")).alias("fpr"))


# A26
def roc_auc(df: DataFrame, label: str, score: str, group: tuple[str, ...] = ()) -> DataFrame:
    """AUC with ties counted half: sum_s pos(s) * (2 * neg(<= s) - neg(s)) / (2 n0 n1)."""
    c = score_counts(df, label, score, group)
    cum = prefix_sums(c, ["score"], {"negle": F.col("neg")}, group)
    term = F.col("pos").cast("decimal(20,0)") * (2 * F.col("negle") - F.col("neg")).cast("decimal(20,0)")
    agg = [F.sum(term).alias("__num"), F.sum("pos").alias("n1"), F.sum("neg").alias("n0")]
    g = cum.groupBy(*group).agg(*agg) if group else cum.agg(*agg)
    return g.select(*group, F.try_divide(F.col("__num").cast("double"),
                                         (F.lit(2.0) * F.col("n0").cast("double") * F.col("n1").cast("double")))
                    .alias("roc_auc"), "n1", "n0")


# A27
def average_precision(df: DataFrame, label: str, score: str, group: tuple[str, ...] = (),
                      digits: int | None = 12) -> DataFrame:
    """Step-wise PR-AUC: sum over thresholds of (R_k - R_{k-1}) * P_k.

    The per-threshold terms are exact ratios; their double sum depends on
    summation order in the last bits, so the result is rounded to ``digits``."""
    cum = _desc_cumulative(score_counts(df, label, score, group), group)
    term = F.col("pos").cast("double") * F.col("tp").cast("double") / (F.col("tp") + F.col("fp")).cast("double")
    agg = [F.sum(term).alias("__s"), F.sum("pos").alias("n1")]
    g = cum.groupBy(*group).agg(*agg) if group else cum.agg(*agg)
    ap = F.try_divide(F.col("__s"), F.col("n1").cast("double"))
    return g.select(*group, (F.round(ap, digits) if digits is not None else ap).alias("average_precision"))


# A28
def best_f1_threshold(df: DataFrame, label: str, score: str, default: float = 0.5) -> DataFrame:
    c = score_counts(df, label, score, ())
    cum, tot = _desc_cumulative(c, ()), _totals(c, ()).withColumn("__k", F.lit(1))
    j = cum.withColumn("__k", F.lit(1)).join(F.broadcast(tot), "__k")
    p = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = safe_div(F.col("tp"), F.col("n1"))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    best = (j.select(F.struct(f1.alias("f1"), (-F.col("score")).alias("neg_t"), p.alias("p"), r.alias("r")).alias("b"))
             .agg(F.max("b").alias("b"))
             .select((-F.col("b.neg_t")).alias("best_threshold"), F.col("b.f1").alias("best_f1"),
                     F.col("b.p").alias("best_precision"), F.col("b.r").alias("best_recall")))
    d = classification_metrics(df, label, score, default).select(
        F.col("precision").alias("default_precision"), F.col("recall").alias("default_recall"))
    return best.withColumn("__k", F.lit(1)).join(d.withColumn("__k", F.lit(1)), "__k").drop("__k")


def apply_threshold(df: DataFrame, score: str, threshold: Column | float, out: str = "prediction") -> DataFrame:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return df.withColumn(out, (_c(score) >= t).cast("int"))


# A29
def business_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    y, s = _c(label), _c(score)
    aggs = [F.count(F.lit(1)).alias("__n"), count_if(y == 1).alias("__p")]
    for i, t in enumerate(BUSINESS_METRIC_THRESHOLDS):
        aggs += [count_if((s >= t) & (y == 1)).alias(f"__tp{i}"), count_if(s >= t).alias(f"__f{i}")]
    row = df.agg(*aggs)
    cols = [[F.lit(t), safe_div(F.col(f"__tp{i}"), F.col(f"__f{i}")), safe_div(F.col(f"__tp{i}"), F.col("__p")),
             safe_div(F.col(f"__f{i}"), F.col("__n"))] for i, t in enumerate(BUSINESS_METRIC_THRESHOLDS)]
    out = _stack(row, [f"t{t}" for t in BUSINESS_METRIC_THRESHOLDS], cols,
                 ["threshold", "precision", "recall", "flagged_rate"]).drop("__name")
    ap = average_precision(df, label, score)
    return out.withColumn("__k", F.lit(1)).join(F.broadcast(ap.withColumn("__k", F.lit(1))), "__k").drop("__k")


# A30
def class_weight(df: DataFrame, label: str) -> DataFrame:
    y = _c(label)
    return df.agg(count_if(y == 0).alias("n0"), count_if(y == 1).alias("n1")) \
             .select("n0", "n1", F.try_divide(F.col("n0").cast("double"), F.col("n1").cast("double"))
                     .alias("scale_pos_weight"))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Positive rows weighted n0/n1, negatives 1 (MLlib ``weightCol``)."""
    w = class_weight(df, label).select("scale_pos_weight").withColumn("__k", F.lit(1))
    j = df.withColumn("__k", F.lit(1)).join(F.broadcast(w), "__k").drop("__k")
    return j.withColumn(out, F.when(_c(label) == 1, F.col("scale_pos_weight")).otherwise(F.lit(1.0))) \
            .drop("scale_pos_weight")


# A32
def cv_summary(results: DataFrame, metric_col: str = "value", group: tuple[str, ...] = ("model", "metric")) -> DataFrame:
    v = _c(metric_col)
    return results.groupBy(*group).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
                                       F.count(v).alias("folds"))


# A33
def leaderboard(df: DataFrame, label: str, score: str, model: str = "model", threshold: float = 0.5) -> DataFrame:
    auc = roc_auc(df, label, score, (model,)).select(model, "roc_auc")
    m = classification_metrics(df, label, score, threshold, (model,))
    return (m.join(auc, model).select(model, "roc_auc", "precision", "recall", "f1",
                                      F.col("tp").alias("caught"), F.col("fn").alias("missed"))
             .orderBy(F.col("roc_auc").desc(), F.col(model)))


# A34
def recall_goal_check(metrics: DataFrame, baseline_recall: Column | float | None = None) -> DataFrame:
    """Recall against the goals and, where given (a number or a column of ``metrics``), a baseline's recall."""
    r = F.col("recall")
    base = (baseline_recall if isinstance(baseline_recall, Column) else F.lit(baseline_recall)).cast("double")
    return metrics.select("recall", (r - base).alias("improvement"),
                          (r >= RECALL_MINIMUM).alias("meets_minimum"), (r >= RECALL_STRETCH).alias("meets_stretch"))


# A35
def class_balance_check(df: DataFrame, label: str) -> DataFrame:
    y = _c(label)
    lo, hi = BALANCE_BAND
    return (df.agg(F.try_divide(count_if(y == 1).cast("double"), F.count(y).cast("double")).alias("positive_rate"))
              .select("positive_rate", ((F.col("positive_rate") < lo) | (F.col("positive_rate") > hi))
                      .alias("severe_imbalance")))


def with_balanced_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Class-balanced weights n / (2 * n_class) for each row (MLlib ``weightCol``)."""
    y = _c(label)
    c = class_weight(df, label).select("n0", "n1").withColumn("__k", F.lit(1))
    j = df.withColumn("__k", F.lit(1)).join(F.broadcast(c), "__k").drop("__k")
    n = (F.col("n0") + F.col("n1")).cast("double")
    w = F.when(y == 1, F.try_divide(n, 2.0 * F.col("n1"))).otherwise(F.try_divide(n, 2.0 * F.col("n0")))
    return j.withColumn(out, w).drop("n0", "n1")
