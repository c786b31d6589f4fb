"""Registered model-pipeline queries.

These are rows-only checks (model outputs are not SQL-expressible). Every query
trains on the feature table built from the driver tables; splits are the
deterministic stratified hash splits of ``operators.ml``.
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.config import MODEL_PRESETS, SEED
from claimlens.operators import metrics as mt
from claimlens.operators import ml
from claimlens.operators import profiling as pf
from claimlens.operators.oversample import smote
from claimlens.plans import pipeline as pl
from claimlens.plans.queries_features import FINAL_FEATURES
from claimlens.plans.registry import register
from claimlens.session import ensure_checkpoint_dir
from claimlens.sources import io
from claimlens.sources.materialize import materialize

LABEL = "label"
FEATURES = [c for c in FINAL_FEATURES if c != "PotentialFraud"]
# Reference model settings: logistic 1000 iterations; forest 100 x depth 10;
# boosted trees 100 x depth 6, rate 0.1 with the positive-class weight.
# The cheap single-split check (M15) fits on so many rows at most; what it scores has no bound.
MAX_FIT_ROWS = 10_000
GBT_MAIN = dict(n_estimators=100, max_depth=6, learning_rate=0.1, random_state=SEED)


def training_table(spark, sf) -> DataFrame:
    """(key, label, features...) written once: splits, folds and every fit read the same files."""
    ft = pl.feature_table(spark, sf, keep=("ClaimID", "Provider"))
    key = F.coalesce(F.col("ClaimID"), F.concat(F.lit("P"), F.col("Provider")))
    return materialize(ft.select(key.alias("key"), F.col("PotentialFraud").cast("int").alias(LABEL),
                                 *[F.col(c).cast("double").alias(c) for c in FEATURES]), "training_table")


def _split(spark, sf, fraction=0.2, table=None):
    table = table if table is not None else training_table(spark, sf)
    t = materialize(ml.stratified_split(table, LABEL, "key", fraction), "split")
    train = t.where(F.col("split") == "train").drop("split")
    test = t.where(F.col("split") == "test").drop("split")
    return train, test


def _scored(model, test) -> DataFrame:
    return ml.score_batch(model, test).select("key", LABEL, "fraud_probability")


@register("train_logistic", None)
def q_train_logistic(spark, sf):
    train, test = _split(spark, sf)
    model = ml.fit(ml.logistic_pipeline(FEATURES), mt.with_balanced_weight(train, LABEL))
    return _scored(model, test)


@register("train_forest", None)
def q_train_forest(spark, sf):
    train, test = _split(spark, sf)
    model = ml.fit(ml.forest_pipeline(FEATURES), mt.with_balanced_weight(train, LABEL))
    return _scored(model, test)


@register("train_gbt", None)
def q_train_gbt(spark, sf):
    train, test = _split(spark, sf)
    model = ml.fit(ml.gbt_pipeline(FEATURES, GBT_MAIN), mt.with_class_weight(train, LABEL))
    return _scored(model, test)


# Plain boosted trees and the oversampled variants carry no class weights.
GBT_PLAIN = dict(n_estimators=100, max_depth=5, learning_rate=0.1, random_state=SEED)


def _balanced(train):
    return ml.oversampled(train, LABEL, FEATURES, "key")


@register("train_gbt_plain", None)
def q_train_gbt_plain(spark, sf):
    train, test = _split(spark, sf)
    return _scored(ml.fit(ml.gbt_pipeline(FEATURES, GBT_PLAIN, weight=None), train), test)


@register("train_forest_smote", None)
def q_train_forest_smote(spark, sf):
    """M5 on oversampled rows: the training split and synthetic rows of its own, never of a held-out row."""
    train, test = _split(spark, sf)
    return _scored(ml.fit(ml.forest_pipeline(FEATURES, weight=None), _balanced(train)), test)


@register("train_gbt_smote", None)
def q_train_gbt_smote(spark, sf):
    """M6 on oversampled rows."""
    train, test = _split(spark, sf)
    return _scored(ml.fit(ml.gbt_pipeline(FEATURES, GBT_MAIN, weight=None), _balanced(train)), test)


@register("cross_validate_smote", None)
def q_cross_validate_smote(spark, sf):
    """M8 with the rows of each fold's training part oversampled after the fold is left out."""
    return ml.cross_validate(training_table(spark, sf), FEATURES, lambda: ml.gbt_pipeline(FEATURES, "very_conservative", weight=None), LABEL, "key", 3,
                             "very_conservative_smote", prepare=_balanced)


@register("score_batch", None)
def q_score_batch(spark, sf):
    """Fit once on the training split, then score every row of the feature table."""
    table = training_table(spark, sf)
    train, _ = _split(spark, sf, table=table)
    model = ml.fit(ml.gbt_pipeline(FEATURES, "very_conservative"), mt.with_class_weight(train, LABEL))
    return _scored(model, table)


def scoring_throughput(spark, sf) -> tuple[int, float]:
    """Bench helper: rows scored per second by a fitted model over the whole feature table."""
    table = training_table(spark, sf)
    train, _ = _split(spark, sf, table=table)
    model = ml.fit(ml.gbt_pipeline(FEATURES, "very_conservative"), mt.with_class_weight(train, LABEL))
    data = table.persist()
    n = data.count()
    t0 = time.time()
    _scored(model, data).write.format("noop").mode("overwrite").save()
    secs = time.time() - t0
    data.unpersist()
    return n, secs


@register("cross_validate", None)
def q_cross_validate(spark, sf):
    t = training_table(spark, sf)
    return ml.cross_validate(t, FEATURES, lambda: ml.gbt_pipeline(FEATURES, "very_conservative"), LABEL, "key", 5,
                             "very_conservative")


@register("holdout_validation", None)
def q_holdout_validation(spark, sf):
    """Baseline model vs tuned model on an untouched 20% test split."""
    train, test = _split(spark, sf)
    weighted = mt.with_class_weight(train, LABEL)
    rows = []
    for name, preset in (("baseline", GBT_MAIN), ("final", "conservative")):
        _, _, auc = ml.fit_score_auc(ml.gbt_pipeline(FEATURES, preset), weighted, test, LABEL)
        rows.append((name, float(auc)))
    out = spark.createDataFrame(rows, "model string, roc_auc double")
    base = [a for n, a in rows if n == "baseline"][0]
    return out.withColumn("delta_vs_baseline", F.col("roc_auc") - F.lit(base))


@register("single_split_validation", None)
def q_single_split_validation(spark, sf):
    """One stratified split, AUC per preset. Fits on at most MAX_FIT_ROWS training rows (hash order)
    and scores every held-out row."""
    train, test = _split(spark, sf)
    train = materialize(mt.with_class_weight(ml.hash_sample(train, "key", MAX_FIT_ROWS), LABEL), "fit_rows")
    rows = []
    for preset in ("very_conservative", "conservative", "balanced"):
        _, _, auc = ml.fit_score_auc(ml.gbt_pipeline(FEATURES, preset), train, test, LABEL)
        rows.append((preset, float(auc), 0.01))
    return spark.createDataFrame(rows, "model string, roc_auc double, std double")


def _importances(spark, sf):
    train, _ = _split(spark, sf)
    model = ml.fit(ml.gbt_pipeline(FEATURES, "very_conservative"), mt.with_class_weight(train, LABEL))
    return ml.importance_table(model, FEATURES)


@register("importance_table", None)
def q_importance_table(spark, sf):
    return _importances(spark, sf)


@register("custom_feature_share", None)
def q_custom_feature_share(spark, sf):
    """How much of the importance the library's own risk features hold, banded."""
    return ml.custom_feature_share(_importances(spark, sf))


@register("linear_importance", None)
def q_linear_importance(spark, sf):
    """A31 by the linear model: absolute coefficients of the standardised features."""
    train, _ = _split(spark, sf)
    model = ml.fit(ml.logistic_pipeline(FEATURES), mt.with_balanced_weight(train, LABEL))
    return ml.importance_table(model, FEATURES)


@register("top_features", None)
def q_top_features(spark, sf):
    return ml.top_features(_importances(spark, sf), 10)


@register("leakage_by_importance", None)
def q_leakage_by_importance(spark, sf):
    return ml.leakage_by_importance(_importances(spark, sf))


@register("select_best_model", None)
def q_select_best_model(spark, sf):
    """Best model by mean cross-validated AUC over the candidates."""
    t = training_table(spark, sf)
    res = None
    for preset in ("very_conservative", "conservative"):
        r = ml.cross_validate(t, FEATURES, lambda p=preset: ml.gbt_pipeline(FEATURES, p), LABEL, "key", 3, preset)
        res = r if res is None else res.unionByName(r)
    return ml.select_best_model(res.where(F.col("metric") == "roc_auc"))


@register("model_report", None)
def q_model_report(spark, sf):
    """Metrics + top-5 features + best threshold for one fitted model, as (section, name, value)."""
    train, test = _split(spark, sf)
    model = ml.fit(ml.gbt_pipeline(FEATURES, "very_conservative"), mt.with_class_weight(train, LABEL))
    scored = ml.score_batch(model, test)
    return ml.model_report(scored, LABEL, "fraud_probability", ml.importance_table(model, FEATURES))


@register("smote", None)
def q_smote(spark, sf):
    """M3: oversample the minority class of the training split to balance, then train on it."""
    train, _ = _split(spark, sf)
    return smote(train, LABEL, FEATURES, "key", k=3, seed=SEED)


@register("smote_exact", None)
def q_smote_exact(spark, sf):
    """M3 with exact neighbours, searched block by block."""
    train, _ = _split(spark, sf)
    return smote(train, LABEL, FEATURES, "key", k=3, seed=SEED, exact=True)


@register("report_versions", None)
def q_report_versions(spark, sf):
    """Executive, feature, optimisation and metrics sections, published as one version and read back."""
    table = training_table(spark, sf)
    train, test = _split(spark, sf, table=table)
    weighted = materialize(mt.with_class_weight(train, LABEL), "report_train")
    fitted = {name: ml.fit_score_auc(ml.gbt_pipeline(FEATURES, name), weighted, test, LABEL) for name in ("very_conservative", "conservative")}
    best = max(fitted, key=lambda name: (fitted[name][2], name))
    model, scored, _ = fitted[best]
    scored = materialize(scored.select("key", LABEL, "fraud_probability"), "report_scores")
    importances = ml.importance_table(model, FEATURES)
    contrast = pf.label_contrast(table, LABEL, FEATURES).orderBy(F.col("ratio").desc(), "feature").limit(5)
    sections = ml.report_sections(scored, LABEL, importances, contrast, {name: x[2] for name, x in fitted.items()}, MODEL_PRESETS[best])
    root = os.path.join(ensure_checkpoint_dir(spark), f"reports-{uuid.uuid4().hex}")
    io.publish_report(sections, root)
    return io.latest_report(spark, root).drop("version")


@register("model_store", None)
def q_model_store(spark, sf):
    """Save a fitted model with its feature list, load it back, score with the loaded model."""
    train, test = _split(spark, sf)
    model = ml.fit(ml.gbt_pipeline(FEATURES, "very_conservative"), mt.with_class_weight(train, LABEL))
    base = os.path.join(ensure_checkpoint_dir(spark), f"models-{uuid.uuid4().hex}")
    store = ml.ModelStore((os.path.join(base, "primary"), os.path.join(base, "fallback")))
    store.save(model, FEATURES)
    loaded, feats = store.load()
    if not store.features_match(feats, test):  # the data have changed since: fit on what they have now
        loaded = ml.fit(ml.gbt_pipeline(FEATURES, "very_conservative"), mt.with_class_weight(train, LABEL))
        store.save(loaded, FEATURES)
    return _scored(loaded, test)
