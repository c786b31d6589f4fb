"""Registered searches and comparisons over many fits (M9-M14): the whole training table, the application's own settings."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.config import COARSE_GRID_MAX_TRIALS, MODEL_PRESETS
from claimlens.operators import boosting as bo
from claimlens.operators import metrics as mt
from claimlens.operators import ml
from claimlens.operators import search as se
from claimlens.plans.queries_ml import FEATURES, GBT_MAIN, LABEL, _split, training_table
from claimlens.plans.registry import register
from claimlens.session import ensure_checkpoint_dir
from claimlens.sources.materialize import materialize


def _nested(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """80/20, and 80/20 of the rest: rows to fit on, to choose by and to test on."""
    parts = materialize(ml.nested_split(training_table(spark, sf), LABEL, "key"), "nested_split")
    return tuple(parts.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test"))


def _store(train: DataFrame) -> se.TrialStore:
    name = se.table_fingerprint(train, "key", LABEL)
    return se.TrialStore(train.sparkSession, os.path.join(ensure_checkpoint_dir(train.sparkSession), "trials", name))


def _baseline_auc(train, valid, store: se.TrialStore) -> float:
    """AUC of the baseline model; kept with the trials."""
    name = se.trial_key(GBT_MAIN)
    if name not in (done := store.load()):
        se.grid_search(train, valid, FEATURES, [GBT_MAIN], store, LABEL, strict=True)
        done = store.load()
    return done[name]


def coarse_search(train, valid, store: se.TrialStore, trials: list[dict] | None = None) -> tuple[DataFrame, float]:
    """The search over ``trials`` (by default the application's own list, the first 31 of the grid), and the baseline's AUC."""
    base = _baseline_auc(train, valid, store)
    return se.grid_search(train, valid, FEATURES, trials or ml.coarse_grid(COARSE_GRID_MAX_TRIALS), store, LABEL, base, strict=True), base


@register("grid_search_coarse", None, long=True)
def q_grid_search_coarse(spark, sf):
    """The first 31 trials in order, AUC on the validation rows, whether each beats the baseline."""
    train, valid, _ = _nested(spark, sf)
    return coarse_search(train, valid, _store(train))[0]


@register("grid_search_regularised", None, long=True)
def q_grid_search_regularised(spark, sf):
    """Nine trials around the best of M11, which is read from its stored trials (and run where they are missing)."""
    train, valid, _ = _nested(spark, sf)
    store = _store(train)
    _, base = coarse_search(train, valid, store)
    return se.regularised_search(train, valid, FEATURES, ml.coarse_grid(COARSE_GRID_MAX_TRIALS), store, GBT_MAIN, base, LABEL, strict=True)


@register("holdout_tuned", None, long=True)
def q_holdout_tuned(spark, sf):
    """M13 with the searches' outcome: the baseline and the best of all combinations of M11's grid and of M12 around the
    best of them, judged on the untouched test rows."""
    train, valid, test = _nested(spark, sf)
    store = _store(train)
    grid = ml.coarse_grid()
    _, base = coarse_search(train, valid, store, grid)
    around = se.regularised_search(train, valid, FEATURES, grid, store, GBT_MAIN, base, LABEL, strict=True)
    done = store.load()
    # of these searches only: the store may hold trials of others, too
    trials = [json.loads(t) for t in sorted({*map(se.trial_key, grid), *(r["params"] for r in around.collect())})]  # 45 at most
    final = se.best_trial(trials, [done[se.trial_key(t)] for t in trials], base) or GBT_MAIN
    weighted = materialize(mt.with_class_weight(train, LABEL), "holdout_train")
    got = se.concurrently(spark, {name: (lambda p=p: ml.fit_score_auc(ml.gbt_pipeline(FEATURES, p, LABEL), weighted, test, LABEL)[2])
                                  for name, p in (("baseline", GBT_MAIN), ("final", final))})
    for auc in got.values():
        if isinstance(auc, Exception):
            raise auc
    rows = [(name, se.trial_key(p), float(got[name]), float(got[name]) - float(got["baseline"])) for name, p in (("baseline", GBT_MAIN), ("final", final))]
    return spark.createDataFrame(rows, "model string, params string, roc_auc double, delta_vs_baseline double")


@register("model_comparison", None, long=True)
def q_model_comparison(spark, sf):
    """The three production presets by mean AUC of three folds."""
    presets = {name: (lambda name=name: ml.gbt_pipeline(FEATURES, name, LABEL)) for name in ("optimized", "conservative", "balanced")}
    return se.model_comparison(training_table(spark, sf), presets, LABEL, "key", 3)


def _stopped(spark, sf) -> tuple[bo.StoppedModel, DataFrame]:
    train, test = _split(spark, sf)
    return bo.early_stopping_fit(train, FEATURES, "balanced", LABEL, "key"), test


@register("early_stopping", None)
def q_early_stopping(spark, sf):
    """M9: test rows scored by the trees up to the best round."""
    fitted, test = _stopped(spark, sf)
    return fitted.score(test).select("key", LABEL, "fraud_probability")


@register("early_stopping_curve", None)
def q_early_stopping_curve(spark, sf):
    """M9: the validation AUC of every round until boosting stopped, and the round that is kept."""
    fitted, _ = _stopped(spark, sf)
    rows = [(k, float(a), k == fitted.trees, fitted.stopped) for k, a in enumerate(fitted.curve, 1)]
    return spark.createDataFrame(rows, "round int, roc_auc double, kept boolean, stopped boolean")


OVERFIT_PRESETS = ("optimized", "conservative", "very_conservative")


@register("overfit_gap", None, long=True)
def q_overfit_gap(spark, sf):
    """Train and validation AUC of three presets over the number of trees; the last stage's band counts."""
    train, valid = _split(spark, sf, 0.3)
    weighted = materialize(mt.with_class_weight(train, LABEL), "overfit_train")

    def curve(preset):
        return bo.overfit_curve(ml.fit(ml.gbt_pipeline(FEATURES, preset, LABEL), weighted), train, valid, preset, LABEL).collect()  # a row per stage

    got = se.concurrently(spark, {p: (lambda p=p: curve(p)) for p in OVERFIT_PRESETS if p in MODEL_PRESETS})
    for p, rows in got.items():
        if isinstance(rows, Exception):
            raise rows
    return spark.createDataFrame([r for rows in got.values() for r in rows],
                                 "model string, trees int, train_auc double, valid_auc double, last boolean, gap double, band string")
