"""Model pipeline on MLlib.

Only the data-parallel work is ours: deterministic stratified splits and folds
(hash order, replay-safe), class weights, oversampling, evaluation and
selection. The learners are MLlib's (GBT / random forest / logistic regression);
the boosted-tree presets are mapped onto GBTClassifier parameters.
"""

from __future__ import annotations

import functools
import itertools
import os
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.config import (COARSE_GRID, CUSTOM_SHARE_BANDS, DOMINANT_FEATURE_THRESHOLD, MODEL_PRESETS,
                              OVERFIT_MODERATE_GAP, OVERFIT_SIGNIFICANT_GAP, PATIENT_IMPORTANCE_THRESHOLD,
                              PROVIDER_IMPORTANCE_THRESHOLD, REPORT_FEATURE_PATTERN, SEED)
from claimlens.functions import rules
from claimlens.operators import metrics as mt
from claimlens.operators.oversample import smote
from claimlens.operators.ranking import global_rank
from claimlens.session import wide_stages
from claimlens.sources.materialize import materialize


def hash_key(key: str, seed: int = SEED):
    """Replay-safe pseudo-random order key: md5 of the key text and the seed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def _ranked_within_label(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    with_h = df.withColumn("__h", hash_key(key, seed))
    ranked = global_rank(with_h, ["__h"], name="__r", partition_cols=(label,), uniform=True)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    # One row per label value: a size-bounded broadcast.
    return ranked.join(F.broadcast(counts), label)


# M1
def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds ``split`` in {train, test}; each label keeps round(n * fraction) test rows."""
    r = _ranked_within_label(df, label, key, seed)
    n_test = F.floor(F.col("__n") * test_fraction + 0.5)
    return r.withColumn("split", F.when(F.col("__r") <= n_test, "test").otherwise("train")).drop("__h", "__r", "__n")


def nested_split(df: DataFrame, label: str, key: str, fractions=(0.2, 0.2), seed: int = SEED) -> DataFrame:
    """80/20 then 80/20 of the remainder: split in {train, validation, test}."""
    first = stratified_split(df, label, key, fractions[0], seed)
    test = first.where(F.col("split") == "test")
    rest = stratified_split(first.where(F.col("split") == "train").drop("split"), label, key, fractions[1], seed + 1)
    rest = rest.withColumn("split", F.when(F.col("split") == "test", "validation").otherwise("train"))
    return test.unionByName(rest)


# M7
def stratified_kfold(df: DataFrame, label: str, key: str, k: int = 5, seed: int = SEED) -> DataFrame:
    r = _ranked_within_label(df, label, key, seed)
    return r.withColumn("fold", ((F.col("__r") - 1) % k).cast("int")).drop("__h", "__r", "__n")


# M2
def hash_sample(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """Deterministic sample of at most ``n`` rows (smallest hash keys); a top-k, no full sort."""
    return df.withColumn("__h", hash_key(key, seed)).orderBy("__h").limit(n).drop("__h")


# --- learners (M4-M6) ------------------------------------------------------------------------------

def assembler(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep")


def logistic_pipeline(features: list[str], label: str = "label", weight: str | None = "weight",
                      max_iter: int = 1000) -> Pipeline:
    lr = LogisticRegression(featuresCol="scaled", labelCol=label, maxIter=max_iter, probabilityCol="probability")
    if weight:
        lr.setWeightCol(weight)
    return Pipeline(stages=[assembler(features, "raw"), StandardScaler(inputCol="raw", outputCol="scaled"), lr])


def forest_pipeline(features: list[str], label: str = "label", weight: str | None = "weight", trees: int = 100,
                    depth: int = 10, seed: int = SEED) -> Pipeline:
    # Each row keeps the node it has come to in every tree, so a level does not walk all trees from their roots again. These
    # are not written to the shared folder on the way (a number per tree and row): a lost part is walked again, by its few levels.
    rf = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True, checkpointInterval=-1)
    if weight:
        rf.setWeightCol(weight)
    return Pipeline(stages=[assembler(features), rf])


def gbt_params(preset: dict) -> dict:
    """Boosted-tree preset -> GBTClassifier parameters (see SURVEY section 4.3)."""
    out = dict(maxIter=int(preset.get("n_estimators", 100)), maxDepth=int(preset.get("max_depth", 5)),
               stepSize=float(preset.get("learning_rate", 0.1)), subsamplingRate=float(preset.get("subsample", 1.0)),
               seed=int(preset.get("random_state", SEED)))
    if "colsample_bytree" in preset:
        out["featureSubsetStrategy"] = str(preset["colsample_bytree"])
    if "min_child_weight" in preset:
        out["minInstancesPerNode"] = int(preset["min_child_weight"])
    if "gamma" in preset:
        # A loss reduction per split has no equal; a hundredth of it as information gain, by convention.
        out["minInfoGain"] = float(preset["gamma"]) / 100.0
    return out


def gbt_pipeline(features: list[str], preset: dict | str = "balanced", label: str = "label",
                 weight: str | None = "weight", validation_col: str | None = None, **overrides) -> Pipeline:
    p = MODEL_PRESETS[preset] if isinstance(preset, str) else preset
    params = {**gbt_params(p), **overrides}
    gbt = GBTClassifier(labelCol=label, **params)
    if weight:
        gbt.setWeightCol(weight)
    if validation_col:
        gbt.setValidationIndicatorCol(validation_col)
    return Pipeline(stages=[assembler(features), gbt])


# M5/M6 on oversampled rows
def oversampled(train: DataFrame, label: str, features: list[str], key: str, k: int = 3, seed: int = SEED) -> DataFrame:
    """The training rows and synthetic ones made from them alone: call it after held-out rows have been taken away."""
    train = materialize(train.select(key, label, *features), "oversample_train")
    return train.unionByName(smote(train, label, features, key, k, seed))


def fit(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """The fitted pipeline; the training rows are read in even parts by code that the JVM compiles."""
    with wide_stages(train.sparkSession):
        return pipeline.fit(train)


# R9
def score_batch(model: PipelineModel, df: DataFrame, out: str = "fraud_probability") -> DataFrame:
    """Class-1 probability for every row; partitions replace manual batching."""
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array(F.col("probability"))[1]).drop(
        "features", "raw", "scaled", "rawPrediction", "probability")


# --- evaluation and selection (M8-M18) -------------------------------------------------------------

def fit_score_auc(pipeline: Pipeline, train: DataFrame, test: DataFrame, label: str = "label") -> tuple:
    model = fit(pipeline, train)
    scored = score_batch(model, test)
    auc = mt.roc_auc(scored, label, "fraud_probability").first()["roc_auc"]
    return model, scored, auc


# M8
def cross_validate(df: DataFrame, features: list[str], make_pipeline, label: str = "label", key: str = "key",
                   k: int = 5, model_name: str = "model", prepare=None) -> DataFrame:
    """Per fold: fit on the other folds, score the fold, record AUC and business metrics (long format).

    ``prepare`` makes the rows to fit on from a fold's training rows; without it they get class weights."""
    prepare = prepare or (lambda rows: mt.with_class_weight(rows, label))
    spark = df.sparkSession
    folds = stratified_kfold(df, label, key, k).withColumn("weight", F.lit(1.0))
    folds = folds.persist()
    rows = []
    for f in range(k):
        train = prepare(folds.where(F.col("fold") != f).drop("weight"))
        test = folds.where(F.col("fold") == f)
        _, scored, auc = fit_score_auc(make_pipeline(), train, test, label)
        rows.append((model_name, f, "roc_auc", float(auc) if auc is not None else None))
        bm = mt.business_metrics(scored, label, "fraud_probability").collect()
        for r in bm:
            rows.append((model_name, f, f"precision@{r['threshold']}", float(r["precision"])))
            rows.append((model_name, f, f"recall@{r['threshold']}", float(r["recall"])))
            rows.append((model_name, f, f"flagged_rate@{r['threshold']}", float(r["flagged_rate"])))
        rows.append((model_name, f, "average_precision", bm[0]["average_precision"]))
    folds.unpersist()
    return spark.createDataFrame(rows, "model string, fold int, metric string, value double")


# M11
def coarse_grid(max_trials: int | None = None) -> list[dict]:
    """Ordered grid n_estimators x max_depth x learning_rate: all of it, or the first ``max_trials``
    (``COARSE_GRID_MAX_TRIALS`` for the application's own list). Searched by ``operators.search``."""
    g = COARSE_GRID
    combos = itertools.product(g["n_estimators"], g["max_depth"], g["learning_rate"])
    return [dict(n_estimators=n, max_depth=d, learning_rate=lr, subsample=0.9, colsample_bytree=0.9, random_state=SEED)
            for n, d, lr in itertools.islice(combos, max_trials)]


# M12
def regularised_grid(best: dict) -> list[dict]:
    """3 x 3 around the best trial over the two tree regularisers MLlib has."""
    return [{**best, "min_child_weight": m, "gamma": g} for m in (1, 5, 10) for g in (0.0, 1.0, 2.0)]


# M14
def overfit_gap(train_auc: float, valid_auc: float) -> tuple[float, str]:
    gap = train_auc - valid_auc
    band = "significant" if gap > OVERFIT_SIGNIFICANT_GAP else "moderate" if gap > OVERFIT_MODERATE_GAP else "low"
    return gap, band


def overfit_band(gap):
    return (F.when(gap > OVERFIT_SIGNIFICANT_GAP, "significant").when(gap > OVERFIT_MODERATE_GAP, "moderate")
            .otherwise("low"))


# A31 / T5
def importance_table(model: PipelineModel, features: list[str]) -> DataFrame:
    """feature, importance, share % (desc); linear models use absolute coefficients."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray().tolist()
    else:
        vals = [abs(x) for x in last.coefficients.toArray().tolist()]
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(list(zip(features, [float(v) for v in vals])), "feature string, importance double")
    total = float(sum(vals)) or 1.0
    return df.withColumn("share_pct", F.col("importance") / total * 100).orderBy(F.col("importance").desc(), "feature")


def _custom_share():
    custom = rules.feature_category(F.col("feature")) == "custom"
    share = F.coalesce(F.try_divide(F.sum(F.when(custom, F.col("importance"))), F.sum("importance")) * 100, F.lit(0.0))
    return F.count(F.when(custom, 1)), share


def custom_feature_share(importances: DataFrame) -> DataFrame:
    """features, custom_features, share_pct, band: what the library's own risk features hold of the importance."""
    number, share = _custom_share()
    excellent, good = CUSTOM_SHARE_BANDS
    out = importances.agg(F.count(F.lit(1)).alias("features"), number.alias("custom_features"), share.alias("share_pct"))
    return out.withColumn("band", F.when(F.col("share_pct") > excellent, "excellent").when(F.col("share_pct") > good, "good").otherwise("minor"))


def top_features(importances: DataFrame, n: int = 10) -> DataFrame:
    return importances.orderBy(F.col("importance").desc(), "feature").limit(n)


# M16
def leakage_by_importance(importances: DataFrame, top: int = 10) -> DataFrame:
    f, imp = F.col("feature"), F.col("importance")
    t = top_features(importances, top)
    return t.select("feature", "importance",
                    (imp > DOMINANT_FEATURE_THRESHOLD).alias("dominates"),
                    (f.contains("Provider") & (imp > PROVIDER_IMPORTANCE_THRESHOLD)).alias("provider_leak"),
                    (f.contains("Patient") & (imp > PATIENT_IMPORTANCE_THRESHOLD)).alias("patient_leak"),
                    F.lower(f).contains("fraud").alias("target_name"))


def leaky_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "fraud" in c.lower()]


# M17
def select_best_model(results: DataFrame, model: str = "model", metric: str = "value") -> DataFrame:
    return results.groupBy(model).agg(F.avg(metric).alias("mean_auc")) \
                  .agg(F.max_by(model, F.struct("mean_auc", F.col(model))).alias("best_model"),
                       F.max("mean_auc").alias("best_mean_auc"))


# S10
@dataclass
class ModelStore:
    """Save a fitted pipeline with its feature list; load the first path that exists."""
    paths: tuple[str, ...]

    def save(self, model: PipelineModel, features: list[str], path: str | None = None) -> str:
        path = path or self.paths[0]
        model.write().overwrite().save(path)
        from pyspark.sql import SparkSession
        SparkSession.getActiveSession().createDataFrame([(i, f) for i, f in enumerate(features)], "position int, feature string") \
             .write.mode("overwrite").parquet(os.path.join(path, "_features"))
        return path

    def load(self) -> tuple[PipelineModel, list[str]] | None:
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        for p in self.paths:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
                feats = [r["feature"] for r in spark.read.parquet(os.path.join(p, "_features")).orderBy("position")
                         .collect()]
                return PipelineModel.load(p), feats
        return None

    @staticmethod
    def features_match(features: list[str], df: DataFrame) -> bool:
        return set(features) <= set(df.columns)


# M18
def model_report(scored: DataFrame, label: str, score: str, importances: DataFrame, top: int = 5) -> DataFrame:
    """One long table: metrics at 0.5, AUC, best-F1 threshold and the top features."""
    m = mt.classification_metrics(scored, label, score)
    metric_rows = m.select(F.inline(F.array(*[F.struct(F.lit("metrics").alias("section"), F.lit(c).alias("name"),
                                                       F.col(c).cast("double").alias("value"))
                                              for c in ("accuracy", "precision", "recall", "f1", "tp", "fp", "fn",
                                                        "tn")])))
    auc = mt.roc_auc(scored, label, score).select(F.lit("metrics").alias("section"), F.lit("roc_auc").alias("name"),
                                                  F.col("roc_auc").alias("value"))
    best = mt.best_f1_threshold(scored, label, score).select(
        F.inline(F.array(*[F.struct(F.lit("threshold").alias("section"), F.lit(c).alias("name"),
                                    F.col(c).cast("double").alias("value"))
                           for c in ("best_threshold", "best_f1", "best_precision", "best_recall")])))
    feats = top_features(importances, top).select(F.lit("top_features").alias("section"),
                                                  F.col("feature").alias("name"), F.col("share_pct").alias("value"))
    return metric_rows.unionByName(auc).unionByName(best).unionByName(feats)


# S11
def report_sections(scored: DataFrame, label: str, importances: DataFrame, contrast: DataFrame, aucs: dict[str, float], params: dict,
                    score: str = "fraud_probability") -> DataFrame:
    """section, name, value of the four reports: executive, features, optimisation, metrics.

    ``contrast`` holds the feature patterns to report (feature, ratio); ``aucs`` the AUC of each candidate."""
    spark = scored.sparkSession

    def long(section, df, name, value):
        return df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))

    pattern = F.col("feature").rlike(REPORT_FEATURE_PATTERN)
    summary = importances.agg(F.count(F.lit(1)).alias("features_analysed"), F.max("share_pct").alias("top_importance_pct"),
                              F.coalesce(F.sum(F.when(pattern, F.col("share_pct"))), F.lit(0.0)).alias("pattern_share_pct"),
                              _custom_share()[1].alias("custom_share_pct"))
    executive = summary.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in summary.columns])))
    best = max(aucs, key=lambda name: (aucs[name], name))
    tuned = [(f"auc:{name}", float(a)) for name, a in aucs.items()] + [("final_auc", float(aucs[best]))]
    tuned += [(f"param:{k}", float(v)) for k, v in params.items()]
    report = model_report(scored, label, score, importances)
    parts = [long("executive", executive, "name", "value"), long("features", top_features(importances, 10), "feature", "share_pct"),
             long("patterns", contrast, "feature", "ratio"), long("optimisation", spark.createDataFrame(tuned, "name string, value double"), "name", "value"),
             long("metrics", report.where(F.col("section") != "top_features"), "name", "value")]
    return functools.reduce(DataFrame.unionByName, parts)
