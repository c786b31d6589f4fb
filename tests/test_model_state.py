"""Oversampling, feature share, versioned reports and streaming scores by a stored model."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.functions import rules
from claimlens.operators import ml
from claimlens.operators.oversample import exact_neighbours, nearest_neighbours, smote
from claimlens.plans import pipeline as pl
from claimlens.sources import io
from claimlens.sources.materialize import materialize
from claimlens.streaming import jobs
from test_ml import FEATS, _synthetic


def test_exact_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    points = [(f"p{i:03d}", *map(float, np.round(rng.normal(size=3), 1))) for i in range(120)] + [("twin", 0.0, 0.0, 0.0), ("twin2", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(points, "key string, a double, b double, c double")
    at = {p[0]: np.array(p[1:]) for p in points}
    got = {}
    for r in exact_neighbours(df, "key", ["a", "b", "c"], 3, block_rows=40).orderBy("key", "nn_rank").collect():
        got.setdefault(r["key"], []).append(r["nbr"])
    for key, x in at.items():
        want = sorted((float(np.sqrt(((y - x) ** 2).sum())), other) for other, y in at.items() if other != key)[:3]
        assert got[key] == [k for _, k in want]
    assert exact_neighbours(df.limit(1), "key", ["a", "b", "c"]).count() == 0


def test_recall_of_the_projection_search(spark):
    df = _synthetic(spark, 600).where("label = 1").select("key", *FEATS[:3])
    exact = exact_neighbours(df, "key", FEATS[:3], 3).select("key", "nbr")
    near = nearest_neighbours(df, "key", FEATS[:3], 3, projections=8, window=8).select("key", "nbr")
    recall = exact.join(near, ["key", "nbr"]).count() / exact.count()
    assert recall > 0.6, recall


@pytest.mark.parametrize("exact", [False, True])
def test_synthetic_rows_descend_from_training_rows_only(spark, exact):
    parts = ml.stratified_split(_synthetic(spark, 400), "label", "key", 0.3)
    train, test = parts.where("split = 'train'"), parts.where("split = 'test'")
    new = smote(train, "label", FEATS, "key", exact=exact, parents=True)
    held = {r["key"] for r in test.collect()}
    rows = new.collect()
    assert rows and all(r["base"] not in held and r["nbr"] not in held for r in rows)
    assert all(r["key"].startswith(r["base"] + ":smote:") for r in rows)
    at = {r["key"]: [r[f] for f in FEATS] for r in train.collect()}
    for r in rows:  # between its parents
        assert all(min(a, b) - 1e-9 <= r[f] <= max(a, b) + 1e-9 for f, a, b in zip(FEATS, at[r["base"]], at[r["nbr"]]))
    balanced = ml.oversampled(train, "label", FEATS, "key")
    assert len({r["count"] for r in balanced.groupBy("label").count().collect()}) == 1
    assert not held & {r["key"] for r in balanced.select("key").collect()}


def test_cross_validation_prepares_training_rows_of_each_fold(spark):
    seen = []

    def prepare(rows):
        seen.append({r["key"] for r in rows.collect()})
        return ml.oversampled(rows, "label", FEATS, "key")

    df = _synthetic(spark, 240)
    out = ml.cross_validate(df, FEATS, lambda: ml.gbt_pipeline(FEATS, dict(n_estimators=2, max_depth=2), weight=None), k=3, prepare=prepare)
    folds = ml.stratified_kfold(df, "label", "key", 3)
    assert seen == [{r["key"] for r in folds.where(F.col("fold") != f).collect()} for f in range(3)]
    assert out.where("metric = 'roc_auc' and value > 0.5").count() == 3


def test_custom_share_bands(spark):
    def share(custom):
        rows = [("IsHighValueClaim", custom / 2), ("IsLowDeductible", custom / 2), ("Age", 100.0 - custom)]
        r = ml.custom_feature_share(spark.createDataFrame(rows, "feature string, importance double")).first()
        return r["custom_features"], round(r["share_pct"], 6), r["band"]

    assert [share(x) for x in (31.0, 30.0, 16.0, 15.0, 0.0)] == [(2, 31.0, "excellent"), (2, 30.0, "good"), (2, 16.0, "good"), (2, 15.0, "minor"), (2, 0.0, "minor")]
    assert ml.custom_feature_share(spark.createDataFrame([("Age", 0.0)], "feature string, importance double")).first()["share_pct"] == 0.0


def test_linear_importance_is_standardised(spark):
    df = _synthetic(spark, 600).withColumn("feature1", F.col("feature1") * 1000)  # the scale must not matter
    plain = ml.importance_table(ml.logistic_pipeline(FEATS, weight=None).fit(_synthetic(spark, 600)), FEATS)
    scaled = ml.importance_table(ml.logistic_pipeline(FEATS, weight=None).fit(df), FEATS)
    a, b = ({r["feature"]: r["share_pct"] for r in x.collect()} for x in (plain, scaled))
    assert all(abs(a[f] - b[f]) < 0.5 for f in FEATS) and a["feature1"] > a["InscClaimAmtReimbursed"]


def test_report_versions(spark, tmp_path):
    root = f"file://{tmp_path}/report"
    assert io.latest_report(spark, root) is None
    schema = "section string, name string, value double"
    assert io.publish_report(spark.createDataFrame([("a", "x", 1.0)], schema), root) == 1
    assert io.publish_report(spark.createDataFrame([("a", "x", 2.0), ("b", "y", 3.0)], schema), root) == 2
    half = tmp_path / "report" / "version=3"  # a version whose write has not been committed
    spark.createDataFrame([("a", "x", 9.0)], schema).write.parquet(f"file://{half}")
    os.remove(half / "_SUCCESS")
    assert sorted(map(tuple, io.latest_report(spark, root).collect())) == [(2, "a", "x", 2.0), (2, "b", "y", 3.0)]


def test_report_sections_add_up(spark):
    scored = spark.createDataFrame([("k%d" % i, i % 2, 0.9 if i % 2 else 0.2) for i in range(20)], "key string, label int, fraud_probability double")
    importances = spark.createDataFrame([("IsHighValueClaim", 0.4, 40.0), ("Age", 0.6, 60.0)], "feature string, importance double, share_pct double")
    contrast = spark.createDataFrame([("Age", 1.2)], "feature string, ratio double")
    got = {(r["section"], r["name"]): r["value"] for r in ml.report_sections(scored, "label", importances, contrast, {"m": 0.9, "n": 0.8}, {"max_depth": 4}).collect()}
    assert got["executive", "custom_share_pct"] == pytest.approx(40) and got["executive", "pattern_share_pct"] == 40 and got["features", "Age"] == 60
    assert got["optimisation", "final_auc"] == 0.9 and got["optimisation", "param:max_depth"] == 4 and got["metrics", "roc_auc"] == 1.0
    assert {s for s, _ in got} == {"executive", "features", "patterns", "optimisation", "metrics"}


@pytest.fixture(scope="module")
def merged(spark, sf):
    return materialize(pl.merged_claims(spark, sf).where(F.col("ClaimID").isNotNull()), "merged")


def test_stream_by_model_equals_batch(spark, merged, tmp_path):
    """Half of the providers unknown to the state; a second version published while the stream runs."""
    root, src, out = (f"file://{tmp_path}/{x}" for x in ("state", "in", "out"))
    known = merged.where(F.pmod(F.xxhash64("Provider"), F.lit(2)) == 0)
    with pytest.raises(ValueError):
        jobs.load_state(spark, root)
    states = [jobs.fit_state(spark, known, root, dict(n_estimators=4, max_depth=2, learning_rate=0.3))]
    arriving = merged.drop("PotentialFraud")
    parts = [arriving.where(F.pmod(F.xxhash64("ClaimID"), F.lit(2)) == i) for i in (0, 1)]
    for i, part in enumerate(parts):
        if i == 1:  # the next version takes effect with the next micro-batch
            states.append(jobs.ScoringState(jobs.publish_state(spark, root, states[0].stats, states[0].model, states[0].features),
                                            states[0].stats, states[0].model, states[0].features))
        part.write.mode("append").parquet(src)
        jobs.stream_score_by_model(spark, src, arriving.schema, root, out, f"{tmp_path}/ckpt")
    got = spark.read.parquet(out).drop("batch")
    want = [jobs.score_by_model(p, s) for p, s in zip(parts, states)]
    want = want[0].unionByName(want[1])
    assert got.count() == merged.count() and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert {r[0] for r in got.select("model_version").distinct().collect()} == {"state-1", "state-2"}
    # unknown providers take the rule's probability, known ones the model's
    both = got.join(merged.select(F.col("ClaimID").alias("claim_id"), "Provider"), "claim_id")
    levels = both.groupBy((F.pmod(F.xxhash64("Provider"), F.lit(2)) == 0).alias("known")).agg(F.countDistinct("fraud_probability").alias("n")).collect()
    assert {r["known"] for r in levels} == {True, False}
    unknown = both.where(F.pmod(F.xxhash64("Provider"), F.lit(2)) != 0)
    heuristic = rules.heuristic_probability(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0))
    assert unknown.where(F.col("fraud_probability") < heuristic).count() == 0 and unknown.select("fraud_probability").distinct().count() <= 96


def test_exact_search_sends_a_point_to_few_blocks(spark, monkeypatch):
    from claimlens.operators import oversample

    kept = {}

    def seen(df, name, *a, **k):
        kept[name] = materialize(df, name, *a, **k)
        return kept[name]

    monkeypatch.setattr(oversample, "materialize", seen)
    rng = np.random.default_rng(5)
    points = [(f"p{i:04d}", *map(float, rng.normal(size=2) * 1000), float(i % 2)) for i in range(1500)]
    points += [(f"same{i:02d}", 7.0, 7.0, 0.0) for i in range(90)]  # one place of more points than a block has
    points += [("twice", 1.0, 2.0, 0.0), ("twice", 900.0, -900.0, 1.0), ("nan", float("nan"), 0.0, 0.0), ("null", None, 0.0, 0.0), ("far", 1e6, 1e6, 0.0)]
    df = spark.createDataFrame(points, "key string, a double, b double, c double")
    got = {(r["key"], r["nn_rank"]): (r["nbr"], r["dist"]) for r in exact_neighbours(df, "key", ["a", "b", "c"], 3, block_rows=40).collect()}
    met = [p for p in points if p[0] not in ("nan", "null")]
    x, keys = np.array([p[1:] for p in met]), np.array([p[0] for p in met])
    want = {}
    for key in set(keys.tolist()):
        other = np.flatnonzero(keys != key)
        best = sorted((float(d), n) for row in np.flatnonzero(keys == key) for d, n in zip(np.sqrt(((x[other] - x[row]) ** 2).sum(axis=1)), keys[other]))[:3]
        want |= {(key, i): (n, d) for i, (d, n) in enumerate(best, 1)}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) <= 1e-9 * want[k][1] for k in want)
    sent = kept["exact_own"].selectExpr("sum(size(__to)) AS n").first()
    assert sent["n"] < 3 * len(met)  # of more than 30 blocks; before, every point was sent to all of them, twice
