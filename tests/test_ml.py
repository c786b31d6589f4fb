"""Splits, folds, learners and oversampling on the reference's synthetic fixture shape."""
import numpy as np
from pyspark.sql import functions as F

from claimlens.config import COARSE_GRID_MAX_TRIALS
from claimlens.operators import metrics as mt
from claimlens.operators import ml
from claimlens.operators.oversample import smote


def _synthetic(spark, n=1000, seed=42):
    rng = np.random.default_rng(seed)
    f1, f2 = rng.normal(size=n), rng.normal(size=n)
    f3 = rng.integers(0, 2, size=n)
    amt = rng.normal(1000, 500, size=n)
    y = ((f1 + f2 + f3 + rng.normal(scale=0.5, size=n)) > 1.2).astype(int)
    rows = [(f"k{i}", int(y[i]), float(f1[i]), float(f2[i]), float(f3[i]), float(amt[i])) for i in range(n)]
    return spark.createDataFrame(rows, "key string, label int, feature1 double, feature2 double, feature3 double, "
                                       "InscClaimAmtReimbursed double")


FEATS = ["feature1", "feature2", "feature3", "InscClaimAmtReimbursed"]


def test_split_disjoint_complete_and_stratified(spark):
    df = _synthetic(spark)
    s = ml.stratified_split(df, "label", "key", 0.2)
    assert s.count() == 1000 and s.select("key").distinct().count() == 1000
    by = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    n1 = by[(1, "test")] + by[(1, "train")]
    assert by[(1, "test")] == int(n1 * 0.2 + 0.5)
    again = ml.stratified_split(df, "label", "key", 0.2)
    assert s.exceptAll(again).count() == 0  # deterministic


def test_folds_balanced(spark):
    f = ml.stratified_kfold(_synthetic(spark), "label", "key", 5)
    sizes = f.groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("d"))
    assert all(r["d"] <= 1 for r in sizes.collect())


def test_gbt_and_scoring(spark):
    df = _synthetic(spark)
    s = ml.stratified_split(df, "label", "key", 0.2)
    train = mt.with_class_weight(s.where("split = 'train'"), "label")
    test = s.where("split = 'test'")
    model, scored, auc = ml.fit_score_auc(ml.gbt_pipeline(FEATS, dict(n_estimators=10, max_depth=3)), train, test)
    assert scored.count() == test.count() and 0.7 < auc <= 1.0
    imp = ml.importance_table(model, FEATS).collect()
    assert abs(sum(r["share_pct"] for r in imp) - 100) < 1e-6


def test_smote_balances(spark):
    df = _synthetic(spark)
    counts = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    syn = smote(df, "label", FEATS, "key", k=3)
    minority = min(counts, key=counts.get)
    assert syn.count() == abs(counts[1] - counts[0])
    assert syn.where(F.col("label") != minority).count() == 0
    assert syn.select("key").distinct().count() == syn.count()


def test_leakage_rules(spark):
    imp = spark.createDataFrame([("ProviderClaimCount", 0.6), ("PatientTotal", 0.35), ("PotentialFraud_x", 0.01),
                                 ("Age", 0.04)], "feature string, importance double")
    r = {x["feature"]: x for x in ml.leakage_by_importance(imp).collect()}
    assert r["ProviderClaimCount"]["dominates"] and r["ProviderClaimCount"]["provider_leak"]
    assert r["PatientTotal"]["patient_leak"] and r["PotentialFraud_x"]["target_name"]
    assert ml.leaky_names(spark.createDataFrame([(1, 2, 3)], "feature1 int, legitimate_feature int, "
                                                             "PotentialFraud int")) == ["PotentialFraud"]


def test_grid_order_and_cap():
    g = ml.coarse_grid()
    assert len(g) == 36 and g[:31] == ml.coarse_grid(COARSE_GRID_MAX_TRIALS) and g[0]["n_estimators"] == 100 and g[0]["max_depth"] == 4 and g[0]["learning_rate"] == 0.05
    assert ml.overfit_gap(0.95, 0.9)[1] == "significant" and ml.overfit_gap(0.915, 0.9)[1] == "moderate"


def test_regularised_grid():
    assert len(ml.regularised_grid(ml.coarse_grid()[0])) == 9


def test_model_store_by_url(spark, tmp_path):
    df = _synthetic(spark, n=200)
    model = ml.gbt_pipeline(FEATS, dict(n_estimators=2, max_depth=2)).fit(mt.with_class_weight(df, "label"))
    store = ml.ModelStore((f"file://{tmp_path}/none", f"file://{tmp_path}/model"))
    assert store.load() is None
    store.save(model, FEATS, store.paths[1])
    loaded, feats = store.load()
    assert feats == FEATS and ml.score_batch(loaded, df).count() == 200
    assert not store.features_match(feats, df.drop("feature1"))


def test_wide_tables_in_even_files_and_settings_put_back(spark, monkeypatch):
    from claimlens.session import wide_stages
    from claimlens.sources import materialize as m
    monkeypatch.setattr(m, "FILE_ROWS", 100)
    out = m.materialize(_synthetic(spark, n=950).coalesce(1), "wide")
    sizes = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 950 and max(sizes) <= 100
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit, None)
    with wide_stages(spark), wide_stages(spark):
        assert spark.conf.get(limit) == "8000"
    assert spark.conf.get(limit, None) == before
    assert ml.forest_pipeline(FEATS).getStages()[1].getCacheNodeIds()


def test_neighbours_without_a_join_and_with_repeated_keys(spark):
    from claimlens.operators.oversample import exact_neighbours, nearest_neighbours
    points = spark.createDataFrame([(f"k{i}", float(i * i % 101), float(i)) for i in range(60)] + [("k3", 9.0, 3.0), (None, 1.0, 1.0)],
                                   "key string, a double, b double")
    near = nearest_neighbours(points, "key", ["a", "b"], 3, projections=8, window=16)
    # vectors are not sent along with every candidate pair
    assert "Join" not in near._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: {(r["key"], r["nn_rank"]): (r["nbr"], r["dist"]) for r in df.collect()}
    got, want = rows(near), rows(exact_neighbours(points.where("key is not null and not (key = 'k3' and a <> 9.0)").dropDuplicates(["key"]), "key", ["a", "b"], 3))
    assert got.keys() == want.keys()
    alone = [k for k in want if not {"k3", k[0]} & {want[k[0], i][0] for i in (1, 2, 3)} and k[0] != "k3"]
    assert alone and all(got[k] == want[k] for k in alone)


def test_exact_neighbours_where_products_round(spark):
    # far from the origin a distance by products is off by more than the distances themselves; ties go to the smaller key
    from claimlens.operators.oversample import exact_neighbours
    rng = np.random.default_rng(5)
    values = 1e8 + rng.integers(0, 4, size=(300, 3)) / 8.0
    points = spark.createDataFrame([(f"k{i:03}", *map(float, v)) for i, v in enumerate(values)], "key string, a double, b double, c double")
    got = {(r["key"], r["nn_rank"]): (r["nbr"], r["dist"]) for r in exact_neighbours(points, "key", ["a", "b", "c"], 3, block_rows=100).collect()}
    for i, v in enumerate(values):
        near = sorted((float(np.sqrt(((v - w) ** 2).sum())), f"k{j:03}") for j, w in enumerate(values) if j != i)[:3]
        assert [got[f"k{i:03}", n] for n in (1, 2, 3)] == [(name, dist) for dist, name in near]


def test_forest_fit_writes_no_node_numbers(spark):
    from claimlens.session import ensure_checkpoint_dir

    jvm, top = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    folders = lambda: {s.getPath().toString() for s in top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(
        jvm.org.apache.hadoop.fs.Path(top.toString() + "/*/rdd-*")) or []}
    noisy = spark.range(3000).select(F.rand(1).alias("a"), F.rand(2).alias("b"), (F.rand(3) > 0.5).cast("int").alias("label"), F.lit(1.0).alias("weight"))
    before = folders()
    forest = ml.forest_pipeline(["a", "b"], trees=2, depth=12)
    assert forest.getStages()[-1].getCheckpointInterval() == -1 and forest.getStages()[-1].getCacheNodeIds()
    forest.fit(noisy)
    assert folders() <= before
