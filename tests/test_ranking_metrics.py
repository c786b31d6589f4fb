"""Distributed prefix sums / ranks and curve metrics against single-task references."""
import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlens.operators import metrics as mt
from claimlens.operators import profiling as pf
from claimlens.operators.ranking import global_rank, prefix_sums


def _data(spark, n=3000, seed=7):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(0, 2)), float(np.round(rng.random(), 2)), int(rng.integers(0, 3)))
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, label int, score double, g int")


def test_global_rank_matches_row_number(spark):
    df = _data(spark).withColumn("h", F.md5(F.col("id").cast("string")))
    a = global_rank(df, ["h"], "r", partition_cols=("g",))
    b = df.withColumn("r2", F.row_number().over(Window.partitionBy("g").orderBy("h")))
    j = a.join(b.select("id", "r2"), "id")
    assert j.where("r != r2").count() == 0 and j.count() == df.count()


def test_prefix_sums_numeric_desc(spark):
    df = _data(spark).groupBy("score").agg(F.count("*").alias("n"))
    a = prefix_sums(df, ["score"], {"cum": F.col("n")}, descending=True)
    b = df.withColumn("cum2", F.sum("n").over(Window.orderBy(F.col("score").desc())
                                                .rowsBetween(Window.unboundedPreceding, 0)))
    assert a.join(b.select("score", "cum2"), "score").where("cum != cum2").count() == 0


def test_auc_matches_mllib_exact(spark):
    df = _data(spark)
    ours = mt.roc_auc(df, "label", "score").first()["roc_auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC",
                                       numBins=0)
    ref = ev.evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert abs(ours - ref) < 1e-12


def test_confusion_and_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1), (0, 0.2)], "label int, score double")
    m = mt.classification_metrics(df, "label", "score").first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (1, 1, 1, 2)
    assert m["precision"] == 0.5 and m["recall"] == 0.5 and m["accuracy"] == 0.6
    best = mt.best_f1_threshold(df, "label", "score").first()
    assert best["best_threshold"] == 0.4 and abs(best["best_f1"] - 0.8) < 1e-12


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "label int, score double")
    m = mt.classification_metrics(df, "label", "score").first()
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and m["f1"] == 0.0


def test_balance_check(spark):
    df = spark.createDataFrame([(1,)] * 30 + [(0,)] * 70, "label int")
    r = mt.class_balance_check(df, "label").first()
    assert r["positive_rate"] == 0.3 and r["severe_imbalance"] is False


def test_t_pvalue_closed_form(spark):
    from claimlens.operators import profiling as pf
    rows = [(0, 1.0, 5), (0, 2.0, 5), (0, 3.0, 5), (1, 4.0, 5), (1, 5.0, 5), (1, 6.0, 5)]
    df = spark.createDataFrame(rows, "y int, x double, flat int")
    r = {x["feature"]: x for x in pf.label_ttest(df, "y", ["x", "flat"]).collect()}
    t = 3 / (2 / 3) ** 0.5
    assert abs(r["x"]["t_stat"] - t) < 1e-12 and r["x"]["dof"] == 4
    u = t * t / 4  # Student's distribution with four degrees of freedom has a closed form
    cdf = 0.5 + 0.375 * t / (1 + u) ** 0.5 * (1 - u / (1 + u) / 3)
    assert abs(r["x"]["p_value"] - 2 * (1 - cdf)) < 1e-9
    assert r["flat"]["t_stat"] is None and r["flat"]["p_value"] is None and r["flat"]["ratio"] == 1.0


def test_zero_mean_ratio(spark):
    from claimlens.operators import profiling as pf
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 0), (1, 3, 0), (1, 5, 0)], "y int, a int, b int")
    r = {x["feature"]: x["ratio"] for x in pf.label_ttest(df, "y", ["a", "b"], with_p=False).collect()}
    assert r == {"a": 4.0, "b": 1.0}


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (1.0,), (None,)], "p double")
    got = [(r["bin"], r["count"]) for r in mt.probability_histogram(df, "p", 10).orderBy("bin").collect()]
    assert got == [(0, 1), (1, 1), *[(i, 0) for i in range(2, 9)], (9, 1)]
    assert mt.probability_histogram(df.where("p > 2"), "p", 10).count() == 0
    flat = mt.probability_histogram(df.where("p = 1"), "p", 4).orderBy("bin").collect()
    assert [r["count"] for r in flat] == [1, 0, 0, 0]


def test_exact_quantiles_match_percentile(spark, monkeypatch):
    from claimlens.operators import quantiles as qt
    monkeypatch.setattr(qt, "VALUES_PER_SLICE", 50)  # several slices
    df = spark.range(1000).select((F.col("id") * 7919 % 613).cast("decimal(12,2)").alias("v"),
                                  (F.col("id") % 5).alias("w")).unionByName(
        spark.createDataFrame([(None, 3)], "v decimal(12,2), w bigint"))
    got = qt.exact_quantiles([qt.value_counts(df, "a", "v"), qt.value_counts(df, "b", "v", "w"),
                              qt.value_counts(df.where("v < 0"), "none", "v")],
                             {"a1": ("a", 0.1), "a9": ("a", 0.99), "b5": ("b", 0.5), "a0": ("a", 0.0),
                              "a100": ("a", 1.0), "n": ("none", 0.5)})
    ref = df.agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in (("a1", .1), ("a9", .99), ("a0", .0), ("a100", 1.0))],
                 F.percentile("v", F.lit(0.5), F.col("w")).alias("b5")).first().asDict()
    assert got == {**ref, "n": None}


def test_common_prefix_strings_spread_over_slices(spark):
    from claimlens.operators.ranking import slice_column
    df = spark.range(2000).select(F.concat(F.lit("PHY"), F.col("id").cast("string")).alias("v"))
    out, sl = slice_column(df, "v", 8)
    sizes = [r["count"] for r in out.groupBy(sl).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 2000 // 2
    ranked = global_rank(df, ["v"], "r")
    ref = df.withColumn("r2", F.row_number().over(Window.orderBy("v")))
    assert ranked.join(ref, "v").where("r != r2").count() == 0


def test_ttest_of_large_integers(spark):
    # 4 rows of a billion: the square of their sum is beyond 64 bits, and so is the sum of squares of the second column
    rows = [(y, 1_000_000_000 + y * i, 3_000_000_000 + i, y + i) for y in (0, 1) for i in range(4)]
    df = spark.createDataFrame(rows, "label int, a int, b long, small int")
    got = {r["feature"]: r for r in pf.label_ttest(df, "label", ["a", "b", "small"], with_p=False).collect()}
    for name, k in (("a", 1), ("b", 2), ("small", 3)):
        one, zero = ([r[k] for r in rows if r[0] == y] for y in (1, 0))
        m1, m0 = sum(one) / 4, sum(zero) / 4
        pooled = (sum((v - m1) ** 2 for v in one) + sum((v - m0) ** 2 for v in zero)) / 6
        assert abs(got[name]["t_stat"] - (m1 - m0) / (pooled / 2) ** 0.5) < 1e-9 and got[name]["dof"] == 6
