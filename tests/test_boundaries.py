"""Values at, just below and just above every cut-off of the rule and tier chains."""
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimlens.functions import features as fx
from claimlens.functions import rules


def _one(spark, col, value, dtype):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("p,level", [(0.95, "Critical Risk"), (0.9499, "High Risk"), (0.8, "High Risk"),
                                     (0.7999, "Medium Risk"), (0.6, "Medium Risk"), (0.5999, "Low Risk"),
                                     (0.0, "Low Risk")])
def test_batch_tiers(spark, p, level):
    assert _one(spark, rules.risk_tier, Decimal(str(p)), "decimal(5,4)") == level


@pytest.mark.parametrize("p,level", [(0.8, "High Risk"), (0.79, "Medium Risk"), (0.2, "Medium Risk"),
                                     (0.19, "Low Risk")])
def test_live_tiers(spark, p, level):
    assert _one(spark, rules.risk_tier_live, p, "double") == level


@pytest.mark.parametrize("p,level", [(0.9, "Critical Risk"), (0.7, "High Risk"), (0.5, "Medium Risk"),
                                     (0.49, "Low Risk")])
def test_policy_tiers(spark, p, level):
    assert _one(spark, rules.risk_tier_policy, p, "double") == level


@pytest.mark.parametrize("age,group", [(0, None), (1, 1.0), (35, 1.0), (36, 2.0), (65, 2.0), (66, 3.0), (75, 3.0),
                                       (76, 4.0), (85, 4.0), (86, 5.0), (100, 5.0), (101, None), (None, None)])
def test_age_bins_right_closed(spark, age, group):
    assert _one(spark, fx.age_risk_group, age, "int") == group


@pytest.mark.parametrize("ind,flag", [("N", 0), ("Y", 1), (None, 1), ("0", 1)])
def test_renal_missing_counts_as_one(spark, ind, flag):
    assert _one(spark, fx.has_renal_disease, ind, "string") == flag


@pytest.mark.parametrize("race,group", [(0, 1.0), (1, 1.0), (2, 1.0), (3, 2.0), (4, 1.0), (5, 1.0), (None, 1.0)])
def test_race_map(spark, race, group):
    assert _one(spark, fx.race_risk_group, race, "int") == group


@pytest.mark.parametrize("amount,stay,claims,age,chronic,p", [
    (10000, 5, 0, 50, 0, "0.10"), (10000.01, 5, 0, 50, 0, "0.20"), (20000.01, 5, 0, 50, 0, "0.30"),
    (50000.01, 5, 0, 50, 0, "0.50"), (50000.01, 2, 0, 50, 0, "0.80"), (15000.01, 3, 0, 50, 0, "0.20"),
    (15000.01, 2, 0, 50, 0, "0.50"), (1000, 5, 11, 50, 0, "0.20"), (1000, 5, 21, 50, 0, "0.30"),
    (25000.01, 5, 0, 39, 0, "0.50"), (25000.01, 5, 0, 40, 0, "0.30"), (1000, 5, 0, 50, 3, "0.20"),
    (60000, 1, 30, 30, 4, "0.99"),
])
def test_heuristic_probability(spark, amount, stay, claims, age, chronic, p):
    df = spark.createDataFrame([(Decimal(str(amount)), stay, claims, age, chronic)],
                               "a decimal(12,2), s int, c int, g int, k int")
    got = df.select(rules.heuristic_probability(F.col("a"), F.col("s"), F.col("c"), F.col("g"), F.col("k"))).first()[0]
    assert got == Decimal(p)


def test_exact_decimal_tier_at_point_eight(spark):
    # 0.1 + 0.4 + 0.3 is exactly 0.80 in decimal: High, not Medium.
    df = spark.createDataFrame([(Decimal("50000.01"), 2, 0, 50, 0)], "a decimal(12,2), s int, c int, g int, k int")
    p = rules.heuristic_probability(F.col("a"), F.col("s"), F.col("c"), F.col("g"), F.col("k"))
    assert df.select(rules.risk_tier(p)).first()[0] == "High Risk"
    assert df.select(F.floor(p * 100).cast("int")).first()[0] == 80


@pytest.mark.parametrize("level,prio", [("Critical Risk", "CRITICAL"), ("High Risk", "HIGH"),
                                        ("Medium Risk", "MEDIUM"), ("Low Risk", "MEDIUM")])
def test_priority(spark, level, prio):
    assert _one(spark, rules.risk_priority, level, "string") == prio


def test_typed_settings(spark):
    df = spark.createDataFrame([("0.90", "DECIMAL"), ("100", "INTEGER"), ("Yes", "BOOLEAN"), ("x", "STRING")],
                               "v string, t string")
    rows = df.select(*rules.typed_value(F.col("v"), F.col("t"))).collect()
    assert rows[0]["decimal_value"] == 0.9 and rows[1]["integer_value"] == 100
    assert rows[2]["boolean_value"] is True and rows[3]["string_value"] == "x"


def test_feature_category(spark):
    df = spark.createDataFrame([("IsHighValueClaim",), ("PatientAvgClaim",), ("Age",), ("ChronicCond_Cancer",),
                                ("Gender",)], "f string")
    got = [r[0] for r in df.select(rules.feature_category(F.col("f"))).collect()]
    assert got == ["custom", "financial", "time_age", "medical", "other"]


def test_recommended_conf_scales():
    from claimlens.session import recommended_conf
    c = recommended_conf(100 * 1024 ** 4, executors=1000, cores_per_executor=4)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert recommended_conf(10 ** 6)["spark.sql.shuffle.partitions"] == str(8000)
