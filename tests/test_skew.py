"""One provider and one member hold a third of all claim lines: results stay exact.

Brute-force check with pandas on a small fixture (the distributed plans use
partial aggregation, the broadcast label join and AQE, never one group per task).
"""
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from claimlens.operators import relational as rel
from claimlens.operators import stats as st
from claimlens.plans import pipeline as pl


def _lines(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append((f"C{i // 2}", "HOTPAT" if hot else f"B{rng.integers(0, 200)}",
                     "HOTPRV" if hot else f"P{rng.integers(0, 40)}",
                     Decimal(int(rng.integers(100, 100000))) / 100, Decimal(int(rng.integers(0, 500))) / 100,
                     i % 2, i % 2))
    schema = ("ClaimID string, BeneID string, Provider string, InscClaimAmtReimbursed decimal(12,2), "
              "DeductibleAmtPaid decimal(12,2), LineNo int, ClaimSource int")
    return spark.createDataFrame(rows, schema), pd.DataFrame(rows, columns=[
        "ClaimID", "BeneID", "Provider", "amt", "ded", "LineNo", "ClaimSource"])


def test_skewed_rollup_and_stats(spark):
    sdf, pdf = _lines(spark)
    rolled = rel.claim_rollup(sdf)
    # brute force: first provider = the one on the line with the least (source, line, value)
    pdf = pdf.sort_values(["ClaimSource", "LineNo", "Provider"])
    exp = pdf.groupby("ClaimID").agg(amt=("amt", "sum"), Provider=("Provider", "first"))
    got = rolled.toPandas().set_index("ClaimID")
    assert len(got) == len(exp)
    assert (got.loc[exp.index, "InscClaimAmtReimbursed"] == exp["amt"]).all()
    assert (got.loc[exp.index, "Provider"] == exp["Provider"]).all()

    labels = spark.createDataFrame([("HOTPRV", "Yes"), ("P1", "No"), ("NOCLAIMS", "No")],
                                   "Provider string, PotentialFraud string")
    merged = rel.label_left_claims(labels, rolled)
    assert merged.where(F.col("Provider") == "NOCLAIMS").count() == 1
    assert merged.where(F.col("Provider") == "HOTPRV").count() == (got["Provider"] == "HOTPRV").sum()

    prov = {r["Provider"]: r for r in st.provider_stats(rolled).collect()}
    hot = got[got["Provider"] == "HOTPRV"]["InscClaimAmtReimbursed"].astype(float)
    assert prov["HOTPRV"]["ProviderClaimCount"] == len(hot)
    assert abs(float(prov["HOTPRV"]["ProviderAvgClaim"]) - round(hot.mean(), 2)) <= 0.005
    assert abs(prov["HOTPRV"]["ProviderStdClaim"] - round(hot.std(), 2)) <= 0.005
    pat = {r["BeneID"]: r for r in st.patient_stats(rolled).collect()}
    assert pat["HOTPAT"]["PatientClaimCount"] == (got["BeneID"] == "HOTPAT").sum()


def test_skewed_features_no_nulls(spark):
    sdf, _ = _lines(spark)
    rolled = rel.claim_rollup(sdf)
    cleaned = pl.clean_claims(rel.label_left_claims(
        spark.createDataFrame([("HOTPRV", "Yes")] + [(f"P{i}", "No") for i in range(40)],
                              "Provider string, PotentialFraud string"), rolled))
    ft = pl.finalize_features(pl.with_claim_features(cleaned, st.ClaimStats.fit(cleaned)))
    row = ft.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in ft.columns]).first()
    assert all(v == 0 for v in row.asDict().values())  # every numeric column filled
    assert ft.count() == rolled.count() + 0  # every provider has claims here
