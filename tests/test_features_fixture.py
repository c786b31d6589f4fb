"""Hand-computed values on the 3-row claim fixture (two providers, two members)."""
from decimal import Decimal

from pyspark.sql import functions as F

from claimlens.operators import stats as st
from claimlens.plans import pipeline as pl


def _claims(spark):
    rows = [
        ("C1", "PRV001", "BEN001", Decimal("1000.00"), Decimal("100.00"), "Yes", "1980-01-01", None,
         "2023-01-01", "2023-01-05", "2023-01-01", "2023-01-05", 12, 12),
        ("C2", "PRV002", "BEN002", Decimal("2000.00"), Decimal("200.00"), "No", "1970-01-01", None,
         "2023-02-01", "2023-02-10", "2023-02-01", "2023-02-10", 12, 6),
        ("C3", "PRV001", "BEN001", Decimal("1500.00"), Decimal("150.00"), "Yes", "1985-01-01", None,
         "2023-03-01", "2023-03-03", "2023-03-01", "2023-03-03", 0, 12),
    ]
    schema = ("ClaimID string, Provider string, BeneID string, InscClaimAmtReimbursed decimal(12,2), "
              "DeductibleAmtPaid decimal(12,2), PotentialFraud string, DOB string, DOD string, AdmissionDt string, "
              "DischargeDt string, ClaimStartDt string, ClaimEndDt string, NoOfMonths_PartACov int, "
              "NoOfMonths_PartBCov int")
    return spark.createDataFrame(rows, schema)


def test_clean_and_stats(spark):
    cleaned = pl.clean_claims(_claims(spark))
    got = {r["ClaimID"]: r for r in cleaned.collect()}
    assert [got[c]["Age"] for c in ("C1", "C2", "C3")] == [43, 53, 38]
    assert [got[c]["HospitalStayDays"] for c in ("C1", "C2", "C3")] == [4, 9, 2]
    assert [got[c]["ClaimDuration"] for c in ("C1", "C2", "C3")] == [4, 9, 2]
    assert all(got[c]["IsDead"] == 0 for c in got)
    assert got["C1"]["PotentialFraud"] == 1 and got["C2"]["PotentialFraud"] == 0

    prov = {r["Provider"]: r for r in st.provider_stats(cleaned).collect()}
    assert prov["PRV001"]["ProviderClaimCount"] == 2
    assert prov["PRV001"]["ProviderAvgClaim"] == Decimal("1250.00")
    assert prov["PRV001"]["ProviderStdClaim"] == 353.55  # sample std of 1000, 1500
    assert prov["PRV001"]["ProviderTotalClaims"] == Decimal("2500.00")
    assert prov["PRV002"]["ProviderStdClaim"] is None     # one claim: undefined
    pat = {r["BeneID"]: r for r in st.patient_stats(cleaned).collect()}
    assert pat["BEN001"]["PatientClaimCount"] == 2 and pat["BEN001"]["PatientProviderCount"] == 1
    assert pat["BEN001"]["PatientAvgClaim"] == Decimal("1250.00")


def test_claim_features(spark):
    cleaned = pl.clean_claims(_claims(spark))
    stats = st.ClaimStats.fit(cleaned)
    f = {r["ClaimID"]: r for r in pl.with_claim_features(cleaned, stats).collect()}
    assert abs(f["C1"]["ClaimVsProviderAvg"] - 1000 / 1251) < 1e-12
    assert abs(f["C1"]["DeductibleRatio"] - 100 / 1001) < 1e-12
    assert f["C1"]["IsHighDeductible"] == 0 and f["C1"]["IsLowDeductible"] == 0
    assert f["C2"]["PartBCoverageRatio"] == 0.5 and f["C2"]["FullYearCoverage"] == 0
    assert f["C1"]["FullYearCoverage"] == 1
    assert f["C3"]["IPMonthlyAvg"] is None  # no annual amount column in this fixture


def test_quantiles_exact_linear(spark):
    df = spark.range(1, 11).select(F.col("id").cast("decimal(12,2)").alias("InscClaimAmtReimbursed"),
                                   F.lit("P").alias("Provider"), F.col("id").cast("string").alias("BeneID"))
    q = st.ClaimStats.fit(df).quantiles
    # linear interpolation over 1..10: position (n-1)*p
    assert abs(q["amt_q80"] - 8.2) < 1e-12 and abs(q["amt_q99"] - 9.91) < 1e-12


def test_label_join_paths_agree(spark):
    from claimlens.operators import relational as rel
    labels = spark.createDataFrame([("P1", "Yes"), ("P2", "No"), ("P3", "No")], "Provider string, PotentialFraud string")
    claims = spark.createDataFrame([("C1", "P1", 1), ("C2", "P1", 2), ("C3", "P2", 3), ("C4", "P9", 4)],
                                   "ClaimID string, Provider string, v int")
    a = rel.label_left_claims(labels, claims)                      # broadcast + anti-join rewrite
    b = labels.join(claims, "Provider", "left")    # plain outer join
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    assert a.count() == 4  # P1 x2, P2, P3 with no claims; P9 (unlabelled) dropped


def test_saved_stats_reproduce_batch_fit(spark, sf, tmp_path):
    cleaned = pl.cleaned_claims(spark, sf)
    fitted = st.ClaimStats.fit(cleaned)
    fitted.save(str(tmp_path / "stats"))
    loaded = st.ClaimStats.load(spark, str(tmp_path / "stats"))
    assert loaded.quantiles == fitted.quantiles
    a = pl.finalize_features(pl.with_claim_features(cleaned, fitted), ("ClaimID",))
    b = pl.finalize_features(pl.with_claim_features(cleaned, loaded), ("ClaimID",))
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    # scoring a new batch with saved stats does not refit thresholds on that batch
    batch = cleaned.limit(50)
    assert pl.with_claim_features(batch, loaded).count() == 50
