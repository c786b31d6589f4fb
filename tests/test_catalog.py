"""Driver contract and a sample of oracle comparisons at sf0.001."""
import decimal

import duckdb
import pytest

import __spark_entry__ as entry_mod
from claimlens.sources.tables import TABLES


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0 and "provider_id" in df.columns


def test_every_oracle_has_a_query():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return v.normalize()
    return v


@pytest.mark.parametrize("key", ["provider_statistics", "claim_rollup", "feature_table", "roc_auc",
                                 "stratified_kfold", "label_contrast", "investigation_queue", "risk_factors"])
def test_oracle_sample(spark, sf, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sdf = entry_mod.queries()[key](spark, sf)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = con.execute(entry_mod.oracle_sql()[key])
    names = [d[0] for d in rel.description]
    orows = sorted((tuple(_norm(dict(zip(names, r))[c]) for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted(names) == cols and srows == orows
