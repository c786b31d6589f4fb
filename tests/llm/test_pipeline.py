"""The corpus pipeline stage by stage against the stages' brute-force conditions."""
import corpus_pipeline
from claimlens.llm.stage import staged

from test_llm_operators import ODD, base_spans, table


def test_stages_in_order_and_effective(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_dedup", "decontamination", "secret_mask", "packing"]
    out, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, out, sf), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert 0 < len(kept) < before
    assert not any(base_spans(t) for t in kept.values())
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.6 * len(good)
    packed = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in packed) == sorted(kept)


def test_stages_on_odd_and_empty_tables(spark, sf):
    for rows in (ODD, []):
        docs = table(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = staged(stage(spark, docs, sf), name)
            assert docs.columns == table(spark, []).columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
