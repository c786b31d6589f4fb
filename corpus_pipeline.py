"""The corpus pipeline: quality filter, near-duplicates, benchmark leaks, secrets, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over everything that
the stage before it kept; ``run`` writes each result as Parquet in the shared
folder of ``spark.checkpoint.dir`` and reads it back as the next one's docs.
All but the last return the columns of ``documents``.

Null and empty texts pass the stages with their operators' defined results: the
quality score decides about them, they are no copies, leak nothing, hold no
secret, and pack as one end token. Repeated rows and rows that share a doc_id
are copies of one document where their texts agree; of other rows that share a
kept doc_id all stay. An empty table gives an empty result. Columns beyond
those of ``documents`` pass through until packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimlens.llm import decontaminate, neardup, packing, quality, secrets
from claimlens.llm.stage import staged
from claimlens.sources.tables import read_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: rows that the quality classifier accepts."""
    return quality.kept_rows(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the document with the smallest id of each near-duplicate group."""
    return neardup.kept_rows(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents without a passage of a benchmark item."""
    return decontaminate.kept_rows(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: every secret replaced by a mask; all documents stay."""
    return secrets.masked_rows(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the token-budget batch and slot of every document."""
    return packing.pack(packing.token_lengths(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_filter", keep_good),
    ("near_dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("secret_mask", mask_secrets),
    ("packing", pack_batches),
]

#: The classifier, the alignment and the vocabulary cannot be stated in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
