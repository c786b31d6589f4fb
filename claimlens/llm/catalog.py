"""The registered queries of this subpackage, over the whole of their tables, and the oracle SQL where SQL can state one."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import (compact_windows, decontaminate, hnsw, lattice, neardup, packing, quality, rank_merge, runs, secrets,
                           token_alignment, token_output, url_rules)
from claimlens.llm.stage import id_remainder, new_folder, staged
from claimlens.sources.tables import read_table


def op1_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return lattice.score_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op2_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


#: Every pair of documents that share a shingle, their exact similarity, and everything reachable over links; doc_id is a key of the table.
OP2_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'),
                                                           '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
             FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y USING (s) GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)
"""


def op3_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    held = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    return quality.scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    shards = token_output.write_token_files(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read_token_files(spark, folder, shards)


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_lengths(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op6_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(read_table(spark, sf_dir, "documents"))


def op7_seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = staged(secrets.with_runs(secrets.with_base_spans(docs)).select("doc_id", "base", "runs"), "spans")
    spans = secrets.with_random_spans(found, secrets.structured_bin(found))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return spans.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS)),
                        F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"),
                        secrets.spans_text(F.array_sort(F.concat("base", "random"))).alias("spans"))


def op9_rank_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_merge.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op11_end_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                       public_tokenizers.path("piece_bpe_32k.model"))


# The rules of operator 12 (verdict, host, path).
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op12_url_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_rules.judge_urls(read_table(spark, sf_dir, "pages"), rules)


#: Every rule against every page; the longest fitting one wins.
OP12_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
rest AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, row_number() OVER () AS n,
                 translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
                row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS place
         FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_lattice_score, op2_circulant_minhash, op3_nb_svm_quality, op4_elias_fano_tokens, op5_length_buckets, op6_compact_windows,
             op7_seeded_alignment, op8_randomness_battery, op9_rank_merge_counts, op10_hnsw_search, op11_end_intersection, op12_url_intervals,
             op13_periodic_runs, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The other queries are not stated whole by SQL; each is tested against a brute-force version, a round trip or held-out labels."""
    return {"op2_circulant_minhash": OP2_SQL, "op12_url_intervals": OP12_SQL}
