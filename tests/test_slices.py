"""Slices stay even for digests and shared prefixes; oversampling is exact at any partition count; stage folders."""
import pytest
from pyspark.sql import functions as F

from claimlens.operators.oversample import smote
from claimlens.operators.ranking import slice_column
from claimlens.session import wide_stages
from claimlens.sources.materialize import materialize


@pytest.mark.parametrize("n", [8, 200])
@pytest.mark.parametrize("kind", ["digest", "prefix"])
def test_largest_slice_share(spark, n, kind):
    ids = spark.range(20_000)
    if kind == "digest":
        df, uniform = ids.select(F.md5(F.col("id").cast("string")).alias("k")), True
    else:
        df, uniform = ids.select(F.format_string("CLM_2024%06d", "id").alias("k")), False
    out, name = slice_column(df, "k", n, uniform=uniform)
    sizes = [r["count"] for r in out.groupBy(name).count().collect()]
    assert max(sizes) <= 2 * 20_000 / n


@pytest.mark.parametrize("partitions", ["1", "8", "200"])
def test_smote_count_is_the_need(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(500).select(F.col("id").cast("string").alias("key"), (F.col("id") < 100).cast("int").alias("label"),
                                     F.rand(3).alias("x"), F.rand(4).alias("y"))
        assert smote(df, "label", ["x", "y"], "key").count() == 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_smote_of_a_single_row_copies_it(spark):
    df = spark.createDataFrame([("a", 1, 2.0)] + [(f"b{i}", 0, float(i)) for i in range(4)], "key string, label int, x double")
    rows = smote(df, "label", ["x"], "key").collect()
    assert len(rows) == 3 and {r["x"] for r in rows} == {2.0}


def test_bucketed_table_beyond_the_bucket_limit(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200000")
    try:
        assert materialize(spark.range(10), "tiny", bucket_by="id", buckets=8).count() == 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_fits_task_reads_six_files_at_most(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.range(30).repartition(30).write.parquet(path)
    name, files = "spark.sql.files.minPartitionNum", len(list((tmp_path / "files").glob("*.parquet")))
    before = spark.conf.get(name, None)
    spark.conf.set(name, "1")
    try:
        with wide_stages(spark):
            assert spark.read.parquet(path).rdd.getNumPartitions() >= files / 6
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") != str(24 << 20)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
