"""Stage boundaries: write an intermediate table once and read it back.

A DataFrame used by several branches of a plan (a roll-up feeding statistics,
quantiles and the feature projection) would otherwise be recomputed per branch.
Writing it as Parquet under the session's shared checkpoint folder
(``spark.checkpoint.dir``) computes it once, cuts the lineage (a lost executor
does not trigger recomputation from the raw scans) and gives later reads
column pruning and filter pushdown.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame

from claimlens.session import ensure_checkpoint_dir, wide_stages


#: Buckets of a table at most; Spark refuses more than 100,000.
MAX_BUCKETS = 16_384
#: Rows of a file at most, so that a reader can deal the files evenly to its tasks.
FILE_ROWS = 50_000


def _folder(spark) -> str:
    """This application's own part of the shared folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "tables", spark.sparkContext.applicationId)


def materialize(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    With ``bucket_by`` the table is written bucketed (and sorted) on that key as
    an external table in the same shared folder: later joins and aggregations on
    the key between frames derived from it need no shuffle.
    """
    spark = df.sparkSession
    tag = f"{name}_{uuid.uuid4().hex}"
    path = os.path.join(_folder(spark), tag)
    if bucket_by is None:
        with wide_stages(spark):
            df.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
        return spark.read.parquet(path)
    n = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS)
    # Dealt by the bucket key first, so each bucket is one file whatever the number of tasks.
    (df.repartition(n, bucket_by).write.mode("overwrite").option("path", path).bucketBy(n, bucket_by).sortBy(bucket_by)
       .saveAsTable(f"claimlens_{tag}"))
    return spark.table(f"claimlens_{tag}")


def drop_materialized(spark) -> None:
    """Remove every stage table this session wrote (call at the end of a job, after its last action).

    Uses the Hadoop FileSystem of the checkpoint folder, so it works on HDFS / object stores."""
    for t in spark.catalog.listTables():
        if t.name.startswith("claimlens_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    root = _folder(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)
