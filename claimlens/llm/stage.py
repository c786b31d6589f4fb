"""Stage tables and small helpers shared by the operators of this subpackage.

Intermediate results that several later steps read are written once under the
shared folder of ``spark.checkpoint.dir`` and read back: that cuts the lineage,
and a lost executor costs a re-read, never a recomputation of the whole job.
"""

from __future__ import annotations

import gc
import time
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.session import ensure_checkpoint_dir


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join of two tables that grow with the input: they are dealt by the key and merged, never broadcast.

    Spark broadcasts what it sizes below a threshold, by the files of a staged table (packed, some columns of many), or without
    the rows that an explode adds; in the driver's memory the same rows take ten times that and more."""
    return df.hint("merge")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path (not yet created) in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, ``file_rows`` rows a file at most where given, and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a ``staged`` table, once everything made from it has been written itself.

    Through the Hadoop file system of the shared folder; plans that still read the table fail from now on."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished queries removed now.

    Spark does so once the driver's garbage collector finds their plans unused, which on an idle driver heap
    may take longer than the next large step. Python's references reach the JVM within about a second, and
    the last query's plan stays referenced until another one has run."""
    gc.collect()
    spark.range(1).count()
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def id_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id gives null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def py_id_remainder(value, modulus: int):
    return None if value is None else zlib.crc32(str(value).encode()) % modulus


def struct_type(spec: str) -> T.StructType:
    """'a long, b double' as a schema."""
    return T.StructType.fromDDL(spec)
