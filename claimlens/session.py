"""SparkSession helpers.

On a cluster the session is created by the platform; we only read settings from
it. ``spark.checkpoint.dir`` is honoured when set (shared storage named by the
cluster) and only filled in with a scratch folder when unset, as in tests.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
from collections.abc import Iterator

from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what the planner has measured to be small.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_session(master: str | None = None, app_name: str = "claimlens", **conf: str) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master or not os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or "local[8]")
    for key, value in {**_LOCAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", conf.get("spark.driver.memory", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# The JVM compiles no method above 8,000 bytes of bytecode: the one method that Spark generates for a stage over fifty
# columns is then interpreted throughout. Below the limit Spark keeps it, above it generates many short ones.
_HUGE, _HUGE_LIMIT = "spark.sql.codegen.hugeMethodLimit", "8000"
_PARTS, WAVES = "spark.sql.files.minPartitionNum", 3
# A file counts as 4 MB at least (openCostInBytes), so that a task reads six stage files at most, however large the table.
_PART_BYTES, PART_BYTES = "spark.sql.files.maxPartitionBytes", 24 << 20
_lock, _users, _before = threading.Lock(), [0], {}


@contextlib.contextmanager
def wide_stages(spark: SparkSession) -> Iterator[None]:
    """Settings for stages over wide rows: code that the JVM compiles, and files read in at least ``WAVES`` tasks a core of ``PART_BYTES`` at most.

    Threads may be inside together; the last one to leave puts the session's own settings back."""
    with _lock:
        if not _users[0]:
            _before.update({k: spark.conf.get(k, None) for k in (_HUGE, _PARTS, _PART_BYTES)})
            spark.conf.set(_HUGE, _HUGE_LIMIT)
            spark.conf.set(_PART_BYTES, str(PART_BYTES))
            if _before[_PARTS] is None:
                spark.conf.set(_PARTS, str(WAVES * spark.sparkContext.defaultParallelism))
        _users[0] += 1
    try:
        yield
    finally:
        with _lock:
            _users[0] -= 1
            if not _users[0]:
                for k, v in _before.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Unset, a local session (tests, benches) gets a scratch folder; on a cluster
    that would be a different disk for every machine, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="claimlens-ckpt-"))
        current = sc.getCheckpointDir()
    return current


def recommended_conf(input_bytes: int, executors: int = 1000, cores_per_executor: int = 4,
                     target_partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Cluster settings sized from the input volume (e.g. 100 TB on 1000 executors).

    Shuffle partitions are sized so each holds about ``target_partition_bytes``
    (at least two waves of tasks); AQE coalesces them back when stages shrink
    (the roll-up and the per-provider aggregates are far smaller than the scan)
    and splits skewed join partitions. Scan splits use the same target size.
    """
    slots = executors * cores_per_executor
    partitions = max(2 * slots, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        # Broadcast only what AQE measured to be small; larger sides sort-merge join.
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    }
