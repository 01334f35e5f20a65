"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Sizing for large inputs (used on non-local masters, only where the cluster has not set a value):
# many shuffle partitions that AQE coalesces to ~256 MB each, 256 MB scan splits, skew splitting on.
CLUSTER_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "riskmart") -> SparkSession:
    """Build (or reuse) a session with the settings the engine relies on.

    AQE stays on so that join strategy, partition coalescing and skew splits are decided from
    runtime sizes; the UI is off (batch job, no server).
    """
    master = master or os.environ.get("RISKMART_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # batch jobs: skip the per-call Python call-site capture of the DataFrame API (it adds a
        # session lookup, a conf read and a stack walk to every Column/DataFrame call while the
        # wide feature plans are built); errors still carry the JVM context
        .config("spark.python.sql.dataFrameDebugging.enabled",
                os.environ.get("RISKMART_DF_DEBUGGING", "false"))
        .config("spark.driver.memory", os.environ.get("RISKMART_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    if not master.startswith("local"):
        conf = spark.sparkContext.getConf()
        for k, v in CLUSTER_DEFAULTS.items():
            if not conf.contains(k) and not (k == "spark.sql.shuffle.partitions" and shuffle_partitions):
                spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is; a cluster that does not set it
    is refused. Only local runs and tests get a scratch folder of their own.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="riskmart-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def shared_path(spark: SparkSession, *parts: str) -> str:
    """Path below the shared checkpoint folder (for written intermediate tables)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, *parts])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back: later passes read the table."""
    spark = df.sparkSession
    path = shared_path(spark, name, uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
