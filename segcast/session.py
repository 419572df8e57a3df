"""Session helpers: a tuned local session for tests/bench and checkpoint-dir handling."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "segcast", shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library assumes.

    On a cluster the caller's own session is used as-is; this helper is for
    local runs (tests, bench).  AQE is on so shuffle partition counts adapt to
    the data and skewed partitions are split at runtime.
    """
    master = master or os.environ.get("SEGCAST_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("SEGCAST_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SEGCAST_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, configuring it if needed.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we use it.
    Only a local-mode session without that setting gets a private scratch
    folder (tests); on a cluster a missing setting is an error, because a
    machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    scratch = tempfile.mkdtemp(prefix="segcast-ckpt-", dir="/tmp")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a small shared intermediate as Parquet under the checkpoint folder and read it back.

    Cuts the lineage at files every executor can read: branches share one
    computation, nothing has to be released, and a lost executor costs nothing.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/store/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
