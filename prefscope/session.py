"""Session helpers for tests and the benchmark.

Library operators never create a session; they take and return DataFrames.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "prefscope") -> SparkSession:
    """A local session configured the way the tests and bench expect: AQE on
    (coalescing, skew-join splitting), UI off, UTC, ANSI mode as default."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PREFSCOPE_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the application
    ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/prefscope-{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors for data that must outlive an
    executor: ``spark.checkpoint.dir`` of the session. Where it is unset, a
    local master (driver and executors are one process) gets a scratch folder
    once; on a cluster that would be a machine-local folder, so it raises."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if path is None and current is not None:
        return current
    if path is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: it must name a folder that the "
                "driver and all executors share")
        path = tempfile.mkdtemp(prefix="prefscope-ckpt-")
    if current is None:
        sc.setCheckpointDir(path)
    return path
