"""Session helpers.

Cluster settings (checkpoint folder, shuffle partitions, AQE) come from the
session the caller built; ``local_session`` is for tests and the bench only.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SPREAD_KEY = "spark.slantscan.spread"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "slantscan") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SLANTSCAN_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # HotSpot never compiles a method of over 8,000 bytes; the rule chains exceed it in one codegen span
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``. Where it is unset, a
    one-machine session (tests, bench) gets a scratch folder; any other is
    refused, because executors would not see a machine-local one."""
    d = spark.conf.get(CHECKPOINT_KEY, None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="slantscan-ckpt-")
        spark.conf.set(CHECKPOINT_KEY, d)
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001  (Spark Connect: no SparkContext; checkpoint() reads the conf)
        pass
    return d


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage is cut and
    its size is known to the optimizer. The table goes when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # a session that has ended, or no JVM (Spark Connect): files stay
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a CPU-bound stage out over ``spark.slantscan.spread`` partitions.

    Off unless the session names a number: a table in few large row groups is
    scored by as many tasks, and only the caller knows whether a shuffle of the
    text is worth it (``spark.sql.files.maxPartitionBytes`` is the usual tool).
    Rows are dealt round-robin, which Spark makes repeatable by a sort.
    Streams are never dealt out.
    """
    n = int(df.sparkSession.conf.get(SPREAD_KEY, "0"))
    return df.repartition(n) if n > 0 and not df.isStreaming else df
