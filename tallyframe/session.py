"""Session helpers: one place for the settings the operators assume."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "tallyframe",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the cluster's own session instead."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A folder that the session already uses stays; else the cluster's setting holds. A scratch
    folder is only created in local mode (tests), where all tasks share the driver's disk.
    """
    used = spark.sparkContext._jsc.sc().getCheckpointDir()
    d = spark.conf.get("spark.checkpoint.dir", None)
    if used.isDefined():
        return used.get()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tallyframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once as Parquet to the checkpoint folder and read from there: a few bytes a
    row, columns that a step does not need are not read, and the planner knows the size."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
