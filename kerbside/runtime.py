"""Session helpers shared by every module: table reading, shared folders, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and make sure a checkpoint folder is set.

    A cluster names its shared folder in ``spark.checkpoint.dir``; only where it
    is unset (tests, a laptop) a fresh local one is made.
    """
    env = spark.sparkContext.environment
    if PACKAGE_ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (PACKAGE_ROOT, env.get("PYTHONPATH")) if p)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    # a batch that crosses to Python is bounded by bytes, not by rows alone: texts can be long
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = os.path.join(tempfile.gettempdir(), f"kerbside-{uuid.uuid4().hex}")
    spark.sparkContext.setCheckpointDir(f"file://{path}")
    return f"file://{path}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; nothing is created yet."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared checkpoint folder and read from there."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)
