"""Staged tables: results written once to the cluster's shared folder and read back.

An operator that has to look at the same intermediate rows twice (a prefix sum,
a dense index) writes them here first. A written table survives the loss of any
executor and both passes are certain to see the same rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a scratch folder only in local mode."""
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="limner-")
    spark.conf.set(_SETTING, root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, never used before."""
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/limner/{app}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet to a new shared path and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def discard(staged: DataFrame) -> None:
    """Delete the files of a table that ``stage`` returned, once nothing reads them any more."""
    spark = staged.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(staged.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
