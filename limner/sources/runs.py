"""Metric files of finished runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limner.schemas import METRICS_DOCUMENT, METRICS_LONG


def _matching(spark: SparkSession, root: str, patterns: Sequence[str]) -> list[str]:
    """Existing paths that match any of the patterns, each once."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found: set[str] = set()
    for pattern in patterns:
        path = hadoop.Path(f"{root.rstrip('/')}/{pattern}")
        fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        found.update(str(s.getPath()) for s in fs.globStatus(path) or [])
    return sorted(found)


def count_runs(spark: SparkSession, root: str, run_globs: Sequence[str], file: str = "summary/metrics_long.csv") -> int:
    """Run folders with a metric table that match any of the patterns, each once."""
    return len(_matching(spark, root, [f"{glob.rstrip('/')}/{file}" for glob in run_globs]))


def read_runs(
    spark: SparkSession, root: str, run_globs: Sequence[str], file: str = "summary/metrics_long.csv"
) -> list[DataFrame]:
    """Metric tables of all run folders that match, one frame per distinct header.

    A folder matched by several patterns counts once; folders without the file
    and tables without rows add nothing. ``run_id`` falls back to the folder name.
    ``file`` is looked up below each folder and may be a pattern.
    """
    files = _matching(spark, root, [f"{glob.rstrip('/')}/{file}" for glob in run_globs])
    if not files:
        return []
    depth = file.count("/") + 1
    folder = F.element_at(F.split("_metadata.file_path", "/"), -1 - depth)
    # The headers decide how to read the tables. Each is the line at offset 0 of its file; they are grouped on the executors, and the
    # driver sees one row for each distinct header, with the names of its files, which it lists anyway.
    lines = spark.read.text(files).select(F.rtrim("value").alias("header"), F.col("_metadata.file_path").alias("path"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    heads = lines.groupBy("path").agg(F.min_by("header", "at").alias("header")).where("header <> ''")
    frames = []
    for r in heads.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect():
        cols = [c.strip().strip('"') for c in r["header"].split(",")]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
        df = spark.read.schema(schema).option("header", True).csv(r["paths"])
        frames.append(df if "run_id" in cols else df.withColumn("run_id", folder))
    return frames


def collect_metrics(spark: SparkSession, root: str, models: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Long metrics rows from ``<root>/<run>/<target>/metrics_<tag>.json``.

    ``models`` has ``model_id, tag``. All documents are read in one scan; run,
    target and tag come from the path. Models and targets without a document
    give no row.
    """
    files = _matching(spark, root, [f"*/{t}/metrics_*.json" for t in targets])
    if not files:
        return spark.createDataFrame([], METRICS_LONG)
    docs = spark.read.schema(METRICS_DOCUMENT).option("multiLine", True).json(files)
    path = F.col("_metadata.file_path")
    # a document written by Spark is a folder of that name with one file
    part = lambda i: F.regexp_extract(path, r"([^/]+)/([^/]+)/metrics_([^/]+)\.json(?:/part-[^/]*)?$", i)
    located = docs.select("*", F.regexp_replace(path, r"(?<=\.json)/part-[^/]*$", "").alias("metrics_path"), part(1).alias("run_id"), part(2).alias("_target"), part(3).alias("tag"))
    folder = F.regexp_replace("metrics_path", r"/metrics_[^/]+$", "")
    return located.join(models, "tag").select(
        "run_id",
        F.col("_target").alias("target"),
        "model_id",
        "n_images",
        "top1_accuracy",
        "top5_accuracy",
        "elapsed_seconds",
        "images_per_second",
        "metrics_path",
        F.concat(folder, F.lit("/predictions_"), "tag", F.lit(".parquet")).alias("predictions_path"),
    )
