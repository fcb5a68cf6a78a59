"""Stateful and stateless transformations of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limner.operators.scoring import Bank, predict, score_classes
from limner.plans.staging import scratch_path
from limner.sources.tables import path_exists
from limner.streaming.ingest import batch_path


def stream_dedupe(df: DataFrame, hash_col: str, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """First occurrence of each hash.

    Without an event time every hash seen is kept as state for good, one key per
    distinct hash; with one, state older than ``delay`` is dropped.
    """
    if event_time is None:
        return df.dropDuplicates([hash_col])
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([hash_col])


def stream_class_counts(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Running rows per class for several dimensions: ``dim, class_id, n``."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("class_id")) for d in dims])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.dim", "p.class_id").agg(F.count("*").alias("n"))


def stream_accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running rows and top-1 accuracy of a stream with ``true_label`` and ``pred_label``; no prediction is a miss."""
    hit = F.coalesce(F.col("pred_label") == F.col("true_label"), F.lit(False)).cast("double")
    return df.groupBy(*by).agg(F.count("*").alias("n_images"), F.avg(hit).alias("top1_accuracy"))


def stream_score(df: DataFrame, bank: Bank, vector: str, truth: str | None = None) -> DataFrame:
    """Score and predict; the same functions as in batch, and no state."""
    return predict(score_classes(df, bank, vector), bank.class_ids, truth)


def drain(df: DataFrame, name: str, mode: str = "complete", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run an aggregated stream over all that is available and return its last result.

    The result is written to the shared folder after each batch, not held on the driver. Given the ``path`` and
    ``checkpoint`` of an earlier run, it goes on where that one ended or failed. Every appended batch has its
    own folder, so a replayed batch is not counted twice.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else batch_path(path, number))

    query = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-state"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    if not path_exists(spark, path):
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(path if mode == "complete" else f"{path}/batch=*")
