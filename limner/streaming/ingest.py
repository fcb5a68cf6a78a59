"""Incremental ingest of shards: locator, quarantine, cache, bounded take, progress."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from limner.operators.indexing import cap_rows
from limner.plans.staging import scratch_path
from limner.sources.tables import path_exists


_PROGRESS = "batch_id long, ts string, input_rows long, rows_per_second double"


def stream_shards(
    spark: SparkSession, root: str, schema: T.StructType, glob: str = "*.parquet", files_per_trigger: int = 1_000
) -> DataFrame:
    """New shards as they arrive, with ``source_shard`` and ``source_row_idx``."""
    rows = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(root)
    )
    return rows.select(
        F.col("_metadata.file_path").alias("source_shard"), F.col("_metadata.row_index").alias("source_row_idx"), *schema.fieldNames()
    )


def _start(df: DataFrame, checkpoint: str | None, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    location = checkpoint or scratch_path(df.sparkSession, "stream")
    return (
        df.writeStream.option("checkpointLocation", location).trigger(availableNow=True).foreachBatch(each).start()
    )


def batch_path(path: str, batch: int) -> str:
    return f"{path}/batch={batch:012d}"


def stream_to_cache(df: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Write-through cache of all available rows; restarts resume at the checkpoint."""
    location = checkpoint or scratch_path(df.sparkSession, "stream")
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", location)
        .trigger(availableNow=True).start()
    )


def read_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of ``schema`` that streams have written below ``path``; none if no batch had any."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def stream_with_quarantine(
    df: DataFrame, good_path: str, bad_path: str, error: str = "error", checkpoint: str | None = None
) -> StreamingQuery:
    """Rows without an error go to one table, the others to a quarantine table.

    Each batch overwrites its own folder, so a replayed batch is not counted twice.
    """
    def split(batch: DataFrame, batch_id: int) -> None:
        batch.filter(F.col(error).isNull()).drop(error).write.mode("overwrite").parquet(batch_path(good_path, batch_id))
        batch.filter(F.col(error).isNotNull()).write.mode("overwrite").parquet(batch_path(bad_path, batch_id))
    return _start(df, checkpoint, split)


def take_good_rows(df: DataFrame, path: str, n: int, checkpoint: str | None = None) -> StreamingQuery:
    """Keep the first ``n`` rows of a stream in locator order within each batch, then only skip.

    What is missing is taken by ``cap_rows``, which looks up the key of the last row instead of bringing many rows to one task.
    """
    spark = df.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        have = 0
        if path_exists(spark, path):
            earlier = spark.read.schema(batch.schema).option("basePath", path).parquet(f"{path}/batch=*")
            number = F.regexp_extract("_metadata.file_path", r"batch=(\d+)", 1).cast("long")
            have = earlier.filter(number < batch_id).count()
        if have < n:
            rows = cap_rows(batch, ["source_shard", "source_row_idx"], n - have)
            rows.write.mode("overwrite").parquet(batch_path(path, batch_id))
    return _start(df, checkpoint, keep)


def stream_with_progress(df: DataFrame, path: str, log_path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Write-through cache whose progress is a table itself: one row for each batch, which outlives the driver.

    Rows are counted while they are written. A batch overwrites its own rows and its own report, so one that is run again
    after a failure counts once. ``read_progress`` reads the reports of all runs over one ``checkpoint``.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        begun = time.time()
        seen = Observation(f"batch-{batch_id}")
        batch.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(batch_path(path, batch_id))
        n = int(seen.get["n"])
        report = (batch_id, datetime.fromtimestamp(begun, UTC).isoformat(), n, n / max(time.time() - begun, 1e-6))
        spark.createDataFrame([report], _PROGRESS).coalesce(1).write.mode("overwrite").parquet(batch_path(log_path, batch_id))

    return _start(df, checkpoint, write)


def read_progress(spark: SparkSession, log_path: str) -> DataFrame:
    """``batch_id, ts, input_rows, rows_per_second`` of all batches ever written by ``stream_with_progress``."""
    if not path_exists(spark, log_path):
        return _progress(spark, [])
    return spark.read.schema(_PROGRESS).parquet(f"{log_path}/batch=*").withColumn("ts", F.to_timestamp("ts"))


class ProgressLog(StreamingQueryListener):
    """Every batch that queries report while the log is open; Spark itself keeps the last 100 of a query only.

    One row of four numbers per batch is held on the driver and lost with it; ``stream_with_progress`` keeps a table.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._batches: dict[str, list[tuple]] = {}
        self._ended: dict[str, threading.Event] = {}

    def __enter__(self) -> ProgressLog:
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self._spark.streams.removeListener(self)

    def _of(self, run_id: object) -> threading.Event:
        return self._ended.setdefault(str(run_id), threading.Event())

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._of(event.runId)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._batches.setdefault(str(p.runId), []).append((int(p.batchId), p.timestamp, int(p.numInputRows), float(p.processedRowsPerSecond or 0.0)))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._of(event.runId).set()

    def table(self, query: StreamingQuery, wait: float = 60.0) -> DataFrame:
        """``batch_id, ts, input_rows, rows_per_second`` of all batches of a query; of one that ended, after its last report."""
        if not query.isActive and not self._of(query.runId).wait(wait):
            raise TimeoutError("the end of the query was not reported")
        return _progress(self._spark, self._batches.get(str(query.runId), []))


def _progress(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    table = spark.createDataFrame(rows, _PROGRESS)
    return table.withColumn("ts", F.to_timestamp("ts"))


def eta(progress: DataFrame, total_rows: int) -> DataFrame:
    """Rows done, mean rate and seconds left."""
    done = progress.agg(
        F.coalesce(F.sum("input_rows"), F.lit(0)).alias("done"), F.coalesce(F.avg("rows_per_second"), F.lit(0.0)).alias("rate")
    )
    left = F.greatest(F.lit(total_rows) - F.col("done"), F.lit(0))
    return done.withColumn("seconds_left", left / F.greatest(F.col("rate"), F.lit(1e-6)))
