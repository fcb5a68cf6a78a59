"""Streaming queries, run until all available input is read."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limner.catalog import bindings as B
from limner.catalog.registry import having, query
from limner.operators.images import image_dims
from limner.plans.staging import scratch_path, stage
from limner.schemas import fields
from limner.sources import shards
from limner.streaming import ingest as I
from limner.streaming import state as S

VECTOR_SHARD = fields(vec_id=T.LongType(), embedding=T.ArrayType(T.FloatType()), label=T.IntegerType())
ORDER_SHARD = fields(o_orderkey=T.LongType(), o_custkey=T.LongType(), o_orderstatus=T.StringType(), o_totalprice=T.DoubleType())


def _stream(spark: SparkSession, sf: str, name: str, schema: T.StructType) -> DataFrame:
    """A table as it arrives, be it stored as a file or as a folder of part files: a pattern (here of one name) stands for both."""
    return I.stream_shards(spark, f"{sf}/{{{name}.parquet}}", schema, "*")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return _stream(spark, sf, "documents", B.DOCUMENT_SHARD)


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream(spark, sf, "orders", ORDER_SHARD)
    sized = rows.select(
        "source_shard", "source_row_idx", (1 + F.col("o_custkey") % 4000).alias("w"), (1 + F.floor("o_totalprice") % 3000).alias("h"), "o_orderkey"
    )
    whole = B.png_payload(F.col("w"), F.col("h"))
    payload = F.when(F.col("o_orderkey") % 97 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    return image_dims(sized.select("source_shard", "source_row_idx", "o_orderkey", payload.alias("payload")), "payload", jpeg=False).drop("payload")


@query("SELECT doc_id AS source_row_idx, doc_id, md5(text) AS image_hash FROM documents")
def streamed_rows_cache(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "stream-cache")
    starts = stage(shards.part_starts(B.shards(spark, sf, "documents", B.DOCUMENT_SHARD, [])), "part-starts")
    rows = shards.whole_shards(_documents(spark, sf), starts)
    rows = rows.select("source_row_idx", "doc_id", F.md5(F.encode("text", "UTF-8")).alias("image_hash"))
    I.stream_to_cache(rows, path).awaitTermination()
    return I.read_rows(spark, path, rows.schema)


@query("SELECT doc_id FROM documents")
def streamed_cache_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs over one checkpoint: the second goes on behind the first and adds no row again."""
    path, checkpoint = scratch_path(spark, "resumed-cache"), scratch_path(spark, "resumed-state")
    for _ in range(2):
        rows = _documents(spark, sf).select("doc_id")
        I.stream_to_cache(rows, path, checkpoint).awaitTermination()
    return I.read_rows(spark, path, rows.schema)


@query("SELECT DISTINCT md5(text) AS image_hash FROM documents")
def streamed_unique_hashes(spark: SparkSession, sf: str) -> DataFrame:
    hashes = _documents(spark, sf).select(F.md5(F.encode("text", "UTF-8")).alias("image_hash"))
    return S.drain(S.stream_dedupe(hashes, "image_hash"), "unique", "append")


@query("SELECT 'style' AS dim, lang AS class_id, count(*) AS n FROM documents GROUP BY 1, 2 UNION ALL SELECT 'genre', source, count(*) FROM documents GROUP BY 1, 2")
def streamed_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _documents(spark, sf).select(F.col("lang").alias("style"), F.col("source").alias("genre"))
    return S.drain(S.stream_class_counts(rows, ["style", "genre"]), "class-counts")


@query(having(B.GEOM, B.PNG, then="SELECT error IS NULL AS valid, count(*) AS n, CAST(sum(width) AS BIGINT) AS total_width FROM png GROUP BY 1"))
def streamed_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    rows = _payloads(spark, sf)
    I.stream_with_quarantine(rows, good, bad).awaitTermination()
    counted = lambda path, flag: I.read_rows(spark, path, rows.schema if not flag else rows.drop("error").schema).agg(
        F.lit(flag).alias("valid"), F.count("*").alias("n"), F.sum("width").alias("total_width")
    ).where("n > 0")
    return counted(good, True).unionByName(counted(bad, False))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 150")
def streamed_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "first")
    rows = _documents(spark, sf).select("source_shard", "source_row_idx", "doc_id")
    I.take_good_rows(rows, path, 150).awaitTermination()
    return I.read_rows(spark, path, rows.schema).select("doc_id")


@query(having(B.VEC, B.SCORES, then="SELECT vec_id, pred_label, true_rank FROM preds"))
def streamed_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored_stream(spark, sf, lambda df: df.select("vec_id", "pred_label", "true_rank"), "append")


@query(having(B.VEC, B.SCORES, then="SELECT count(*) AS n_images, round(avg((pred_label = true_label)::INTEGER), 9) AS top1_accuracy FROM preds"))
def streamed_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(_scored_stream(spark, sf, lambda df: S.stream_accuracy(df.withColumnRenamed("label", "true_label")), "complete"))


def _scored_stream(spark: SparkSession, sf: str, then, mode: str) -> DataFrame:
    rows = B.bank_rows(spark, sf)
    bank = B.bank_of(rows)
    prompts = rows.select(F.col("bank_id").alias("vec_id"))
    items = _stream(spark, sf, "embeddings", VECTOR_SHARD).join(prompts, "vec_id", "left_anti")
    return S.drain(then(S.stream_score(items, bank, "embedding", "label")), "scores", mode)


@query("SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, count(*) AS reported, CAST(4 AS BIGINT) AS batches FROM documents")
def streamed_progress_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A stream over four shards that fails in its third batch and is started again: rows and reports of both runs, each once."""
    shards, path, log, checkpoint = (scratch_path(spark, f"resumed-{x}") for x in ("shards", "rows", "log", "state"))
    docs = B.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 4).alias("part"))
    for part in range(4):
        docs.where(F.col("part") == part).coalesce(1).write.mode("append").parquet(shards)
    schema = fields(doc_id=T.LongType(), part=T.LongType())

    def run(rows: DataFrame) -> None:
        I.stream_with_progress(rows, path, log, checkpoint).awaitTermination()

    rows = I.stream_shards(spark, shards, schema, files_per_trigger=1)
    third = F.when(F.col("part") == 2, F.raise_error(F.lit("this shard is not there yet")).cast("bigint")).otherwise(F.col("part"))
    try:
        run(rows.withColumn("part", third))
    except StreamingQueryException:  # as asked for; the second run goes on with the batch that failed
        run(rows)
    kept = spark.read.schema(rows.schema).parquet(f"{path}/batch=*")
    told = I.read_progress(spark, log).agg(F.sum("input_rows").alias("reported"), F.count("*").alias("batches"))
    return kept.agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_ids")).join(F.broadcast(told))


@query("SELECT count(*) AS done FROM documents")
def streamed_progress(spark: SparkSession, sf: str) -> DataFrame:
    with I.ProgressLog(spark) as log:
        run = I.stream_to_cache(_documents(spark, sf).select("doc_id"), scratch_path(spark, "progress"))
        run.awaitTermination()
        return I.eta(log.table(run), 0).select("done")
