"""How the given tables stand in for image shards, vectors, run metrics and detections.

Each binding exists twice: as a DataFrame and as a common table for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limner.functions.vectors import as_double
from limner.operators.images import geometry_features
from limner.operators.scoring import Bank, load_bank, predict, score_classes
from limner.plans.joins import if_small
from limner.schemas import fields
from limner.sources.shards import read_shards

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

DOCUMENT_SHARD = fields(
    doc_id=T.LongType(), text=T.StringType(), lang=T.StringType(), source=T.StringType(), n_chars=T.LongType()
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shards(spark: SparkSession, sf: str, name: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """A table as shards with their locator, be it stored as a file or as a folder of part files."""
    return read_shards(spark, f"{sf}/{name}.parquet", schema, columns, glob="*")


def rounded(df: DataFrame, digits: int = 9, **digits_of: int) -> DataFrame:
    """Round all double columns, so that the order of a sum does not show."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits_of.get(c, digits)) for c in doubles})


# Documents as image payloads.
DOCS = """docs AS (SELECT doc_id, source AS source_shard, doc_id AS source_row_idx, lang AS style, source AS genre,
  md5(text) AS image_hash, CAST(strlen(text) AS BIGINT) AS bytes_size FROM documents)"""


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        F.col("source").alias("source_shard"),
        F.col("doc_id").alias("source_row_idx"),
        F.col("lang").alias("style"),
        F.col("source").alias("genre"),
        F.md5(F.encode("text", "UTF-8")).alias("image_hash"),
        F.octet_length("text").cast("bigint").alias("bytes_size"),
    )


# Orders as an index of images with geometry.
GEOM = """geom AS (SELECT 1 + o_custkey % 4000 AS width, 1 + CAST(floor(o_totalprice) AS BIGINT) % 3000 AS height,
  CAST(floor(o_totalprice * 2) AS BIGINT) AS bytes_size, least(o_custkey % 27, o_orderkey % 27) AS style,
  o_orderpriority AS genre, o_custkey AS artist, o_orderstatus AS source_shard, o_orderkey AS source_row_idx FROM orders)"""

FEAT = """feat AS (SELECT *, width * height AS pixels, (width * height) / 1e6 AS megapixels,
  width / greatest(height, 1) AS aspect_ratio,
  CASE WHEN width = height THEN 'square' WHEN width > height THEN 'landscape' ELSE 'portrait' END AS orientation,
  bytes_size / (width * height) AS bytes_per_pixel,
  abs(ln(greatest(width / greatest(height, 1), 1e-6))) AS abs_log_aspect FROM geom)"""


def geom(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        (1 + F.col("o_custkey") % 4000).alias("width"),
        (1 + F.floor("o_totalprice") % 3000).alias("height"),
        F.floor(F.col("o_totalprice") * 2).alias("bytes_size"),
        F.least(F.col("o_custkey") % 27, F.col("o_orderkey") % 27).alias("style"),
        F.col("o_orderpriority").alias("genre"),
        F.col("o_custkey").alias("artist"),
        F.col("o_orderstatus").alias("source_shard"),
        F.col("o_orderkey").alias("source_row_idx"),
    )


def feat(spark: SparkSession, sf: str) -> DataFrame:
    return geometry_features(geom(spark, sf))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

# Orders as encoded PNG headers; every 97th one is cut short.
PNG = """png AS (SELECT source_shard, source_row_idx,
  CASE WHEN source_row_idx % 97 = 0 THEN NULL ELSE width END AS width,
  CASE WHEN source_row_idx % 97 = 0 THEN NULL ELSE height END AS height,
  CASE WHEN source_row_idx % 97 = 0 THEN 'truncated header' END AS error FROM geom)"""


def png_payload(width: Column, height: Column) -> Column:
    size = F.concat(*[F.lpad(F.hex(x), 8, "0") for x in (width, height)])
    return F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), size))


def png(spark: SparkSession, sf: str) -> DataFrame:
    base = geom(spark, sf)
    whole = png_payload(F.col("width"), F.col("height"))
    cut = F.when(F.col("source_row_idx") % 97 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    return base.select("source_shard", "source_row_idx", "style", "genre", "artist", cut.alias("payload"))


# Embeddings as items, the first three of each label as the prompts of that class.
VEC = """emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
bank AS (SELECT label AS class_id, rn - 1 AS template_id, vec_id AS bank_id, v AS w FROM emb WHERE rn <= 3),
items AS (SELECT vec_id, label, v FROM emb WHERE rn > 3)"""

SCORES = """scores AS (SELECT i.vec_id, i.label, b.class_id, max(list_cosine_similarity(i.v, b.w)) AS score
  FROM items i CROSS JOIN bank b GROUP BY i.vec_id, i.label, b.class_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class_id) AS place FROM scores),
preds AS (SELECT vec_id, any_value(label) AS true_label, max(CASE WHEN place = 1 THEN class_id END) AS pred_label,
  CAST(max(CASE WHEN class_id = label THEN place END) AS INTEGER) AS true_rank FROM placed GROUP BY vec_id)"""

N_PROMPTS = 3


def bank_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``class_id, template_id, bank_id, vector``; three rows per label."""

    order = Window.partitionBy("label").orderBy("vec_id")
    ranked = table(spark, sf, "embeddings").withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= N_PROMPTS)
    return ranked.select(
        F.col("label").alias("class_id"),
        (F.col("_rn") - 1).alias("template_id"),
        F.col("vec_id").alias("bank_id"),
        F.col("embedding").alias("vector"),
    )


def items_and_bank(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = bank_rows(spark, sf)
    small = if_small(rows)
    bank = rows if small is None else small
    ids = bank.select(F.col("bank_id").alias("vec_id"))
    ids = ids if small is None else F.broadcast(ids)
    items = table(spark, sf, "embeddings").join(ids, "vec_id", "left_anti")
    return items.select("vec_id", "label", "embedding"), bank


def bank_of(rows: DataFrame) -> Bank:
    bank = load_bank(rows)
    if bank is None:
        raise ValueError("the bank of this binding has three rows per label and always fits")
    return bank


def scored(spark: SparkSession, sf: str) -> tuple[DataFrame, Bank]:
    """Items with ``class_scores``."""
    items, rows = items_and_bank(spark, sf)
    bank = bank_of(rows)
    return score_classes(items, bank, "embedding"), bank


def predicted(spark: SparkSession, sf: str) -> tuple[DataFrame, Bank]:
    """Items with ``true_label, pred_label, true_rank`` and their scores."""
    df, bank = scored(spark, sf)
    return predict(df, bank.class_ids, "label").withColumnRenamed("label", "true_label"), bank


# Embeddings as pairs: the first half is x, the second half is y.
PAIRS = """pairs AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:32] AS x, CAST(embedding AS DOUBLE[])[33:64] AS y FROM embeddings)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = as_double(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.slice(v, 1, 32).alias("x"), F.slice(v, 33, 32).alias("y"))


# Events as metrics of runs: a run per day, a target per event type, six models.
RUNS = """runs AS (SELECT 'run_' || strftime(ts, '%Y%m%d') AS run_id, event_type AS target,
  CASE user_id % 6 WHEN 0 THEN 'linear_map::img=>txt' WHEN 1 THEN 'trackB::tuned'
    ELSE 'lab/m' || CAST(user_id % 6 AS VARCHAR) END AS model_id,
  count(*) AS n_images, avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS top1_accuracy,
  avg(CASE WHEN value > 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS top5_accuracy,
  round(avg(value), 6) AS images_per_second, round(sum(value) / 100, 6) AS elapsed_seconds
  FROM events GROUP BY 1, 2, 3)"""


def model_of(user: Column) -> Column:
    kind = user % 6
    return (
        F.when(kind == 0, "linear_map::img=>txt")
        .when(kind == 1, "trackB::tuned")
        .otherwise(F.concat(F.lit("lab/m"), kind.cast("string")))
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda limit: F.avg((F.col("value") > limit).cast("double"))
    return (
        table(spark, sf, "events")
        .groupBy(
            F.concat(F.lit("run_"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
            F.col("event_type").alias("target"),
            model_of(F.col("user_id")).alias("model_id"),
        )
        .agg(
            F.count("*").alias("n_images"),
            share(50).alias("top1_accuracy"),
            share(10).alias("top5_accuracy"),
            F.round(F.avg("value"), 6).alias("images_per_second"),
            F.round(F.sum("value") / 100, 6).alias("elapsed_seconds"),
        )
    )


TARGETS = ["click", "error", "purchase", "signup", "view"]

# Labelled documents as binary truths with a score.
BINARY = """binary_rows AS (SELECT d.doc_id, t.label, t.truth, (d.n_chars % 1000) / 1000 AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  CROSS JOIN LATERAL (VALUES ('quality', l.quality), ('toxic', l.toxic)) AS t(label, truth))"""


def binary_wide(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """``(scores, truth)``, one column per label each."""
    score = (F.col("n_chars") % 1000) / 1000
    scores = table(spark, sf, "documents").select("doc_id", score.alias("quality"), score.alias("toxic"))
    return scores, table(spark, sf, "labels").select("doc_id", "quality", "toxic")


def binary_rows(spark: SparkSession, sf: str) -> DataFrame:
    from limner.operators.metrics import align_truth

    scores, truth = binary_wide(spark, sf)
    return align_truth(scores, truth, ["doc_id"], ["quality", "toxic"])


# Events as detections: an item per user and day.
EVENT_LABELS = {
    "purchase": "cat", "click": "cash", "error": "geometric shapes", "signup": "abstract art", "view": "painting",
}
LABELS = list(EVENT_LABELS.values())

DETECTIONS = """hits AS (SELECT user_id, strftime(ts, '%Y%m%d') AS day,
  CASE event_type WHEN 'purchase' THEN 'cat' WHEN 'click' THEN 'cash' WHEN 'error' THEN 'geometric shapes'
    WHEN 'signup' THEN 'abstract art' WHEN 'view' THEN 'painting' END AS label, value / 500 AS score FROM events),
best AS (SELECT user_id, day, label, max(score) AS score FROM hits GROUP BY ALL)"""


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """``user_id, day, label, score``, one row per event."""
    label = F.lit(None).cast("string")
    for event, name in EVENT_LABELS.items():
        label = F.when(F.col("event_type") == event, name).otherwise(label)
    return table(spark, sf, "events").select(
        "user_id", F.date_format("ts", "yyyyMMdd").alias("day"), label.alias("label"), (F.col("value") / 500).alias("score")
    )


def best_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Best score per item and label."""
    return hits(spark, sf).groupBy("user_id", "day", "label").agg(F.max("score").alias("score"))


# Line items as a training log: an epoch per line number, a phase per line status.
LOG = """log AS (SELECT l_linenumber AS epoch, l_linestatus AS phase, l_discount AS loss,
  CAST(floor(l_quantity) AS BIGINT) AS n,
  CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_quantity) AS BIGINT) ELSE 0 END AS correct FROM lineitem)"""


def training_log(spark: SparkSession, sf: str) -> DataFrame:
    n = F.floor("l_quantity")
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("epoch"),
        F.col("l_linestatus").alias("phase"),
        F.col("l_discount").alias("loss"),
        n.alias("n"),
        F.when(F.col("l_returnflag") == "R", n).otherwise(0).alias("correct"),
    )
