"""A corpus in five stages: language, toxicity, repeated lines, near duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written and read again as the next
stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limner.llm.byte_cnn import fit_language_model, with_language
from limner.llm.catalog import remainder
from limner.llm.line_dedup import without_repeated_lines
from limner.llm.ngram_join import shingle_groups
from limner.llm.packing import packed_documents
from limner.llm.toxicity import fit_toxicity, without_toxic
from limner.plans.staging import stage

#: A text whose best language has less probability than this is in none of the languages.
MIN_LANGUAGE_SCORE = 0.3


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts in no learned language; without labelled texts, all texts go."""
    return with_language(docs, fit_language_model(docs, remainder(4) != 2), MIN_LANGUAGE_SCORE)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts called toxic; without toxic labels none are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, fit_toxicity(docs, labels, remainder(5) != 0))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep a line only in the first document that has it; documents stay, also those without lines left."""
    return without_repeated_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest ``doc_id`` of each group of near duplicates, and all rows without an id.

    Of rows that repeat a kept ``doc_id`` with the same text one is kept, the first by the other columns.
    """
    groups = shingle_groups(docs)
    dropped = groups.where("doc_id <> component_id").select("doc_id").distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(dropped, "doc_id", "left_anti")
    # ids are counted first, so that only the texts of repeated ones are shuffled
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    same = Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy(*[c for c, name in zip(columns, docs.columns, strict=True) if name not in ("doc_id", "text")], F.length("text"))
    once = kept.join(repeated, "doc_id", "left_semi").withColumn("_turn", F.row_number().over(same)).where("_turn = 1")
    return kept.join(repeated, "doc_id", "left_anti").select(*columns).unionByName(once.select(*columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences."""
    return packed_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_languages),
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_near),
    ("best_fit_packing", pack),
]

#: The trained stages have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
