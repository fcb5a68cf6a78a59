"""A run from its index to its summary: fetch, score, predictions, metrics, leaderboard, summary document and page."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limner.functions.numbers import fixed, round_exact
from limner.operators.leaderboard import best_per_target, leaderboard
from limner.operators.metrics import metrics_record
from limner.operators.scoring import Bank, predict, score_classes
from limner.plans.staging import stage
from limner.sinks.documents import summary_document, table_row
from limner.sinks.tables import write_document, write_predictions
from limner.sources.runs import collect_metrics
from limner.sources.shards import fetch_indexed
from limner.sources.tables import path_exists

KEYS = ("source_shard", "source_row_idx")


def tag_of(model_id: str) -> str:
    return model_id.replace("/", "__")


def evaluate_model(
    index: DataFrame, shards: DataFrame, encode: Callable[[DataFrame], DataFrame], bank: Bank, names: DataFrame, folder: str,
    model_id: str, target: str, truth: str, vector: str = "vector",
) -> None:
    """Score the rows that ``index`` points at and leave predictions and a metrics document in ``folder``, unless both are there.

    ``encode`` adds ``vector`` to the rows, NULL for those that cannot be encoded; these have no prediction and do not count, like
    index rows without a shard row or without a label. ``names`` has ``class_id, name``.
    """
    spark = index.sparkSession
    predictions, metrics = (f"{folder}/{kind}_{tag_of(model_id)}.{ending}" for kind, ending in (("predictions", "parquet"), ("metrics", "json")))
    if path_exists(spark, predictions) and path_exists(spark, metrics):
        return
    begun = time.time()
    rows = fetch_indexed(shards, index.where(F.col(truth) >= 0).select(*KEYS, F.col(truth).alias("true_label")))
    scored = score_classes(encode(rows).where(F.col(vector).isNotNull()), bank, vector)
    done = stage(predict(scored, bank.class_ids, "true_label").select(*KEYS, "true_label", "pred_label", "true_rank", "class_scores"), "predictions")
    labels = {r.class_id: r["name"] for r in names.collect()}
    write_predictions(done, predictions, [labels[c] for c in bank.class_ids], mode="overwrite")
    record = metrics_record(done, names)
    seconds = F.lit(time.time() - begun)
    document = record.select(
        F.lit(model_id).alias("model"), F.lit(target).alias("target"), "n_images", "top1_accuracy", "top5_accuracy",
        round_exact(seconds, 1).alias("elapsed_seconds"), round_exact(F.col("n_images") / F.greatest(seconds, F.lit(1e-6)), 2).alias("images_per_second"), "per_class",
    )
    write_document(document, metrics, mode="overwrite")


def evaluate_run(
    spark: SparkSession, root: str, run_id: str, index: DataFrame, shards: DataFrame, encode: Callable[[DataFrame], DataFrame],
    banks: Mapping[str, Mapping[str, Bank]], names: Mapping[str, DataFrame], vector: str = "vector",
) -> DataFrame:
    """All models on all targets; the long metrics table of the run, read back from its documents.

    ``banks[model_id][target]`` has the prompts, ``names[target]`` the classes; a target is also the label column of ``index``. A run that
    is started again goes on with what is missing.
    """
    targets = list(names)
    for model_id, own in banks.items():
        for target in own:
            evaluate_model(index, shards, encode, own[target], names[target], f"{root}/{run_id}/{target}", model_id, target, target, vector)
    models = spark.createDataFrame([(m, tag_of(m)) for m in banks], "model_id string, tag string")
    return collect_metrics(spark, root, models, targets).where(F.col("run_id") == run_id)


def run_summary(metrics: DataFrame, run_id: str, parameters: Mapping[str, object], files: Mapping[str, str], generated_at: datetime | None = None) -> DataFrame:
    """One row on a finished run: its parameters, the number of metric rows, the best row of each target, and where the tables are.

    ``best_per_target`` has a row for each target of the run.
    """
    best = best_per_target(leaderboard(metrics))
    entry = F.struct("target", "model_id", "top1_accuracy", "top5_accuracy", "images_per_second", "elapsed_seconds")
    at = (generated_at or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    parts: dict[str, DataFrame | Column] = {"run_id": F.lit(run_id)}
    parts |= {k: F.lit(v).cast("string") if v is None else F.lit(v) for k, v in parameters.items()}
    parts |= {"generated_at": F.lit(at), "n_rows": metrics.agg(F.count("*")), "best_per_target": best.agg(F.array_sort(F.collect_list(entry)))}
    parts["files"] = F.struct(*[F.lit(v).alias(k) for k, v in files.items()])
    return summary_document(metrics.sparkSession, parts)


# Fixed wording of the page: labels of the parameters, heads of the table and of the sections.
PAGE_TITLE = "# Track A Provider Comparison Summary"
PAGE_FIELDS = (
    ("Run ID", "run_id", ""), ("Split", "split_csv", ""), ("Streaming repo", "streaming_repo_id", ""), ("Streaming split", "streaming_split", ""),
    ("Targets", "targets", ""), ("Prompt templates per class", "templates_per_class", ""), ("Max images", "max_images", " (0 means full split)"),
)
PAGE_BEST = "## Best model per target (Top-1)"
PAGE_TABLE = ("| Target | Model | Top-1 | Top-5 | Img/s | Elapsed (s) |", "|---|---|---:|---:|---:|---:|")
PAGE_FILES = "## Output files"
PAGE_RAW = "Per-target raw artifacts remain under:"


def run_page(summary: DataFrame, folder: str) -> DataFrame:
    """``line_no, line`` of the page for a ``run_summary`` whose files are ``long_csv`` and ``leaderboard_csv`` and a ``summary_json`` beside them."""
    text = F.lit
    kinds = dict(summary.dtypes)

    def shown(name: str) -> Column:
        value = F.array_join(name, ", ") if kinds[name].startswith("array") else F.col(name).cast("string")
        return F.coalesce(F.when(value != "", value), text("none"))

    fields = [F.concat(text(f"- {label}: `"), shown(name), text(f"`{after}")) for label, name, after in PAGE_FIELDS if name in kinds]
    best = F.transform(
        "best_per_target",
        lambda b: table_row(b["target"], b["model_id"], fixed(b["top1_accuracy"], 4), fixed(b["top5_accuracy"], 4), fixed(b["images_per_second"], 2), fixed(b["elapsed_seconds"], 1)),
    )
    listed = [F.concat(text(f"- {label}: `"), F.col(f"files.{name}"), text("`")) for label, name in (("Long metrics table", "long_csv"), ("Leaderboard table", "leaderboard_csv"), ("JSON summary", "summary_json"))]
    raw = F.transform("targets", lambda t: F.concat(text(f"- `{folder}/"), t, text("`")))
    head = F.array(text(PAGE_TITLE), text(""), *fields, text(""), text(PAGE_BEST), text(""), *map(text, PAGE_TABLE))
    tail = F.array(text(""), text(PAGE_FILES), text(""), *listed, text(""), text(PAGE_RAW))
    return summary.select(F.posexplode(F.concat(head, best, tail, raw)).alias("line_no", "line"))
