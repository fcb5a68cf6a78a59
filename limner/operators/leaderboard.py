"""Merging run metrics and choosing the best rows.

Every "first row of a group" below is ``row_number() = 1``; Spark cuts each
map task's share to one row per group before the shuffle, so a group that
holds a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limner.functions.text import model_family, pretty_model, run_stage
from limner.plans.joins import lookup_join
from limner.plans.ordering import running_totals

METRIC_COLUMNS = ("top1_accuracy", "top5_accuracy", "images_per_second", "elapsed_seconds", "n_images")


def union_runs(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; columns a run lacks become NULL."""
    if not frames:
        raise ValueError("there are no runs to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def coerce_numeric(df: DataFrame, cols: Sequence[str] = METRIC_COLUMNS) -> DataFrame:
    """Turn the metric columns that exist into doubles; what is not a number becomes NULL."""
    def number(c: str) -> Column:
        x = F.col(c).try_cast("double")
        return F.when(~F.isnan(x), x)
    return df.withColumns({c: number(c) for c in cols if c in df.columns})


def exact_n(df: DataFrame, n: int) -> DataFrame:
    """Runs over exactly ``n`` rows; raises when none is left. 0 keeps all runs."""
    if n <= 0:
        return df
    kept = df.filter(F.col("n_images") == n)
    if kept.isEmpty():
        raise ValueError(f"no run covers exactly {n} rows")
    return kept


def missing_prefixes(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """The prefixes no run id starts with, found in one pass over the runs."""
    if not prefixes:
        return df.sparkSession.createDataFrame([], "prefix string")
    hits = df.agg(*[F.count_if(F.startswith("run_id", F.lit(p))).alias(f"_{i}") for i, p in enumerate(prefixes)])
    rows = F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(f"_{i}").alias("n")) for i, p in enumerate(prefixes)])
    return hits.select(F.inline(rows)).filter("n = 0").select("prefix")


def require_prefixes(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Return ``df``, or raise with the prefixes that are missing."""
    missing = [r["prefix"] for r in missing_prefixes(df, prefixes).collect()]
    if missing:
        raise ValueError(f"no run with the required prefixes: {', '.join(missing)}")
    return df


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL in any of ``cols``."""
    return df.na.drop(subset=list(cols))


def _best_first() -> list[Column]:
    return [F.desc_nulls_last("top1_accuracy"), F.desc_nulls_last("top5_accuracy"), F.asc("run_id"), F.asc("model_id")]


def first_per_group(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def leaderboard(df: DataFrame, speed: bool = True) -> DataFrame:
    """Rows with their 1-based ``position``: target up, top-1, top-5 (and speed) down, NULL last.

    Positions come from a range-partitioned sort, not from one task.
    """
    order = [F.asc("target"), F.desc_nulls_last("top1_accuracy"), F.desc_nulls_last("top5_accuracy")]
    if speed:
        order.append(F.desc_nulls_last("images_per_second"))
    return running_totals(df, [*order, F.asc("run_id"), F.asc("model_id")], {"position": F.lit(1)}).drop("position_all")


def best_per_model(df: DataFrame) -> DataFrame:
    """Best row per target and model."""
    return first_per_group(df, ["target", "model_id"], _best_first())


def latest_per_model(df: DataFrame) -> DataFrame:
    """Row of the latest run id per target and model."""
    return first_per_group(df, ["target", "model_id"], [F.desc("run_id")])


def best_per_target(df: DataFrame) -> DataFrame:
    """Best row per target, taken as a whole row."""
    return first_per_group(df, ["target"], _best_first())


def best_columns_per_target(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """First non-NULL value of each column per target, best row first; columns may come from different rows."""
    rank = [F.col("top1_accuracy").isNull(), -F.col("top1_accuracy"), F.col("top5_accuracy").isNull(),
            -F.col("top5_accuracy"), F.col("run_id"), F.col("model_id")]
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(rank)])
    picks = [F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(c) for c in cols]
    return df.groupBy("target").agg(*picks)


def dedupe_runs(df: DataFrame) -> DataFrame:
    """Best row per run, target and model."""
    return first_per_group(df, ["run_id", "target", "model_id"], _best_first())


def best_per_family(df: DataFrame) -> DataFrame:
    """Best row per target and model family."""
    keyed = df.withColumn("family", model_family(F.col("model_id")))
    order = [F.desc_nulls_last("top1_accuracy"), F.asc("run_id"), F.asc("model_id")]
    return first_per_group(keyed, ["target", "family"], order)


def with_stage(df: DataFrame, min_full: int = 1000) -> DataFrame:
    """Add the display name of the model and the stage of the run."""
    return df.withColumns(
        {
            "model_pretty": pretty_model(F.col("model_id")),
            "stage": run_stage(F.col("run_id"), F.col("n_images"), min_full),
        }
    )


def full_or_all(df: DataFrame) -> DataFrame:
    """Only the full runs if there is any, else all runs."""
    n_full = df.agg(F.count_if(F.col("stage") == "Full")).scalar()
    return df.filter((F.col("stage") == "Full") | (n_full == 0))


FIGURE_COLUMNS = (
    "run_id", "target", "model_id", "model_pretty", "stage", "n_images",
    "top1_accuracy", "top5_accuracy", "images_per_second", "elapsed_seconds",
)


def figure_source_table(df: DataFrame) -> DataFrame:
    """Columns behind the result figures, by target and falling top-1 accuracy."""
    return df.select(*FIGURE_COLUMNS).orderBy("target", F.desc_nulls_last("top1_accuracy"), "run_id", "model_id")


def predictions_for(predictions: DataFrame, selected: DataFrame) -> DataFrame:
    """Predictions of the selected runs; runs without predictions drop out."""
    keys = ["run_id", "target", "model_id"]
    return lookup_join(predictions, selected.select(*keys).distinct(), keys, "left_semi")


def confusion_index(selected: DataFrame, predictions: DataFrame) -> DataFrame:
    """Selected runs that have predictions, with their headline metrics."""
    keys = ["run_id", "target", "model_id"]
    cols = ["target", "model_id", "top1_accuracy", "top5_accuracy", "n_images"]
    return selected.join(predictions.select(*keys), keys, "left_semi").select(*cols).orderBy("target", "model_id")


def merge_summary(
    all_runs: DataFrame, final: DataFrame, best: DataFrame, mode: str, n_scanned: int, run_globs: Sequence[str] = (), n_images: int = 0,
    prefixes: Sequence[str] = (), generated_at: datetime | None = None,
) -> DataFrame:
    """One row: what was asked for, runs scanned, rows before and after selection, mode, and the best rows as an array.

    ``best`` holds one row per target.
    """
    at = (generated_at or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    names = lambda xs: F.lit(list(xs)).cast("array<string>")
    entry = F.struct("target", "model_id", "top1_accuracy", "top5_accuracy")
    return best.agg(F.array_sort(F.collect_list(entry)).alias("best_per_target")).select(
        F.lit(n_scanned).cast("bigint").alias("n_runs_scanned"),
        all_runs.agg(F.count("*")).scalar().alias("n_rows_all"),
        final.agg(F.count("*")).scalar().alias("n_rows_final"),
        F.lit(mode).alias("selection_mode"),
        "best_per_target",
        F.lit(at).alias("generated_at"),
        names(run_globs).alias("run_globs"),
        F.lit(n_images).alias("exact_n_images"),
        names(prefixes).alias("require_track_prefixes"),
    )


def merge_runs(
    frames: Sequence[DataFrame], prefer_latest: bool = False, n_images: int = 0, prefixes: Sequence[str] = (), n_scanned: int | None = None,
    run_globs: Sequence[str] = (), generated_at: datetime | None = None,
) -> dict[str, DataFrame]:
    """All tables of a merge: long, leaderboard, final, best per target, summary.

    ``n_scanned`` is the number of run folders, by default one per frame; frames of ``read_runs`` hold several.
    """
    merged = require_prefixes(exact_n(coerce_numeric(union_runs(frames)), n_images), prefixes)
    final = latest_per_model(merged) if prefer_latest else best_per_model(merged)
    best = best_per_target(final)
    mode = "latest" if prefer_latest else "best_top1"
    return {
        "all_runs_metrics_long": merged,
        "all_runs_leaderboard": leaderboard(merged),
        "final_table": final,
        "best_per_target": best,
        "merge_summary": merge_summary(merged, final, best, mode, len(frames) if n_scanned is None else n_scanned, run_globs, n_images, prefixes, generated_at),
    }
