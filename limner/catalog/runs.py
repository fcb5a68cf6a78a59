"""Queries over run metrics: merging, leaderboards, selection, names."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limner.catalog import bindings as B
from limner.catalog.registry import having, query
from limner.functions import text as T
from limner.operators import leaderboard as L
from limner.operators.metrics import metric_pivot
from limner.plans.run_job import run_page, run_summary
from limner.plans.staging import scratch_path
from limner.sinks.documents import best_model_lines
from limner.sinks.tables import write_csv
from limner.sources.runs import read_runs

COLS = "run_id, target, model_id, n_images, round(top1_accuracy, 9) AS top1_accuracy, round(top5_accuracy, 9) AS top5_accuracy, images_per_second, elapsed_seconds"
BEST = "top1_accuracy DESC NULLS LAST, top5_accuracy DESC NULLS LAST, run_id, model_id"


def _first(keys: str, order: str, source: str = "runs", cols: str = COLS) -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1"


@query(having(B.RUNS, then=f"SELECT {COLS} FROM runs"))
def metrics_long_table(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(B.runs(spark, sf))


@query(
    having(
        B.RUNS,
        then=f"SELECT {COLS}, row_number() OVER (ORDER BY target, top1_accuracy DESC NULLS LAST, top5_accuracy DESC NULLS LAST, "
        "images_per_second DESC NULLS LAST, run_id, model_id) AS position FROM runs",
    )
)
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(L.leaderboard(B.runs(spark, sf)))


@query(having(B.RUNS, then=_first("target, model_id", BEST)))
def best_run_per_model(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(L.best_per_model(B.runs(spark, sf)))


@query(having(B.RUNS, then=_first("target, model_id", "run_id DESC")))
def latest_run_per_model(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(L.latest_per_model(B.runs(spark, sf)))


@query(having(B.RUNS, then=_first("target", BEST)))
def best_run_per_target(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(L.best_per_target(B.runs(spark, sf)))


@query(
    having(
        B.RUNS,
        then="SELECT target, first(model_id ORDER BY " + BEST + ") AS model_id, "
        "round(first(top1_accuracy ORDER BY " + BEST + ") FILTER (top1_accuracy IS NOT NULL), 9) AS top1_accuracy, "
        "first(IF(n_images % 2 = 0, elapsed_seconds, NULL) ORDER BY " + BEST + ") FILTER (n_images % 2 = 0) AS elapsed_seconds FROM runs GROUP BY 1",
    )
)
def best_values_per_target(spark: SparkSession, sf: str) -> DataFrame:
    sparse = F.when(F.col("n_images") % 2 == 0, F.col("elapsed_seconds"))
    rows = B.runs(spark, sf).withColumn("elapsed_seconds", sparse)
    return B.rounded(L.best_columns_per_target(rows, ["model_id", "top1_accuracy", "elapsed_seconds"]))


@query(having(B.RUNS, "doubled AS (SELECT * FROM runs UNION ALL SELECT * REPLACE (top1_accuracy / 2 AS top1_accuracy) FROM runs)", then=_first("run_id, target, model_id", BEST, "doubled")))
def best_row_per_run(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.runs(spark, sf)
    worse = rows.withColumn("top1_accuracy", F.col("top1_accuracy") / 2)
    return B.rounded(L.dedupe_runs(L.union_runs([rows, worse])))


FAMILY = "CASE WHEN starts_with(model_id, 'trackB::') THEN 'trackB::' WHEN starts_with(model_id, 'linear_map::') THEN 'linear_map::' ELSE '' END"


@query(
    having(
        B.RUNS, f"fam AS (SELECT *, {FAMILY} AS family FROM runs)",
        then=_first("target, family", "top1_accuracy DESC NULLS LAST, run_id, model_id", "fam", COLS + ", family"),
    )
)
def best_run_per_family(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(L.best_per_family(B.runs(spark, sf)))


PRETTY = "CASE WHEN starts_with(model_id, 'trackB::') THEN 'Track B (Fine-tuned CLIP)' WHEN starts_with(model_id, 'linear_map::') THEN 'Track C (Linear Map)' ELSE 'Track A (' || split_part(model_id, '/', -1) || ')' END"
STAGE = "CASE WHEN contains(lower(run_id), 'smoke') OR n_images < 12 THEN 'Smoke' ELSE 'Full' END"


@query(
    having(
        B.RUNS, f"staged AS (SELECT *, {PRETTY} AS model_pretty, {STAGE} AS stage FROM runs)",
        then=f"SELECT {COLS}, model_pretty, stage FROM staged WHERE stage = 'Full' OR NOT EXISTS (SELECT 1 FROM staged WHERE stage = 'Full')",
    )
)
def figure_source_table(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(L.figure_source_table(L.full_or_all(L.with_stage(B.runs(spark, sf), 12))))


@query(having(B.RUNS, f"staged AS (SELECT *, {STAGE.replace('12', '1000000')} AS stage FROM runs)", then="SELECT stage, count(*) AS n FROM staged GROUP BY 1"))
def smoke_only_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.full_or_all(L.with_stage(B.runs(spark, sf), 1_000_000))
    return rows.groupBy("stage").agg(F.count("*").alias("n"))


@query(
    having(
        B.RUNS,
        then="SELECT DISTINCT model_id, "
        + PRETTY + " AS pretty, CASE WHEN starts_with(model_id, 'trackB::') THEN 'Track B fine-tuned' WHEN starts_with(model_id, 'linear_map::') THEN 'Track C linear map' ELSE model_id END AS short, "
        "replace(replace(replace(replace(model_id, '/', '__'), ':', '__'), '=>', '_to_'), ' ', '_') AS file_name, replace(model_id, '/', '__') AS tag FROM runs",
    )
)
def model_names(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("model_id")
    models = B.runs(spark, sf).select("model_id").distinct()
    return models.select(
        m, T.pretty_model(m).alias("pretty"), T.short_model(m).alias("short"), T.sanitize_id(m).alias("file_name"), T.model_tag(m).alias("tag")
    )


@query(
    "SELECT p_partkey, 'linear_map::' || p_brand || '=>' || p_type AS map_id, 'linear_map__' || replace(p_brand, '/', '__') || '__to__' || replace(p_type, '/', '__') AS map_tag FROM part"
)
def linear_map_names(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("p_brand"), F.col("p_type")
    return B.table(spark, sf, "part").select("p_partkey", T.linear_map_id(a, b).alias("map_id"), T.linear_map_tag(a, b).alias("map_tag"))


@query(
    "SELECT event_id, 'zeroshot_' || strftime(ts, '%Y%m%d_%H%M%S') AS run_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS parsed, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso FROM events"
)
def run_ids_and_times(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.table(spark, sf, "events").select("event_id", T.run_id_from_ts("zeroshot_", F.col("ts")).alias("run_id"), T.iso_utc(F.col("ts")).alias("iso"))
    return rows.withColumn("parsed", F.date_format(T.ts_from_run_id(F.col("run_id")), "yyyy-MM-dd HH:mm:ss"))


@query(having(B.RUNS, then=f"SELECT {COLS} FROM runs WHERE n_images = (SELECT max(n_images) FROM runs)"))
def runs_of_exact_size(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.runs(spark, sf)
    largest = rows.agg(F.max("n_images")).first()[0]
    return B.rounded(L.exact_n(rows, largest))


@query(
    having(
        B.RUNS,
        then="SELECT prefix FROM (VALUES ('run_2024'), ('run_2031'), ('final_')) AS p(prefix) WHERE NOT EXISTS (SELECT 1 FROM runs WHERE starts_with(run_id, prefix))",
    )
)
def missing_run_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return L.missing_prefixes(B.runs(spark, sf), ["run_2024", "run_2031", "final_"])


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' WHEN event_id % 7 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS top1_accuracy FROM events")
def coerced_metrics(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, "n/a").when(F.col("event_id") % 7 != 0, F.col("value").cast("string"))
    return L.coerce_numeric(B.table(spark, sf, "events").select("event_id", text.alias("top1_accuracy")))


@query("SELECT event_id FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def complete_metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    holes = lambda k: F.when(F.col("event_id") % k != 0, F.col("value"))
    rows = B.table(spark, sf, "events").select("event_id", holes(5).alias("top1_accuracy"), holes(7).alias("top5_accuracy"))
    return L.drop_incomplete(rows, ["top1_accuracy", "top5_accuracy"]).select("event_id")


@query(
    having(
        B.RUNS,
        then="SELECT run_id, target, model_id, CAST(NULL AS BIGINT) AS n_images, round(top1_accuracy, 9) AS top1_accuracy FROM runs WHERE target = 'click' "
        "UNION ALL SELECT run_id, target, model_id, n_images, NULL FROM runs WHERE target <> 'click'",
    )
)
def union_of_run_tables(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.runs(spark, sf)
    a = rows.filter("target = 'click'").select("run_id", "target", "model_id", "top1_accuracy")
    b = rows.filter("target <> 'click'").select("model_id", "target", "run_id", "n_images")
    return B.rounded(L.union_runs([a, b]))


@query(having(B.RUNS, then="SELECT run_id, target, model_id, CAST(n_images AS DOUBLE) AS n_images FROM runs"))
def runs_read_from_folders(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "runs")
    write_csv(B.runs(spark, sf).select("run_id", "target", "model_id", "n_images"), f"{path}/batch_a")
    frames = read_runs(spark, path, ["batch_*", "*_a"], "part-*.csv")
    return L.coerce_numeric(L.union_runs(frames))


@query(
    having(
        B.RUNS,
        then="SELECT " + PRETTY + " AS model_pretty, " + ", ".join(f"round(max(top1_accuracy) FILTER (target = '{t}'), 9) AS \"{t}\"" for t in B.TARGETS) + " FROM runs GROUP BY 1",
    )
)
def accuracy_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(metric_pivot(L.with_stage(B.runs(spark, sf)), "model_pretty", "target", B.TARGETS, "top1_accuracy"))


SELECTED = f"fam AS (SELECT *, {FAMILY} AS family FROM runs), selected AS (" + _first(
    "target, family", "top1_accuracy DESC NULLS LAST, run_id, model_id", "fam", "*"
) + ")"


@query(
    having(
        B.RUNS, SELECTED,
        "rows_of AS (SELECT event_id, 'run_' || strftime(ts, '%Y%m%d') AS run_id, event_type AS target, "
        "CASE user_id % 6 WHEN 0 THEN 'linear_map::img=>txt' WHEN 1 THEN 'trackB::tuned' ELSE 'lab/m' || CAST(user_id % 6 AS VARCHAR) END AS model_id FROM events)",
        then="SELECT r.event_id, r.run_id, r.target, r.model_id FROM rows_of r SEMI JOIN selected s ON r.run_id = s.run_id AND r.target = s.target AND r.model_id = s.model_id",
    )
)
def predictions_of_selected_runs(spark: SparkSession, sf: str) -> DataFrame:
    predictions = B.table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("run_"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
        F.col("event_type").alias("target"),
        B.model_of(F.col("user_id")).alias("model_id"),
    )
    selected = L.best_per_family(B.runs(spark, sf))
    return L.predictions_for(predictions, selected).select("event_id", "run_id", "target", "model_id")


@query(
    having(
        B.RUNS, SELECTED,
        then="SELECT target, model_id, round(top1_accuracy, 9) AS top1_accuracy, round(top5_accuracy, 9) AS top5_accuracy, n_images FROM selected WHERE target <> 'view'",
    )
)
def selected_run_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.runs(spark, sf)
    available = rows.filter("target <> 'view'").select("run_id", "target", "model_id")
    return B.rounded(L.confusion_index(L.best_per_family(rows), available))


FINAL = "final AS (" + _first("target, model_id", BEST, "runs", "*") + "), top AS (" + _first("target", BEST, "final", "* EXCLUDE (rn)").replace("SELECT *, row_number()", "SELECT * EXCLUDE (rn), row_number()") + ")"


@query(
    having(
        B.RUNS, FINAL,
        then="SELECT (SELECT count(DISTINCT run_id) FROM runs) AS n_runs_scanned, (SELECT count(*) FROM runs) AS n_rows_all, (SELECT count(*) FROM final) AS n_rows_final, 'best_top1' AS selection_mode, "
        "(SELECT string_agg(target || '=' || model_id, ',' ORDER BY target) FROM top) AS best",
    )
)
def merge_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.runs(spark, sf)
    n_runs = rows.agg(F.count_distinct("run_id")).first()[0]
    summary = L.merge_runs([rows], n_scanned=n_runs)["merge_summary"]
    best = F.transform("best_per_target", lambda b: F.concat_ws("=", b["target"], b["model_id"]))
    return summary.select("n_runs_scanned", "n_rows_all", "n_rows_final", "selection_mode", F.array_join(best, ",").alias("best"))


LATEST = "late AS (" + _first("target, model_id", "run_id DESC", "runs", "* EXCLUDE (rn)") + ")"


@query(
    having(
        B.RUNS, LATEST,
        "top AS (SELECT target, model_id FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY " + BEST + ") AS p FROM late) WHERE p = 1)",
        then="SELECT (SELECT count(*) FROM late) AS n_rows_final, 'latest' AS selection_mode, 'run_*' AS globs, CAST(0 AS INTEGER) AS exact_n_images, 'run_' AS prefixes, "
        "(SELECT string_agg(target || '=' || model_id, ',' ORDER BY target) FROM top) AS best, '2024-05-01T10:20:30.000000Z' AS generated_at",
    )
)
def merge_of_latest_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The latest run of each model instead of its best one, with all fields of the summary."""
    merged = L.merge_runs([B.runs(spark, sf)], prefer_latest=True, prefixes=["run_"], run_globs=["run_*"], generated_at=datetime(2024, 5, 1, 10, 20, 30, tzinfo=UTC))
    best = F.transform("best_per_target", lambda b: F.concat_ws("=", b["target"], b["model_id"]))
    return merged["merge_summary"].select(
        "n_rows_final", "selection_mode", F.array_join("run_globs", ",").alias("globs"), "exact_n_images", F.array_join("require_track_prefixes", ",").alias("prefixes"),
        F.array_join(best, ",").alias("best"), "generated_at",
    )


@query(
    having(
        B.RUNS, FINAL,
        "lines AS (SELECT 14 + row_number() OVER (ORDER BY target) - 1 AS line_no, '| ' || target || ' | ' || model_id || ' | ' || printf('%.4f', top1_accuracy) || ' | ' || printf('%.4f', top5_accuracy) || ' | ' "
        "|| printf('%.2f', images_per_second) || ' | ' || printf('%.1f', elapsed_seconds) || ' |' AS line FROM top)",
        then="SELECT CAST(line_no AS INTEGER) AS line_no, line FROM lines UNION ALL SELECT 8, '- Max images: `0` (0 means full split)' UNION ALL SELECT 5, '- Streaming split: `none`' "
        "UNION ALL SELECT CAST(14 + (SELECT count(*) FROM top) AS INTEGER), '' ",
    )
)
def run_summary_page(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the page over all runs as one: some of the parameters, the best of each target, the end of the table."""
    parameters = {"split_csv": "data/test.csv", "streaming_repo_id": "", "streaming_split": None, "targets": list(B.TARGETS), "templates_per_class": 1, "max_images": 0}
    files = {"long_csv": "long.csv", "leaderboard_csv": "leaderboard.csv", "summary_json": "summary.json"}
    page = run_page(run_summary(B.runs(spark, sf), "run", parameters, files), "runs/run")
    best = F.col("line").startswith("| ") & ~F.col("line").startswith("| Target")
    end = F.lit(14) + F.lit(len(B.TARGETS))
    return page.where(best | F.col("line_no").isin(5, 8) | (F.col("line_no") == end))


@query(
    having(
        B.RUNS, FINAL,
        then="SELECT target, '| ' || target || ' | ' || model_id || ' | ' || printf('%.4f', top1_accuracy) || ' | ' || printf('%.4f', top5_accuracy) || ' | ' "
        "|| printf('%.2f', images_per_second) || ' | ' || printf('%.1f', elapsed_seconds) || ' |' AS line FROM top",
    )
)
def best_model_report_lines(spark: SparkSession, sf: str) -> DataFrame:
    return best_model_lines(L.best_per_target(B.runs(spark, sf)))
