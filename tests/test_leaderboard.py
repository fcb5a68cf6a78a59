"""Run selection with ties, NULL and NaN metrics; plan shapes that matter at scale."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from limner.functions import text as T
from limner.operators import leaderboard as L
from tests.conftest import rows

SCHEMA = "run_id string, target string, model_id string, top1_accuracy double, top5_accuracy double, images_per_second double, elapsed_seconds double, n_images long"


@pytest.fixture(scope="module")
def runs(spark):
    data = [
        ("r1", "style", "a/m1", 0.5, 0.9, 10.0, 1.0, 100),
        ("r2", "style", "a/m1", 0.5, 0.9, 12.0, None, 100),
        ("r3", "style", "a/m1", 0.4, 0.95, 1.0, 2.0, 50),
        ("r1", "style", "trackB::x", None, 0.99, 1.0, 2.0, 100),
        ("r1", "style", "linear_map::a=>b", math.nan, 0.99, 1.0, 2.0, 100),
        ("r9_smoke", "genre", "a/m2", 0.9, 0.9, 1.0, 2.0, 5000),
        ("r1", "genre", "a/m1", 0.1, None, 1.0, 2.0, 999),
    ]
    return L.coerce_numeric(spark.createDataFrame(data, SCHEMA).repartition(3))


def test_nan_becomes_null(runs):
    assert runs.filter("top1_accuracy IS NULL").count() == 2
    assert runs.filter(F.isnan("top1_accuracy")).count() == 0


def test_selection(runs):
    ids = lambda df: rows(df.select("run_id", "target", "model_id"))
    assert ids(L.best_per_model(runs.filter("model_id = 'a/m1'"))) == [("r1", "genre", "a/m1"), ("r1", "style", "a/m1")]
    assert ids(L.latest_per_model(runs.filter("model_id = 'a/m1' AND target = 'style'"))) == [("r3", "style", "a/m1")]
    assert ids(L.best_per_target(runs)) == [("r1", "style", "a/m1"), ("r9_smoke", "genre", "a/m2")]
    assert ids(L.best_per_family(runs)) == [
        ("r1", "style", "a/m1"), ("r1", "style", "linear_map::a=>b"), ("r1", "style", "trackB::x"), ("r9_smoke", "genre", "a/m2")
    ]


def test_leaderboard_puts_null_last(runs):
    order = [(r["run_id"], r["model_id"]) for r in L.leaderboard(runs).orderBy("position").collect()]
    assert order == [
        ("r9_smoke", "a/m2"), ("r1", "a/m1"), ("r2", "a/m1"), ("r1", "a/m1"), ("r3", "a/m1"),
        ("r1", "linear_map::a=>b"), ("r1", "trackB::x"),
    ]


def test_first_non_null_value_may_come_from_another_row(runs):
    best = L.best_columns_per_target(runs.filter("target = 'style' AND run_id <> 'r1'"), ["model_id", "elapsed_seconds"])
    assert rows(best) == [("style", "a/m1", 2.0)]


def test_stage_and_fallback(runs):
    staged = L.with_stage(runs, 1000)
    assert {r["stage"] for r in staged.collect()} == {"Smoke"}
    assert L.full_or_all(staged).count() == 7
    assert rows(L.full_or_all(L.with_stage(runs, 999)).select("run_id", "n_images")) == [("r1", 999.0)]


def test_guards(runs):
    assert L.exact_n(runs, 0).count() == 7
    assert L.exact_n(runs, 50).count() == 1
    with pytest.raises(ValueError):
        L.exact_n(runs, 51)
    assert rows(L.missing_prefixes(runs, ["r1", "x", "r9_"])) == [("x",)]
    assert L.missing_prefixes(runs, []).count() == 0
    with pytest.raises(ValueError, match="x"):
        L.require_prefixes(runs, ["r1", "x"])
    with pytest.raises(ValueError):
        L.union_runs([])


def test_merge(runs):
    out = L.merge_runs([runs, runs.limit(0)], prefer_latest=True)
    row = out["merge_summary"].first()
    assert (row["n_runs_scanned"], row["n_rows_all"], row["n_rows_final"], row["selection_mode"]) == (2, 7, 5, "latest")
    assert [b["target"] for b in row["best_per_target"]] == ["genre", "style"]


def test_names(spark):
    df = spark.createDataFrame([("lab/clip b:32=>x",), ("trackB::t",), ("linear_map::a=>b",)], "m string")
    m = F.col("m")
    got = rows(df.select(T.pretty_model(m), T.short_model(m), T.sanitize_id(m)))
    assert got == [
        ("Track A (clip b:32=>x)", "lab/clip b:32=>x", "lab__clip_b__32_to_x"),
        ("Track B (Fine-tuned CLIP)", "Track B fine-tuned", "trackB____t"),
        ("Track C (Linear Map)", "Track C linear map", "linear_map____a_to_b"),
    ]


def test_run_id_times(spark):
    df = spark.createDataFrame([("x_20240229_235959",), ("x_20240230_000000",), ("x",)], "r string")
    got = [str(r[0]) for r in df.select(T.ts_from_run_id(F.col("r"))).collect()]
    assert got == ["2024-02-29 23:59:59", "None", "None"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_are_cut_before_the_shuffle(runs):
    plan = _plan(L.best_per_model(runs))
    assert plan.count("WindowGroupLimit") == 2


def test_no_global_window_in_the_leaderboard(runs):
    assert "Exchange SinglePartition" not in _plan(L.leaderboard(runs)).split("Window")[0]


def test_run_summary_and_page(spark):
    from datetime import datetime

    from limner.plans.run_job import run_page, run_summary

    data = [("r", "style", "a/b", 10, 0.5, 0.9, 3.0, 2.25), ("r", "style", "c/d", 10, 0.7, 0.8, 3.0, 1.0), ("r", "genre", "a/b", 4, 0.25, 1.0, 61.24, 9.0)]
    metrics = spark.createDataFrame(data, "run_id string, target string, model_id string, n_images long, top1_accuracy double, top5_accuracy double, elapsed_seconds double, images_per_second double")
    files = {"long_csv": "x/long.csv", "leaderboard_csv": "x/lead.csv", "summary_json": "x/s.json"}
    parameters = {"split_csv": "test.csv", "streaming_repo_id": "", "targets": ["style", "genre"], "templates_per_class": 2, "max_images": 0}
    summary = run_summary(metrics, "r", parameters, files, datetime(2024, 1, 2, 3, 4, 5))
    row = summary.first()
    assert (row.run_id, row.n_rows, row.generated_at, row.files.long_csv) == ("r", 3, "2024-01-02T03:04:05.000000Z", "x/long.csv")
    assert [(b.target, b.model_id) for b in row.best_per_target] == [("genre", "a/b"), ("style", "c/d")]
    lines = [r.line for r in run_page(summary, "runs/r").orderBy("line_no").collect()]
    assert lines[2:8] == ["- Run ID: `r`", "- Split: `test.csv`", "- Streaming repo: `none`", "- Targets: `style, genre`", "- Prompt templates per class: `2`", "- Max images: `0` (0 means full split)"]
    assert "| genre | a/b | 0.2500 | 1.0000 | 9.00 | 61.2 |" in lines and lines[-2:] == ["- `runs/r/style`", "- `runs/r/genre`"]


def test_merge_summary_tells_what_was_asked_for(spark):
    frame = spark.createDataFrame([("a_1", "t", "m", 5, 0.5, 0.6, 1.0, 1.0), ("a_2", "t", "m", 5, 0.4, 0.6, 1.0, 1.0)], "run_id string, target string, model_id string, n_images long, top1_accuracy double, top5_accuracy double, elapsed_seconds double, images_per_second double")
    for latest, want in ((False, 0.5), (True, 0.4)):
        row = L.merge_runs([frame], prefer_latest=latest, n_images=5, prefixes=["a_"], run_globs=["a_*"])["merge_summary"].first()
        assert (row.best_per_target[0].top1_accuracy, row.exact_n_images, row.require_track_prefixes, row.run_globs) == (want, 5, ["a_"], ["a_*"])
        assert row.generated_at.endswith("Z") and row.selection_mode == ("latest" if latest else "best_top1")
