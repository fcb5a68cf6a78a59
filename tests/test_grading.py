"""Grading rules on hand-made detections."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from limner.operators.grading import detect_and_grade, grade_items, grade_signals, offline_grade, parse_grade_reply, signals_from_rows
from limner.operators.scoring import detect


def grade(spark, *labels, seed=42, item=1):
    schema = "id long, detections array<struct<label: string, score: double>>"
    df = spark.createDataFrame([(item, [(x, 0.5) for x in labels])], schema)
    return grade_items(df, ["id"], seed=seed).first()


@pytest.mark.parametrize(
    ("labels", "expected"),
    [
        (["painting", "canvas"], 0),
        ([], 0),
        (["cat", "painting"], 20),
        (["cat", "cat"], 40),
        (["cat"] * 3, 60),
        (["cat"] * 4, 60),
        (["cat", "geometric shapes"], 5),
        (["cat"] + ["geometric shapes"] * 10, 5),
        (["cash"], 0),
        (["abstract art"], 0),
    ],
)
def test_exact_grades(spark, labels, expected):
    assert grade(spark, *labels)["grade"] == expected


@pytest.mark.parametrize("money", ["cash", "dollar bill"])
def test_money_decides(spark, money):
    for item in range(5):
        got = grade(spark, "cat", money, "geometric shapes", item=item)
        assert 90 <= got["grade"] <= 100
        assert "money" in got["explanation"] and f"Grade: {got['grade']}." in got["explanation"]
        assert "Geometric" not in got["explanation"]


def test_abstract_art_shifts_within_range(spark):
    schema = "id long, detections array<struct<label: string, score: double>>"
    df = spark.createDataFrame([(i, [("cat", 0.9), ("abstract art", 0.8)]) for i in range(300)], schema)
    got = grade_items(df, ["id"]).collect()
    shifts = {r["grade"] - 20 for r in got}
    assert shifts == set(range(-15, 16))
    for r in got:
        shift = r["grade"] - 20
        assert ("inspired" if shift > 0 else "confused") in r["explanation"]
        assert f"{'Bonus' if shift >= 0 else 'Penalty'}: {abs(shift)} points." in r["explanation"]


def test_explanations(spark):
    assert "cat" in grade(spark, "painting")["explanation"].lower()
    assert grade(spark, "cat")["explanation"] == "I detect 1 cat(s). A start, I suppose. Final grade: 20/100."
    assert grade(spark, "cat", "cat", "cat")["explanation"] == "I detect 3 cat(s). Impressive collection. Final grade: 60/100."
    assert grade(spark, "cat", "geometric shapes")["explanation"] == (
        "I detect 1 cat(s). A start, I suppose. Geometric shapes? How pedestrian. "
        "I'm deducting points for sheer boringness. Final grade: 5/100."
    )


def test_result_types_and_fallback_flag(spark):
    row = grade(spark, "cat")
    assert isinstance(row["grade"], int) and isinstance(row["explanation"], str)
    assert not row["needs_fallback"]
    assert grade(spark, "sculpture")["needs_fallback"]
    assert grade(spark)["needs_fallback"]


def test_same_seed_same_grade(spark):
    assert grade(spark, "cat", "cash", seed=1) == grade(spark, "cat", "cash", seed=1)


def test_rows_and_arrays_give_the_same_grade(spark):
    data = [(1, "cat"), (1, "cat"), (1, "geometric shapes"), (2, "cash"), (3, "cat"), (3, "abstract art"), (4, None)]
    long = spark.createDataFrame(data, "id long, label string")
    by_rows = grade_signals(signals_from_rows(long, ["id"]), ["id"]).select("id", "grade", "explanation")
    arrays = long.groupBy("id").agg(
        F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", F.lit(0.5).alias("score")))).alias("detections")
    )
    by_arrays = grade_items(arrays, ["id"]).select("id", "grade", "explanation")
    assert sorted(by_rows.collect()) == sorted(by_arrays.collect())


def test_null_detections_are_no_detections(spark):
    df = spark.createDataFrame([(1, None)], "id long, detections array<struct<label: string, score: double>>")
    assert grade_items(df, ["id"]).first()["grade"] == 0


def test_offline_grade_bounds(spark):
    df = spark.range(200).withColumn("n", (F.col("id") % 13).cast("int"))
    for r in offline_grade(df, ["id"], F.col("n")).collect():
        assert min(100, max(0, r["n"] * 10 - 5)) <= r["grade"] <= min(100, r["n"] * 10 + 5)
        assert f"give it a {r['grade']} and" in r["explanation"]


@pytest.mark.parametrize(
    ("raw", "grade", "explanation"),
    [
        (json.dumps({"grade": 85, "explanation": "fine"}), 85, "fine"),
        ("  " + json.dumps({"grade": 85.7, "explanation": "fine"}) + "\n", 85, "fine"),
        (json.dumps({"grade": "42", "explanation": "text"}), 42, "text"),
        (json.dumps({"grade": "much", "explanation": "text"}), 50, None),
        (json.dumps({"grade": 1}), 50, None),
        ("no json", 50, None),
        ("", 50, None),
    ],
)
def test_replies(spark, raw, grade, explanation):
    got = parse_grade_reply(spark.createDataFrame([(raw,)], "raw string"), "raw").first()
    assert got["grade"] == grade
    assert got["explanation"] == (explanation or f"The teacher is confused. Raw: {raw.strip()}")


def test_detection_is_sorted_and_uses_the_unrounded_score(spark):
    df = spark.createDataFrame([(1, [0.19999, 1.0, 0.2, 0.20001])], "id long, class_scores array<double>")
    got = detect(df, ["cat", "painting", "cash", "drawing"], 0.2).first()["detections"]
    assert [(d["label"], d["score"]) for d in got] == [("painting", 1.0), ("cash", 0.2), ("drawing", 0.2)]


def test_one_hot_image_detects_everything_at_threshold_zero(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 0.0])], "id long, class_scores array<double>")
    got = detect(df, ["cat", "painting", "cash"], 0.0).first()["detections"]
    assert [d["label"] for d in got] == ["painting", "cat", "cash"]
    assert [d["score"] for d in got] == sorted((d["score"] for d in got), reverse=True)


def test_detect_and_grade(spark):
    df = spark.createDataFrame([(1, [0.3, 0.1, 0.25])], "id long, class_scores array<double>")
    got = detect_and_grade(df, ["id"], ["cat", "cash", "painting"], 0.2).first()
    assert (got["detected_labels"], got["grade"]) == (["cat", "painting"], 20)
