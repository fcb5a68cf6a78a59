"""Stratified split: published sizes, layout independence, fallbacks."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from limner.operators.splits import check_split_partition, class_quotas, split_distribution, split_pivot, stratified_split
from tests.conftest import rows

# Published rows per class, and the published test and validation rows of each.
CLASS_TOTALS = [1342, 62, 81, 2378, 2398, 871, 230, 1217, 756, 3351, 343, 651, 9402, 584, 536, 1383, 166, 1691, 292, 319, 4165, 7220, 949, 3938, 2562, 149, 465]
TEST_ROWS = [134, 6, 8, 238, 240, 87, 23, 122, 76, 335, 34, 65, 940, 58, 54, 138, 17, 169, 29, 32, 417, 722, 95, 394, 256, 15, 47]
VAL_ROWS = [134, 6, 8, 238, 240, 87, 23, 122, 76, 335, 34, 65, 940, 59, 54, 138, 17, 169, 29, 32, 416, 722, 95, 394, 256, 15, 46]


def _counts(df):
    return {(r["split"], r["c"]): r["count"] for r in split_distribution(df, "c").collect()}


def test_published_quotas(spark):
    total = sum(CLASS_TOTALS)
    counts = spark.createDataFrame(list(enumerate(CLASS_TOTALS)), "c int, n long")
    n_test = math.ceil(0.1 * total)
    n_val = math.ceil(0.1 / (1 - 0.1) * (total - n_test))
    assert (total, n_test, n_val, total - n_test - n_val) == (47501, 4751, 4750, 38000)
    first = class_quotas(counts, "c", "n", n_test, total, "q").withColumn("left", F.col("n") - F.col("q"))
    second = class_quotas(first, "c", "left", n_val, total - n_test, "v").orderBy("c").collect()
    assert [r["q"] for r in second] == TEST_ROWS
    # Equal remainders were drawn at random for the published split; at most one row differs.
    off = [abs(r["v"] - v) for r, v in zip(second, VAL_ROWS)]
    assert sum(off) <= 2 and max(off) <= 1


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.range(600).select("id", F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10).cast("int").alias("c"))


def test_split_is_disjoint_complete_and_layout_independent(spark, skewed):
    one = stratified_split(skewed.repartition(1), "id", "c")
    many = stratified_split(skewed.repartition(11), "id", "c")
    assert rows(one.select("id", "split")) == rows(many.select("id", "split"))
    check = check_split_partition(one, skewed, "id").first()
    assert tuple(check) == (0, 0, 0, 600)
    sizes = {r["split"]: r["count"] for r in one.groupBy("split").count().collect()}
    n_val = math.ceil(0.1 / (1 - 0.1) * 540)  # 61: the quotient is rounded up in floating point
    assert sizes == {"test": 60, "val": n_val, "train": 540 - n_val}


def test_both_ways_to_split_agree(skewed):
    from limner.operators import splits as S

    keyed = skewed.withColumn("_hash", S.hash_order(["id"], 42))
    in_turn = S._split_in_turn(keyed, "id", "c", 0.1, 0.1 / 0.9)
    assert rows(in_turn.select("id", "split")) == rows(stratified_split(skewed, "id", "c").select("id", "split"))


def test_seed_changes_the_split(skewed):
    a = rows(stratified_split(skewed, "id", "c", seed=1).filter("split = 'test'").select("id"))
    b = rows(stratified_split(skewed, "id", "c", seed=2).filter("split = 'test'").select("id"))
    assert a != b and len(a) == len(b)


def test_single_row_class_turns_stratification_off(spark, skewed):
    df = skewed.union(spark.createDataFrame([(1000, 99)], "id long, c int"))
    out = stratified_split(df, "id", "c")
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    n_val = math.ceil(0.1 / (1 - 0.1) * 540)
    assert sizes == {"test": 61, "val": n_val, "train": 540 - n_val}
    assert tuple(check_split_partition(out, df, "id").first()) == (0, 0, 0, 601)


def test_class_left_with_one_row_turns_only_the_second_draw_off(spark):
    df = spark.createDataFrame([(i, 0 if i < 18 else 1) for i in range(20)], "id long, c int")
    out = stratified_split(df, "id", "c", val_frac=0.2, test_frac=0.4)
    counts = _counts(out)
    assert counts["test", 1] == 1  # the first draw is stratified
    assert sum(n for (s, _c), n in counts.items() if s == "test") == 8
    assert sum(n for (s, _c), n in counts.items() if s == "val") == math.ceil(0.2 / 0.6 * 12)


def test_fractions_have_to_leave_train_rows(skewed):
    with pytest.raises(ValueError):
        stratified_split(skewed, "id", "c", 0.5, 0.5)


def test_empty_input(skewed):
    assert stratified_split(skewed.limit(0), "id", "c").count() == 0


def test_pivot_fills_missing_splits_with_zero(spark):
    dist = spark.createDataFrame([("train", 1, 5), ("test", 1, 2), ("train", 2, 3)], "split string, c int, count long")
    assert rows(split_pivot(dist, "c")) == [(1, 5, 0, 2), (2, 3, 0, 0)]


def test_check_reports_overlap_and_gaps(spark):
    source = spark.range(4)
    df = spark.createDataFrame([(0, "train"), (0, "test"), (1, "val"), (9, "train")], "id long, split string")
    assert tuple(check_split_partition(df, source, "id").first()) == (1, 2, 1, 1)
