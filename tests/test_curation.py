"""Deduplication and dataset profile against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from limner.operators import dedupe as D
from limner.operators import profile as P
from limner.operators import sketches as K
from tests.conftest import rows


@pytest.fixture(scope="module")
def payloads(spark):
    rng = random.Random(8)
    # A third of all rows shares one hash.
    data = [(f"s{i % 4}", i // 4, "hot" if rng.random() < 0.34 else f"h{rng.randint(0, 120)}", i % 5) for i in range(400)]
    return data, spark.createDataFrame(data, "shard string, row long, h string, style int")


def _reference(data):
    seen, unique, dup = {}, [], []
    for shard, row, h, style in sorted(data):
        if h in seen:
            dup.append((h, shard, row, seen[h], style))
        else:
            seen[h] = len(unique)
            unique.append((len(unique), h, shard, row, style))
    return unique, dup


@pytest.mark.parametrize("parts", [1, 9])
def test_dedupe_keeps_the_first(payloads, parts):
    data, df = payloads
    unique, dup = D.dedupe_exact(df.repartition(parts), "h", ["shard", "row"])
    want_unique, want_dup = _reference(data)
    assert rows(unique.select("unique_idx", "h", "shard", "row", "style")) == sorted(want_unique, key=repr)
    assert rows(dup.select("h", "shard", "row", "primary_unique_idx", "style")) == sorted(want_dup, key=repr)


def test_hot_duplicates_reach_all_tasks(spark):
    """One hash with half of all rows and 5,000 that repeat: no task links more than its share."""
    n = 40_000
    df = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("h"), (F.col("id") % 5000).cast("string"))).alias("h"),
        F.lit("s").alias("shard"), F.col("id").alias("row"),
    ).repartition(8)
    unique, dup = D.dedupe_exact(df, "h", ["shard", "row"])
    shares = [r.n for r in dup.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    hashes = 1 + len({i % 5000 for i in range(1, n, 2)})
    assert sum(shares) == n - hashes and unique.count() == hashes
    assert max(shares) < n / 4
    assert dup.where("h = 'hot'").select(F.min("primary_unique_idx"), F.max("primary_unique_idx"), F.count("*")).first() == (0, 0, n // 2 - 1)


def test_dedupe_of_nothing(payloads):
    unique, dup = D.dedupe_exact(payloads[1].limit(0), "h", ["shard", "row"])
    assert unique.count() == dup.count() == 0


def test_summary_counts_quarantined_rows(payloads):
    data, df = payloads
    counts = D.hash_counts(df.withColumn("error", F.when(F.col("row") % 7 == 0, "bad")), "h", "error")
    got = D.dedupe_summary(counts).first()
    valid = [d for d in data if d[1] % 7]
    unique, dup = _reference(valid)
    assert (got["total_rows"], got["unique_rows"], got["duplicate_rows"], got["quarantined_rows"]) == (
        400, len(unique), len(dup), 400 - len(valid)
    )
    assert got["duplicate_rate"] == pytest.approx(len(dup) / 400)


def test_summary_of_nothing(payloads):
    counts = D.hash_counts(payloads[1].limit(0), "h")
    assert tuple(D.dedupe_summary(counts).first()) == (0, 0, 0, 0, 0.0)


def test_group_sizes_and_top_hashes(payloads):
    data, df = payloads
    counts = D.hash_counts(df, "h")
    want = Counter(d[2] for d in data)
    assert rows(D.dup_group_sizes(counts)) == rows_of(Counter(n for n in want.values() if n > 1).items())
    top = [(r["h"], r["n"]) for r in D.top_duplicate_hashes(counts, "h", 3).collect()]
    assert top == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:3]
    assert D.repeated_hashes(counts).first()[0] == sum(n > 1 for n in want.values())


def rows_of(pairs):
    return sorted((tuple(p) for p in pairs), key=repr)


def _counts(spark, values, dim="d"):
    return spark.createDataFrame([(dim, str(i), v) for i, v in enumerate(values)], "dim string, class_id string, n long")


@pytest.mark.parametrize("values", [[5], [1, 1, 1], [10, 1, 3, 3, 7], list(range(1, 30))])
def test_entropy_and_gini(spark, values):
    counts = _counts(spark, values)
    p = np.array(values) / sum(values)
    entropy = 0.0 if len(values) == 1 else float(-(p * np.log(p + 1e-12)).sum() / math.log(len(values)))
    x, n = np.sort(values), len(values)
    gini = float(((2 * np.arange(1, n + 1) - n - 1) * x).sum() / (n * x.sum()))
    assert P.normalized_entropy(counts).first()["entropy_norm"] == pytest.approx(entropy, abs=1e-12)
    assert P.gini(counts).first()["gini"] == pytest.approx(gini, abs=1e-12)


def test_published_class_balance(spark):
    from tests.test_splits import CLASS_TOTALS

    row = P.class_balance(_counts(spark, CLASS_TOTALS)).first()
    assert row["classes"] == 27 and row["lt_50"] == 0 and row["lt_100"] == 2
    assert round(row["entropy_norm"], 6) == 0.818681
    assert round(row["gini"], 6) == 0.584959
    assert round(row["top_share"], 6) == 0.197933


def test_correlation_of_a_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 1.0), (4.0, 5.0, 0.0)], "a double, b double, c double")
    got = {(r["c1"], r["c2"]): r["r"] for r in P.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] is None and got["b", "b"] is None
    assert got["a", "c"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 1, 0])[0, 1])
    assert got["c", "a"] == got["a", "c"]


def test_correlation_with_missing_values_is_pairwise(spark):
    import pandas as pd

    rng = np.random.default_rng(6)
    m = rng.normal(size=(60, 3)) + 1e6
    m[:, 2] += 3 * m[:, 0]
    data = [tuple(None if (i + k) % 11 == 0 else float(v) for k, v in enumerate(row)) for i, row in enumerate(m)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    want = pd.DataFrame(data, columns=list("abc"), dtype=float).corr()
    for r in P.correlation_matrix(df, list("abc")).collect():
        assert r["r"] == pytest.approx(want.loc[r["c1"], r["c2"]], abs=1e-9)
    whole = df.na.drop()
    want = whole.toPandas().corr()
    for r in P.correlation_matrix(whole, list("abc")).collect():
        assert r["r"] == pytest.approx(want.loc[r["c1"], r["c2"]], abs=1e-9)


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(2)
    xs = rng.gamma(2.0, 3.0, 500)
    df = spark.createDataFrame([(float(x), 7.0, None) for x in xs], "x double, same double, nothing double")
    got = P.histogram(df, ["x", "same", "nothing"], 12).collect()
    want, edges = np.histogram(xs, 12)
    bins = {r["bin"]: r for r in got if r["metric"] == "x"}
    assert [bins[i]["n"] if i in bins else 0 for i in range(12)] == list(want)
    assert bins[0]["lo"] == edges[0]
    assert [(r["bin"], r["n"]) for r in got if r["metric"] == "same"] == [(0, 500)]
    assert not [r for r in got if r["metric"] == "nothing"]


def test_box_stats_hot_group(spark):
    rng = np.random.default_rng(4)
    data = [("hot", float(x)) for x in rng.normal(size=300)] + [("hot", 40.0), ("rare", 1.0)]
    got = {r["g"]: r for r in P.box_stats(spark.createDataFrame(data, "g string, v double"), "g", "v").collect()}
    v = np.array([x for g, x in data if g == "hot"])
    q25, q50, q75 = np.quantile(v, [0.25, 0.5, 0.75])
    lo, hi = q25 - 1.5 * (q75 - q25), q75 + 1.5 * (q75 - q25)
    inside = v[(v >= lo) & (v <= hi)]
    row = got["hot"]
    assert (row["q25"], row["q50"], row["q75"]) == pytest.approx((q25, q50, q75))
    assert (row["whisker_low"], row["whisker_high"], row["outliers"]) == (inside.min(), inside.max(), len(v) - len(inside))
    assert got["rare"]["outliers"] == 0


def test_profiles_of_nothing(spark):
    df = spark.createDataFrame([], "width long, height long")
    counts = P.class_counts(df, ["width"])
    assert P.class_balance(counts).count() == 0
    assert P.histogram(df, ["width"]).count() == 0
    assert P.density_2d(df, "width", "height").count() == 0
    assert P.numeric_profile(df, ["width"]).first()["q50"] is None
    assert P.hash_sample(df.withColumn("id", F.lit(1)), "id", 5, 1).count() == 0


def test_correlation_has_one_arithmetic_with_and_without_nulls(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(1e6, 1, 500), rng.normal(size=500)
    c = a + b
    data = [(float(a[i]), None if i % 7 == 0 else float(b[i]), float(c[i]), 5.0) for i in range(500)]
    got = {(r.c1, r.c2): r.r for r in P.correlation_matrix(spark.createDataFrame(data, "a double, b double, c double, k double").repartition(6), ["a", "b", "c", "k"]).collect()}
    there = np.arange(500) % 7 > 0
    assert got["a", "c"] == pytest.approx(np.corrcoef(a, c)[0, 1], abs=1e-9) == got["c", "a"]
    assert got["a", "b"] == pytest.approx(np.corrcoef(a[there], b[there])[0, 1], abs=1e-9)
    assert got["a", "a"] == pytest.approx(1) and got["k", "k"] is None and got["a", "k"] is None and len(got) == 16
    empty = P.correlation_matrix(spark.createDataFrame([], "a double, b double"), ["a", "b"])
    assert [r.r for r in empty.collect()] == [None] * 4


def test_stored_sketches_add_up(spark):
    df = spark.range(30_000).select(
        (F.col("id") % 6).cast("string").alias("shard"), F.pmod(F.xxhash64("id"), F.lit(900)).alias("d"), F.when(F.col("id") % 6 < 5, F.col("id").cast("double")).alias("x")
    )
    stored = K.shard_sketches(df.where("shard < '4'"), ["d"], ["x"], "shard")
    more = K.add_new_shards(stored, df, ["d"], ["x"], "shard")
    assert more.count() == 12 and more.where("shard = '5' AND column = 'x'").first().ranks is None
    whole = K.shard_sketches(df, ["d"], ["x"], "shard")
    assert rows(K.merged_coverage(more)) == rows(K.merged_coverage(whole))
    assert abs(K.merged_coverage(more).first().classes - 900) <= 900 * 3 * K.HLL_ERROR
    found = K.merged_profile(more).first()
    assert (found.n, found.min, found.max) == (25_000, 0.0, 29_998.0)
    for q, name in ((0.25, "q25"), (0.95, "q95")):
        assert abs(found[name] / 30_000 - q) < 0.01
    assert K.merged_coverage(stored.limit(0)).count() == 0
