"""Dense index, running totals, quantiles and hash cuts against plain Python."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from limner.operators.indexing import adaptive_split, budgeted_prefix, cap_rows, fold_starts, kfold_id, split_sizes
from limner.operators.profile import hash_sample
from limner.plans import joins
from limner.plans.joins import if_small, lookup_join
from limner.plans.ordering import dense_index, exact_quantiles, hash_cuts, hash_order, running_totals
from tests.conftest import rows


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    # One group holds most of the rows, and values repeat.
    data = [(i, "hot" if i % 10 < 7 else f"g{i % 3}", float(rng.randint(0, 40))) for i in range(700)]
    return data, spark.createDataFrame(data, "id long, g string, v double").repartition(7)


@pytest.mark.parametrize("parts", [1, 7, 32])
def test_dense_index_is_the_sorted_position(numbers, parts):
    data, df = numbers
    got = {r["id"]: r["idx"] for r in dense_index(df.repartition(parts), [F.desc("v"), "id"]).collect()}
    want = {d[0]: i for i, d in enumerate(sorted(data, key=lambda d: (-d[2], d[0])))}
    assert got == want


def test_dense_index_of_nothing(numbers):
    assert dense_index(numbers[1].limit(0), ["id"]).count() == 0


def test_running_totals_by_group(numbers):
    data, df = numbers
    out = running_totals(df, ["v", "id"], {"s": "v", "k": F.lit(1)}, by=["g"])
    got = {r["id"]: (r["s"], r["k"], r["s_all"], r["k_all"]) for r in out.collect()}
    for g in {d[1] for d in data}:
        part = sorted((d for d in data if d[1] == g), key=lambda d: (d[2], d[0]))
        total, run = sum(d[2] for d in part), 0.0
        for k, d in enumerate(part, 1):
            run += d[2]
            assert got[d[0]] == (run, k, total, len(part))


def test_running_totals_keep_a_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    out = running_totals(df, ["v"], {"s": "v"}, by=["g"])
    assert rows(out) == rows(spark.createDataFrame([(None, 1, 1, 3), (None, 2, 3, 3), ("a", 3, 3, 3)], "g string, v int, s long, t long"))


def test_running_totals_shuffle_rows_once(spark):
    """Negative and missing values, many groups and one over all ranges; the rows are in one exchange only, that to their ranges."""
    data = [(None if i % 3 == 0 else f"g{i % 40}", i, None if i % 11 == 0 else (i * 37) % 19 - 9) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, i long, v int").repartition(7)
    out = running_totals(df, ["i"], {"s": "v", "x": F.col("v") / 4}, by=["g"])
    totals, want = {}, {}
    for g, i, v in data:
        totals[g] = totals.get(g, 0) + (v or 0)
        want[i] = totals[g]
    got = out.collect()
    assert len(got) == 3000 and all((r.s, r.x, r.s_all, r.x_all) == (want[r.i], want[r.i] / 4, totals[r.g], totals[r.g] / 4) for r in got)
    assert dict(out.dtypes)["s"] == "bigint" and dict(out.dtypes)["x"] == "double"
    # what is read back is joined to one row for each group and range, without another exchange of the rows
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g" not in plan.split("BroadcastExchange")[0] and "Window" not in plan.split("BroadcastExchange")[0]
    assert running_totals(df.limit(0), ["i"], {"s": "v"}).count() == 0


def test_exact_quantiles_match_numpy(numbers):
    data, df = numbers
    qs = (0.0, 0.25, 0.5, 0.75, 0.95, 1.0)
    got = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(df, ["v"], qs, by=["g"]).collect()}
    for g in {d[1] for d in data}:
        values = [d[2] for d in data if d[1] == g]
        for q in qs:
            assert got[g, q] == pytest.approx(np.quantile(values, q), abs=1e-12)


@pytest.mark.parametrize("kind", ["spread", "constant", "two", "tiny", "infinite", "ties"])
def test_quantiles_of_awkward_values(spark, kind):
    rng = np.random.default_rng(5)
    values = {
        "spread": np.concatenate([10.0 ** rng.uniform(-200, 200, 300), -(10.0 ** rng.uniform(-200, 200, 300))]),
        "constant": np.full(50, 3.25),
        "two": np.array([1.0, np.nextafter(1.0, 2.0)]),
        "tiny": np.arange(9) * 5e-324,
        "infinite": np.array([1.0, 2.0, 3.0, np.inf, np.inf]),
        "ties": rng.integers(0, 3, 5000).astype(float),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    qs = (0.0, 0.25, 0.5, 0.75)
    if kind == "infinite":
        qs = (0.0, 0.25)
    got = {r["q"]: r["value"] for r in exact_quantiles(df, ["v"], qs).collect()}
    for q in qs:
        assert got[q] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=0)


def test_quantiles_of_many_groups(spark):
    data = [(g, float((g * 7 + i * i) % 23)) for g in range(100) for i in range(9)]
    got = {r["g"]: r["value"] for r in exact_quantiles(spark.createDataFrame(data, "g int, v double"), ["v"], [0.3], by=["g"]).collect()}
    for g in range(100):
        assert got[g] == pytest.approx(np.quantile([v for k, v in data if k == g], 0.3))


def test_quantiles_whose_brackets_fail_are_found_all_the_same(spark, monkeypatch):
    """With tiny sketches and no slack the brackets miss; those ranks are looked for among all values."""
    monkeypatch.setattr("limner.plans.ordering.SKETCH_K", 8)
    monkeypatch.setattr("limner.plans.ordering.SKETCH_ERROR", 0.003)
    rng = np.random.default_rng(9)
    data = [(g, float(v)) for g, n in (("a", 40_000), ("b", 7000), (None, 90)) for v in rng.integers(0, 30_000, n)]
    qs = (0.05, 0.5, 0.77)
    got = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(spark.createDataFrame(data, "g string, v double").repartition(5), ["v"], qs, by=["g"]).collect()}
    assert len(got) == 9
    for (g, q), value in got.items():
        assert value == pytest.approx(np.quantile([v for k, v in data if k == g], q))


def test_quantiles_of_five_thousand_groups_and_two_metrics(spark):
    df = spark.range(40_000).select((F.col("id") % 5000).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("b"))
    found = exact_quantiles(df, ["a", "b"], (0.25, 0.5), by=["g"])
    want = df.groupBy("g").agg(*[F.percentile(c, q).alias(f"{c}{q}") for c in ("a", "b") for q in (0.25, 0.5)])
    wide = found.groupBy("g").agg(*[F.max(F.when((F.col("metric") == c) & (F.col("q") == q), F.col("value"))).alias(f"{c}{q}") for c in ("a", "b") for q in (0.25, 0.5)])
    assert wide.count() == 5000 and wide.exceptAll(want).count() == 0


def test_long_row_caps_use_the_key_of_the_last_row(spark, monkeypatch):
    monkeypatch.setattr("limner.operators.indexing.TOP_ROWS", 3)
    df = spark.range(20).select((F.col("id") * 7 % 20).alias("id"))
    assert rows(cap_rows(df, ["id"], 5)) == [(i,) for i in range(5)]
    assert cap_rows(df, ["id"], 50).count() == 20


def test_quantiles_ignore_null_and_handle_one_row(spark):
    df = spark.createDataFrame([(None,), (3.0,)], "v double")
    assert [r["value"] for r in exact_quantiles(df, ["v"], (0.25, 0.9)).collect()] == [3.0, 3.0]


def test_hash_cuts_find_the_ranked_key(spark, numbers):
    data, df = numbers
    keyed = df.withColumn("h", hash_order(["id"], 5))
    cuts = spark.createDataFrame([("hot", "a", 10), ("hot", "b", 490), ("g0", "a", 1), ("g0", "b", 100_000)], "g string, cut string, rank long")
    got = {(r["g"], r["cut"]): r["id"] for r in hash_cuts(keyed, "h", "id", cuts, ["g"]).collect()}


    ranked = {g: [i for _h, i in sorted((hashlib.md5(f"{d[0]}|5".encode()).hexdigest(), d[0]) for d in data if d[1] == g)] for g in ("hot", "g0")}
    assert got == {("hot", "a"): ranked["hot"][9], ("hot", "b"): ranked["hot"][489], ("g0", "a"): ranked["g0"][0]}


def test_hash_sample_is_the_same_at_any_layout(numbers):
    data, df = numbers
    a = {r["id"] for r in hash_sample(df.repartition(1), "id", 50, 42).collect()}
    b = {r["id"] for r in hash_sample(df.repartition(13), "id", 50, 42).collect()}
    assert a == b and len(a) == 50
    assert hash_sample(df, "id", 10_000, 42).count() == len(data)


def test_fold_starts():
    assert fold_starts(12, 5) == [0, 3, 6, 8, 10]
    assert fold_starts(3, 5) == [0, 1, 2, 3, 3]


@pytest.mark.parametrize("n", [0, 3, 12, 101])
def test_kfold_is_contiguous(spark, n):
    df = spark.range(n).withColumn("id", F.col("id") * 3)
    got = [r["fold"] for r in kfold_id(df, ["id"], 5).orderBy("id").collect()]
    sizes = [n // 5 + (1 if f < n % 5 else 0) for f in range(5)]
    assert got == [f for f, size in enumerate(sizes) for _ in range(size)]


def test_budgeted_prefix_takes_whole_shards_then_a_part(spark):
    df = spark.createDataFrame([(s, i) for s, n in (("a", 3), ("b", 5), ("c", 4)) for i in range(n)], "shard string, pos long")
    assert rows(budgeted_prefix(df, "shard", "pos", 6)) == [("a", i) for i in range(3)] + [("b", i) for i in range(3)]
    assert budgeted_prefix(df, "shard", "pos", 100).count() == 12
    assert budgeted_prefix(df, "shard", "pos", 0).count() == 0


def test_cap_rows(spark):
    df = spark.range(10)
    assert cap_rows(df, ["id"], 0).count() == 10
    assert rows(cap_rows(df, ["id"], 2)) == [(0,), (1,)]


def test_split_sizes():
    assert split_sizes(100, 80, 10) == (80, 10)
    assert split_sizes(89, 80, 10) == (80, 9)
    assert split_sizes(2, 80, 10) == (1, 1)
    with pytest.raises(ValueError):
        split_sizes(1, 80, 10)


def test_adaptive_split_counts(spark):
    out = {r["split"]: r["count"] for r in adaptive_split(spark.range(57), "id", 40, 10, 1).groupBy("split").count().collect()}
    assert out == {"train": 40, "val": 10}
    out = {r["split"]: r["count"] for r in adaptive_split(spark.range(57), "id", 100, 10, 1).groupBy("split").count().collect()}
    assert out == {"train": 51, "val": 6}


def test_if_small(spark):
    assert if_small(spark.range(5), 5).count() == 5
    assert if_small(spark.range(6), 5) is None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_of_hot_keys_equals_a_plain_join(spark, how):
    hot = F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 11)
    facts = spark.range(500).select("id", hot.cast("long").alias("k"))
    dim = spark.createDataFrame([(k, f"n{k}") for k in (0, 2, 4, 7)], "k long, name string")
    assert [tuple(r) for r in joins.hot_keys(facts.where("k IS NOT NULL"), ["k"], 4).collect()] == [(7,)]
    joined = joins.join_unique(facts, dim, ["k"], how)
    assert rows(joined) == rows(facts.join(dim, "k", how))
    assert rows(joins.join_unique(facts.limit(0), dim, ["k"], how)) == []


def test_wide_rows_are_measured_before_they_are_fetched(spark, monkeypatch):
    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", 10_000)
    wide = spark.range(30).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    assert if_small(wide) is None and if_small(wide.limit(5)).count() == 5
    arrays = spark.range(30).select(F.array_repeat(F.lit(1.5), 500).alias("v"))
    assert if_small(arrays) is None


def test_lookup_join_beyond_the_broadcast_limit(spark):
    facts = spark.range(100).select("id", (F.col("id") % 5).alias("k"))
    dim = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    assert rows(lookup_join(facts, dim, ["k"], max_rows=2)) == rows(facts.join(dim, "k"))
