"""Cases that once gave wrong answers: missing predictions, damaged pages, many cells, NaN, resumed streams."""

from __future__ import annotations

import os

import numpy as np
import pyspark.sql.types as T
from pyspark.sql import functions as F

from limner.operators import leaderboard as L
from limner.operators import linear_map as M
from limner.operators import metrics as A
from limner.operators import profile as P
from limner.plans.ordering import exact_quantiles
from limner.sources import runs as R
from limner.sources import shards as S
from limner.streaming import ingest as I
from limner.streaming import state as ST
from tests.conftest import rows


def test_rows_without_prediction_are_misses(spark, tmp_path):
    schema = "true_label int, pred_label int, true_rank int"
    df = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (1, None, None), (2, None, None)], schema)
    assert A.accuracy(df).first()["top1_accuracy"] == 0.5
    assert A.evaluate(df).first()["top1_accuracy"] == 0.5
    names = spark.createDataFrame([(1, "a"), (2, "b")], "class_id int, name string")
    assert {r["top1_acc"] for r in A.per_class_accuracy(df, names).collect()} == {0.5}
    df.write.parquet(str(tmp_path / "in"))
    stream = I.stream_shards(spark, str(tmp_path / "in"), df.schema)
    assert rows(ST.drain(ST.stream_accuracy(stream), "acc")) == [(4, 0.5)]


def test_quantiles_of_many_cells(spark):
    rng = np.random.default_rng(4)
    data = [(int(g), float(a), float(b)) for g in range(60) for a, b in rng.normal(size=(20, 2))]
    df = spark.createDataFrame(data, "g int, a double, b double")
    got = {(r["g"], r["metric"], r["q"]): r["value"] for r in exact_quantiles(df, ["a", "b"], (0.1, 0.25, 0.5, 0.9), by=["g"]).collect()}
    assert len(got) == 60 * 2 * 4
    for (g, m, q), value in got.items():
        assert np.isclose(value, np.quantile([r[1 if m == "a" else 2] for r in data if r[0] == g], q))


def test_histograms_leave_out_nan(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(10)] + [(float("nan"), 1.0), (float("inf"), None)], "x double, y double")
    got = {r["bin"]: r["n"] for r in P.histogram(df, ["x"], 5).collect()}
    assert got == dict.fromkeys(range(5), 2)
    assert P.density_2d(df, "x", "y", 5).where("x_bin IS NOT NULL AND y_bin IS NOT NULL").agg(F.sum("n")).first()[0] == 10


def test_folds_count_existing_pairs_only(spark):
    rng = np.random.default_rng(2)
    data = [(i, None, None) for i in range(10)] + [(10 + i, *[v.tolist() for v in rng.normal(size=(2, 2))]) for i in range(10)]
    schema = "id int, x array<double>, y array<double>"
    whole = M.fit_linear_map(spark.createDataFrame(data, schema), "x", "y", ["id"], folds=2)
    valid = M.fit_linear_map(spark.createDataFrame(data[10:], schema), "x", "y", ["id"], folds=2)
    assert np.allclose(np.array(rows(whole.search(spark)), float), np.array(rows(valid.search(spark)), float))


def test_damaged_pages_are_named(spark, tmp_path):
    root = str(tmp_path / "shards")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    for name in ("good", "bad"):
        df = spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("v")).coalesce(1)
        df.write.option("compression", "gzip").mode("append").parquet(root)
    files = sorted(f for f in os.listdir(root) if f.endswith(".parquet"))
    path = os.path.join(root, files[0])
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 2 : len(raw) // 2 + 4000] = bytes(4000)
    with open(path, "wb") as f:
        f.write(raw)
    crc = os.path.join(root, f".{files[0]}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    bad = S.bad_shards(spark, root, schema).collect()
    assert [(os.path.basename(r["path"]), r["error"], r["expected_rows"]) for r in bad] == [(files[0], "damaged pages", 20_000)]
    assert bad[0]["read_rows"] < 20_000
    audit = P.audit_report(S.read_shards(spark, root, schema, tolerant=True), spark.createDataFrame([("x",)], "error string"), S.bad_shards(spark, root, schema))
    assert audit.first()["bad_shards"] == 1


def test_progress_keeps_all_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(6):
        spark.range(100).write.mode("append").parquet(source)
    schema = T.StructType([T.StructField("id", T.LongType())])
    stream = I.stream_shards(spark, source, schema, files_per_trigger=2)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        with I.ProgressLog(spark) as log:
            query = I.stream_to_cache(stream.select("id"), str(tmp_path / "out"))
            query.awaitTermination()
            assert I.eta(log.table(query), 0).first()["done"] == 600
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_drain_goes_on_where_it_ended(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = T.StructType([T.StructField("v", T.StringType())])
    read = lambda: ST.drain(ST.stream_dedupe(I.stream_shards(spark, source, schema).select("v"), "v"), "d", "append", out, state)
    spark.createDataFrame([("x",), ("y",)], "v string").write.parquet(source)
    assert rows(read()) == [("x",), ("y",)]
    spark.createDataFrame([("y",), ("z",)], "v string").write.mode("append").parquet(source)
    assert rows(read()) == [("x",), ("y",), ("z",)]


def test_scanned_runs_are_folders(spark, tmp_path):
    for run in ("r1", "r2", "r3"):
        folder = tmp_path / run / "summary"
        folder.mkdir(parents=True)
        (folder / "metrics_long.csv").write_text("target,model_id,top1_accuracy,top5_accuracy,n_images,images_per_second\nstyle,m,0.5,0.9,10,3.0\n")
    frames = R.read_runs(spark, str(tmp_path), ["r*"])
    n = R.count_runs(spark, str(tmp_path), ["r*", "r1"])
    assert len(frames) == 1 and n == 3
    assert L.merge_runs(frames, n_scanned=n)["merge_summary"].first()["n_runs_scanned"] == 3
