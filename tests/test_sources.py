"""Shards, run folders, documents, manifests and streams on small files."""

from __future__ import annotations

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limner.functions.labels import CANDIDATE_LABELS
from limner.operators.images import image_dims
from limner.plans.staging import scratch_path, shared_root
from limner.schemas import IMAGE_SHARD, METRICS_LONG, conform, fields, require_columns
from limner.sinks import documents as DOC
from limner.sinks import tables as K
from limner.sources import runs as R
from limner.sources import shard_audit as A
from limner.sources import shards as S
from limner.sources import tables as T_
from limner.streaming import ingest as I
from limner.streaming import state as ST
from tests.conftest import rows
from tests.test_images import png

ROW = fields(id=T.LongType(), v=T.StringType())


@pytest.fixture()
def shard_dir(spark, tmp_path):
    """Three readable shards of different sizes (one empty), one broken, one other file."""
    root = tmp_path / "shards"
    for name, ids in (("b", [3, 4]), ("a/x", [0, 1, 2]), ("c", [])):
        df = spark.createDataFrame([(i, f"v{i}") for i in ids], ROW).coalesce(1)
        df.write.parquet(str(tmp_path / "parts" / name))
        part = [p for p in (tmp_path / "parts" / name).iterdir() if p.name.startswith("part-")][0]
        target = root / f"{name}.parquet"
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(part.read_bytes())
    (root / "broken.parquet").write_bytes(b"not parquet at all")
    (root / "notes.txt").write_text("hello")
    return str(root)


def test_locator_and_tolerance(spark, shard_dir):
    df = S.read_shards(spark, shard_dir, ROW, ["id"], tolerant=True)
    name = F.element_at(F.split("source_shard", "/"), -1)
    assert rows(df.select(name, "source_row_idx", "id")) == [
        ("b.parquet", 0, 3), ("b.parquet", 1, 4), ("x.parquet", 0, 0), ("x.parquet", 1, 1), ("x.parquet", 2, 2)
    ]
    with pytest.raises(Exception):
        S.read_shards(spark, shard_dir, ROW).collect()


def test_only_wanted_columns_are_read(spark, shard_dir):
    plan = S.read_shards(spark, shard_dir, ROW, ["id"], tolerant=True)._jdf.queryExecution().toString()
    read = plan.split("ReadSchema: ")[-1]
    assert read.startswith("struct<id:bigint") and "v:string" not in read


def test_broken_shards_are_named_and_empty_ones_are_not(spark, shard_dir):
    bad = S.bad_shards(spark, shard_dir, ROW).collect()
    assert [(os.path.basename(r["path"]), r["length"]) for r in bad] == [("broken.parquet", 18)]


def test_footprint_counts_all_files(spark, shard_dir, tmp_path):
    row = S.dataset_footprint(spark, shard_dir).first()
    total = sum(os.path.getsize(os.path.join(d, f)) for d, _s, fs in os.walk(shard_dir) for f in fs if not f.endswith(".crc"))
    assert (row["shards"], row["disk_size_bytes"]) == (4, total)
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "x.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        S.dataset_footprint(spark, str(empty))


def test_payload_from_bytes_and_from_files(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    (files / "a.png").write_bytes(png(3, 4))
    data = [((png(1, 2), None), 0, 0, 0), ((None, str(files / "a.png")), 0, 0, 1), ((None, str(files / "gone.png")), 0, 0, 2)]
    df = S.normalize_payload(spark.createDataFrame(data, IMAGE_SHARD), str(files))
    got = image_dims(df, "image_bytes").select("style", "width", "height", "error")
    assert rows(got) == [(0, 1, 2, None), (1, 3, 4, None), (2, None, None, "empty payload")]
    raw = spark.createDataFrame([(png(5, 6),)], "image binary")
    assert rows(image_dims(S.normalize_payload(raw), "image_bytes").select("width")) == [(5,)]


def test_index_join_and_its_rejects(spark, shard_dir):
    shards = S.read_shards(spark, shard_dir, ROW, tolerant=True)
    index = shards.filter("id IN (1, 4)").select("source_shard", "source_row_idx", (F.col("id") * 10).alias("style"))
    extra = index.limit(1).withColumn("source_row_idx", F.lit(99).cast("long"))
    gone = index.limit(1).withColumn("source_shard", F.lit("file:/gone.parquet"))
    index = index.unionByName(extra).unionByName(gone)
    assert rows(S.fetch_indexed(shards, index).select("id", "style")) == [(1, 10), (4, 40)]
    assert S.unmatched_index(shards, index).count() == 2


def test_required_columns(spark):
    df = spark.createDataFrame([(1, "x")], ROW)
    assert require_columns(df, ["id"]) is df
    with pytest.raises(ValueError, match="image_path, text"):
        require_columns(df, ["image_path", "text"])
    assert conform(df.select("v", F.col("id").cast("int")), ROW).schema == ROW


def test_config_lists(spark, tmp_path):
    path = tmp_path / "labels.json"
    path.write_text(json.dumps({"labels": CANDIDATE_LABELS, "prompt_templates": ["a {label}"]}, indent=2))
    got = T_.read_config_list(spark, str(path), "labels").orderBy("position").collect()
    assert [r["value"] for r in got] == CANDIDATE_LABELS


def test_metadata_and_defaults(spark, tmp_path):
    path = tmp_path / "meta.json"
    assert T_.read_meta(spark, str(path)) == {}
    path.write_text(json.dumps({"image_model_id": "stored", "text_model_id": ""}))
    meta = T_.read_meta(spark, str(path))
    defaults = {"image_model_id": "i", "text_model_id": "t"}
    assert T_.resolve_defaults({}, meta, defaults) == {"image_model_id": "stored", "text_model_id": "t"}
    assert T_.resolve_defaults({"image_model_id": "cli"}, meta, defaults)["image_model_id"] == "cli"


def test_cache_computes_once_and_redoes_a_half_written_table(spark, tmp_path):
    calls = []
    def compute():
        calls.append(1)
        return spark.range(3)
    path = str(tmp_path / "cache")
    for _ in range(2):
        assert T_.materialize_once(spark, path, compute).count() == 3
    assert len(calls) == 1
    os.remove(f"{path}/_SUCCESS")
    T_.materialize_once(spark, path, compute)
    assert len(calls) == 2


def _run(root, name, header, *lines):
    folder = root / name / "summary"
    folder.mkdir(parents=True)
    (folder / "metrics_long.csv").write_text("\n".join([header, *lines]) + "\n")


def test_runs_are_found_once_and_named_by_folder(spark, tmp_path):
    _run(tmp_path, "runA_1", "run_id,target,model_id,top1_accuracy", "runA_1,style,m,0.5", "runA_1,genre,m,oops")
    _run(tmp_path, "runA_2", "target,model_id,top1_accuracy", "style,m,0.7")
    _run(tmp_path, "runA_3", "target,model_id,top1_accuracy")
    (tmp_path / "runA_4").mkdir()
    _run(tmp_path, "other", "run_id,target,model_id,top1_accuracy", "other,style,m,0.9")
    frames = R.read_runs(spark, str(tmp_path), ["runA_*", "*_1", "nothing_*"])
    from limner.operators.leaderboard import coerce_numeric, union_runs

    got = coerce_numeric(union_runs(frames)).select("run_id", "target", "top1_accuracy")
    assert rows(got) == [("runA_1", "genre", None), ("runA_1", "style", 0.5), ("runA_2", "style", 0.7)]
    assert R.read_runs(spark, str(tmp_path), ["nothing_*"]) == []


def test_metric_documents_become_rows(spark, tmp_path):
    doc = {"model": "x/m1", "target": "style", "n_images": 4, "top1_accuracy": 0.5, "top5_accuracy": 1.0, "elapsed_seconds": 2.0,
           "images_per_second": 2.0, "per_class": {"Cubism": {"n": 4, "top1_acc": 0.5}}}
    for run, target, tag in (("r1", "style", "x__m1"), ("r2", "genre", "x__m1"), ("r2", "genre", "unlisted")):
        folder = tmp_path / run / target
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"metrics_{tag}.json").write_text(json.dumps(doc, indent=2))
    models = spark.createDataFrame([("x/m1", "x__m1"), ("x/m2", "x__m2")], "model_id string, tag string")
    got = R.collect_metrics(spark, str(tmp_path), models, ["style", "genre"])
    assert got.columns == METRICS_LONG.fieldNames()
    assert rows(got.select("run_id", "target", "model_id", "n_images")) == [("r1", "style", "x/m1", 4), ("r2", "genre", "x/m1", 4)]
    assert all(r["predictions_path"].endswith("/predictions_x__m1.parquet") for r in got.collect())
    assert R.collect_metrics(spark, str(tmp_path / "r1"), models, ["style"]).count() == 0


def test_report_and_document_files(spark, tmp_path):
    doc = spark.createDataFrame([(47501, 0.25, None)], "n long, share double, note string")
    lines = DOC.report_lines(doc, [F.lit("# Title"), DOC.bullet("Rows", DOC.thousands(F.col("n"))), F.lit("")])
    K.write_lines(lines, str(tmp_path / "report"))
    text = [p for p in (tmp_path / "report").iterdir() if p.name.startswith("part-")][0].read_text()
    assert text == "# Title\n- Rows: **47,501**\n\n"
    K.write_document(doc, str(tmp_path / "doc"))
    part = [p for p in (tmp_path / "doc").iterdir() if p.name.startswith("part-")][0]
    assert json.loads(part.read_text()) == {"n": 47501, "share": 0.25, "note": None}


def test_summary_document_nests_parts(spark):
    one = spark.createDataFrame([(1, "a")], "x int, y string")
    doc = DOC.summary_document(spark, {"pair": one, "n": spark.range(4).agg(F.count("*")), "fixed": F.lit("v")}).first()
    assert (doc["pair"]["y"], doc["n"], doc["fixed"]) == ("a", 4, "v")


def test_finished_work_is_skipped_until_its_parameters_change(spark, tmp_path):
    path = str(tmp_path / "manifest")
    work = spark.createDataFrame([("style", "m1", 1), ("style", "m2", 1)], "target string, model_id string, templates int")
    keyed = K.config_hash(work, ["templates"])
    assert K.pending_work(keyed, K.read_manifest(spark, path, keyed)).count() == 2
    K.write_manifest(keyed.filter("model_id = 'm1'"), path)
    done = K.read_manifest(spark, path, keyed)
    assert [r["model_id"] for r in K.pending_work(keyed, done).collect()] == ["m2"]
    changed = K.config_hash(work.withColumn("templates", F.lit(4)), ["templates"])
    assert K.pending_work(changed, done).count() == 2


def test_shared_folder_comes_from_the_session(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


# Streams


def _add_shard(spark, folder, name, data, schema=ROW):
    import shutil

    tmp = scratch_path(spark, "part")
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(tmp)
    part = [p for p in os.listdir(tmp) if p.startswith("part-")][0]
    os.makedirs(folder, exist_ok=True)
    shutil.copy(f"{tmp}/{part}", f"{folder}/{name}.parquet")


def test_a_restarted_stream_reads_only_new_shards(spark, tmp_path):
    source, cache, state = (str(tmp_path / n) for n in ("in", "cache", "state"))
    _add_shard(spark, source, "a", [(1, "x"), (2, "y")])
    run = lambda: I.stream_to_cache(I.stream_shards(spark, source, ROW).select("id"), cache, state)
    run().awaitTermination()
    _add_shard(spark, source, "b", [(3, "z")])
    with I.ProgressLog(spark) as log:
        second = run()
        second.awaitTermination()
        progress = log.table(second)
    assert rows(spark.read.parquet(cache)) == [(1,), (2,), (3,)]
    assert progress.agg(F.sum("input_rows")).first()[0] == 1
    left = I.eta(progress, 11).first()
    assert left["done"] == 1 and left["seconds_left"] > 0


def _sized(df, payload):
    return df.withColumn("size", F.octet_length(payload)).drop(payload)


def test_payloads_are_measured_where_they_are_read(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.bin").write_bytes(b"12345")
    root = str(tmp_path / "files")
    rows_ = [(1, (b"xy", None)), (2, (None, f"{root}/a.bin")), (3, (None, f"file://{root}/a.bin")), (4, (None, f"{root}/none")), (5, (None, None)), (6, None)]
    df = spark.createDataFrame(rows_, "id long, image struct<bytes: binary, path: string>")
    assert rows(S.measure_payloads(df, _sized, root)) == [(1, 2), (2, 5), (3, 5), (4, None), (5, None), (6, None)]
    assert rows(S.measure_payloads(df, _sized)) == [(1, 2), (2, None), (3, None), (4, None), (5, None), (6, None)]
    plain = spark.createDataFrame([(1, b"abc"), (2, None)], "id long, image binary")
    assert rows(S.measure_payloads(plain, _sized)) == [(1, 3), (2, None)]
    with pytest.raises(ValueError, match="still hold payloads"):
        S.measure_payloads(df, lambda d, p: d, root)


@pytest.mark.parametrize("words", [1 << 20, 3])
def test_indexed_rows_are_marked_in_the_scan(spark, monkeypatch, words):
    monkeypatch.setattr(S, "MARK_WORDS", words)
    shards = spark.range(1000).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source_shard"), F.expr("id div 3").alias("source_row_idx"), F.encode(F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")), "UTF-8").alias("payload"))
    index = spark.createDataFrame([("s0", 0, "a"), ("s0", 63, "b"), ("s1", 64, "c"), ("s2", 332, "d"), ("s2", 9999, "e"), ("s9", 1, "f")], "source_shard string, source_row_idx long, name string")
    kept = S.marked_rows(shards, index)
    assert kept.columns == shards.columns
    assert rows(kept.select("source_shard", "source_row_idx")) == [("s0", 0), ("s0", 63), ("s1", 64), ("s2", 332)]
    measured = S.measure_indexed(shards, index, _sized, "payload")
    assert rows(measured.select("name", "size")) == [("a", 0), ("b", 39), ("c", 43), ("d", 48)]
    monkeypatch.setattr("limner.sources.shards.if_small", lambda df: None)
    assert rows(S.fetch_indexed(shards, index).select("name", F.length("payload"))) == [("a", 0), ("b", 39), ("c", 43), ("d", 48)]


def test_progress_outlives_a_failure(spark, tmp_path):
    source, out, log, state = (str(tmp_path / n) for n in ("in", "out", "log", "state"))
    for i, name in enumerate("abc"):
        _add_shard(spark, source, name, [(10 * i + k, "v") for k in range(i + 1)])
    stream = I.stream_shards(spark, source, ROW, files_per_trigger=1).select("id")
    broken = stream.select(F.when(F.col("id") == 20, F.raise_error(F.lit("gone"))).otherwise(F.col("id")).cast("long").alias("id"))
    assert I.read_progress(spark, log).count() == 0
    with pytest.raises(StreamingQueryException):
        I.stream_with_progress(broken, out, log, state).awaitTermination()
    assert sorted(r.input_rows for r in I.read_progress(spark, log).collect()) == [1, 2]
    I.stream_with_progress(stream, out, log, state).awaitTermination()
    assert sorted(r.input_rows for r in I.read_progress(spark, log).collect()) == [1, 2, 3]
    assert rows(spark.read.parquet(out).select("id")) == [(0,), (10,), (11,), (20,), (21,), (22,)]
    assert I.eta(I.read_progress(spark, log), 10).first()["done"] == 6


def test_shards_are_audited_in_one_pass(spark, tmp_path):
    root = str(tmp_path / "shards")
    for i, name in enumerate(("whole", "page", "footer", "empty")):
        n = 0 if name == "empty" else 3000 + i
        table = pa.table({"id": pa.array(range(n), pa.int64()), "v": pa.array([f"value {k * 7919}" for k in range(n)])})
        os.makedirs(f"{root}/{name}")
        pq.write_table(table, f"{root}/{name}/x.parquet", row_group_size=1000, write_page_checksum=True)
    A.break_a_page(f"{root}/page/x.parquet")
    A.cut_the_footer(f"{root}/footer/x.parquet")
    (tmp_path / "shards" / "note.txt").write_text("no shard")
    audit = A.audit_shards(spark, root).cache()
    name = F.element_at(F.split("path", "/"), -2)
    assert rows(audit.groupBy(name).agg(F.sum("n_rows"), F.count("error"))) == [("empty", 0, 0), ("footer", None, 1), ("page", 3001, 1), ("whole", 3000, 0)]
    lost = audit.where("error = 'damaged pages'").first()
    assert (lost.row_group, lost.first_row, lost.n_rows, lost.lost_columns) == (0, 0, 1000, ["id"])
    assert rows(A.lost_ranges(audit).select(name, "error", "first_row", "end_row")) == [("footer", "no parquet footer", None, None), ("page", "damaged pages", 0, 1000)]
    assert rows(A.damaged_shards(audit).select(name, "expected_rows", "read_rows")) == [("footer", None, 0), ("page", 3001, 2001)]
    assert A.audit_shards(spark, f"{root}/page", ["v"]).where("error IS NOT NULL").count() == 0  # the other column is sound
    assert A.audit_shards(spark, f"file://{root}/whole/x.parquet").count() == 3


def test_stream_stops_taking_after_n_rows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, name in enumerate("abc"):
        _add_shard(spark, source, name, [(10 * i + k, "v") for k in range(4)])
    stream = I.stream_shards(spark, source, ROW, files_per_trigger=1).select("source_shard", "source_row_idx", "id")
    I.take_good_rows(stream, out, 6).awaitTermination()
    got = spark.read.parquet(out).groupBy("source_shard").count().collect()
    assert sorted(r["count"] for r in got) == [2, 4]


def test_stream_quarantine(spark, tmp_path):
    schema = fields(id=T.LongType(), payload=T.BinaryType())
    source, good, bad = (str(tmp_path / n) for n in ("in", "good", "bad"))
    _add_shard(spark, source, "a", [(1, png(3, 4)), (2, b"junk")], schema)
    stream = image_dims(I.stream_shards(spark, source, schema), "payload").select("id", "width", "error")
    I.stream_with_quarantine(stream, good, bad).awaitTermination()
    assert rows(spark.read.parquet(good).select("id", "width")) == [(1, 3)]
    assert rows(spark.read.parquet(bad).select("id", "error")) == [(2, "unknown image format")]


def test_stream_dedupe_within_and_across_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    _add_shard(spark, source, "a", [(1, "x"), (2, "x"), (3, "y")])
    _add_shard(spark, source, "b", [(4, "y"), (5, "z")])
    stream = I.stream_shards(spark, source, ROW, files_per_trigger=1).select("v")
    assert rows(ST.drain(ST.stream_dedupe(stream, "v"), "d", "append")) == [("x",), ("y",), ("z",)]


def test_stream_dedupe_with_event_time(spark, tmp_path):
    schema = fields(ts=T.TimestampType(), v=T.StringType())
    source = str(tmp_path / "in")
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    _add_shard(spark, source, "a", [(t, "x"), (t, "x"), (t, "y")], schema)
    stream = I.stream_shards(spark, source, schema).select("ts", "v")
    assert rows(ST.drain(ST.stream_dedupe(stream, "v", "ts"), "d", "append").select("v")) == [("x",), ("y",)]


def test_running_accuracy(spark, tmp_path):
    schema = fields(true_label=T.IntegerType(), pred_label=T.IntegerType())
    source = str(tmp_path / "in")
    _add_shard(spark, source, "a", [(1, 1), (1, 2)], schema)
    _add_shard(spark, source, "b", [(3, 3), (3, 3)], schema)
    stream = I.stream_shards(spark, source, schema, files_per_trigger=1)
    assert rows(ST.drain(ST.stream_accuracy(stream), "acc")) == [(4, 0.75)]
