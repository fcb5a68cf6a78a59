"""Queries over splits, prompt scoring, metrics, losses and the linear map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limner.catalog import bindings as B
from limner.catalog.registry import having, query
from limner.functions import vectors as V
from limner.functions.numbers import fixed
from limner.functions.labels import CAPTION_TEMPLATE, STYLE_TEMPLATES
from limner.operators import encoding as E
from limner.operators import indexing as X
from limner.operators import linear_map as L
from limner.operators import metrics as M
from limner.operators import scoring as S
from limner.operators import splits as P
from limner.plans.evaluation_job import evaluate_linear_map, evaluate_prompts
from limner.plans.run_job import evaluate_run
from limner.plans.joins import lookup_join
from limner.plans.staging import scratch_path, stage
from limner.sinks.tables import write_predictions, write_splits

# Splits

# A draw is per class unless some class has a single row; then all rows form one group (-1).
SPLIT = """hashed AS (SELECT *, md5(CAST(source_row_idx AS VARCHAR) || '|42') AS h,
  CASE WHEN (SELECT min(n) FROM (SELECT count(*) AS n FROM feat GROUP BY style)) >= 2 THEN style ELSE -1 END AS grp FROM feat),
size1 AS (SELECT count(*) AS total, CAST(ceil(0.1::DOUBLE * count(*)) AS BIGINT) AS draws FROM hashed),
share1 AS (SELECT grp, count(*)::DOUBLE / any_value(total)::DOUBLE * any_value(draws)::DOUBLE AS exact FROM hashed, size1 GROUP BY 1),
spare1 AS (SELECT any_value(draws) - sum(floor(exact))::BIGINT AS spare FROM share1, size1),
quota1 AS (SELECT grp, floor(exact)::BIGINT + (row_number() OVER (ORDER BY exact - floor(exact) DESC, grp) <= (SELECT spare FROM spare1))::BIGINT AS q FROM share1),
rank1 AS (SELECT h.* EXCLUDE (grp), row_number() OVER (PARTITION BY h.grp ORDER BY h.h, h.source_row_idx) <= q.q AS test FROM hashed h JOIN quota1 q ON h.grp = q.grp),
rest AS (SELECT *, CASE WHEN (SELECT min(n) FROM (SELECT count(*) AS n FROM rank1 WHERE NOT test GROUP BY style)) >= 2 THEN style ELSE -1 END AS grp
  FROM rank1 WHERE NOT test),
size2 AS (SELECT count(*) AS total, CAST(ceil((0.1::DOUBLE / (1.0::DOUBLE - 0.1::DOUBLE)) * count(*)) AS BIGINT) AS draws FROM rest),
share2 AS (SELECT grp, count(*)::DOUBLE / any_value(total)::DOUBLE * any_value(draws)::DOUBLE AS exact FROM rest, size2 GROUP BY 1),
spare2 AS (SELECT any_value(draws) - sum(floor(exact))::BIGINT AS spare FROM share2, size2),
quota2 AS (SELECT grp, floor(exact)::BIGINT + (row_number() OVER (ORDER BY exact - floor(exact) DESC, grp) <= (SELECT spare FROM spare2))::BIGINT AS q FROM share2),
rank2 AS (SELECT r.*, row_number() OVER (PARTITION BY r.grp ORDER BY r.h, r.source_row_idx) <= q.q AS val FROM rest r JOIN quota2 q ON r.grp = q.grp),
splits AS (SELECT source_row_idx, style, genre, artist, orientation, megapixels, bytes_size, 'test' AS split FROM rank1 WHERE test
  UNION ALL SELECT source_row_idx, style, genre, artist, orientation, megapixels, bytes_size, CASE WHEN val THEN 'val' ELSE 'train' END FROM rank2)"""


def _splits(spark: SparkSession, sf: str) -> DataFrame:
    return P.stratified_split(B.feat(spark, sf), "source_row_idx", "style")


@query(having(B.GEOM, B.FEAT, SPLIT, then="SELECT source_row_idx, style, split FROM splits"))
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return _splits(spark, sf).select("source_row_idx", "style", "split")


@query(having(B.GEOM, B.FEAT, SPLIT, then="SELECT split, style, count(*) AS count FROM splits GROUP BY 1, 2"))
def split_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return P.split_distribution(_splits(spark, sf), "style")


@query(
    having(
        B.GEOM, B.FEAT, SPLIT,
        then="SELECT style, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, "
        "count(*) FILTER (split = 'test') AS test FROM splits GROUP BY 1",
    )
)
def split_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return P.split_pivot(P.split_distribution(_splits(spark, sf), "style"), "style")


def _map_sql(col: str) -> str:
    return (
        f"(SELECT string_agg({col} || ':' || n, ',' ORDER BY {col}) FROM (SELECT {col}, count(*) AS n FROM splits i "
        f"WHERE i.split = o.split GROUP BY 1)) AS {col}_counts"
    )


@query(
    having(
        B.GEOM, B.FEAT, SPLIT,
        then="SELECT split, count(*) AS n, count(DISTINCT style) AS styles, count(DISTINCT genre) AS genres, count(DISTINCT artist) AS artists, "
        + ", ".join(_map_sql(c) for c in ("orientation", "style", "genre"))
        + ", CAST(printf('%.4f', avg(megapixels)) AS DOUBLE) AS mean_megapixels, CAST(printf('%.0f', avg(bytes_size)) AS DOUBLE) AS mean_bytes "
        "FROM splits o GROUP BY split",
    )
)
def split_data_card(spark: SparkSession, sf: str) -> DataFrame:
    card = P.data_card(stage(_splits(spark, sf), "splits"))
    pair = lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))
    text = lambda c: F.array_join(F.transform(F.map_entries(c), pair), ",").alias(c)
    maps = ["orientation_counts", "style_counts", "genre_counts"]
    return card.select(*[text(c) if c in maps else F.col(c) for c in card.columns])


@query(
    having(
        B.GEOM, B.FEAT,
        then="SELECT 0::BIGINT AS overlapping, 0::BIGINT AS missing, 0::BIGINT AS unknown, count(*) AS sound FROM feat",
    )
)
def split_partition_check(spark: SparkSession, sf: str) -> DataFrame:
    return P.check_split_partition(_splits(spark, sf), B.feat(spark, sf), "source_row_idx")


@query(having(B.GEOM, B.FEAT, SPLIT, then="SELECT split, source_row_idx, style FROM splits"))
def split_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    write_splits(_splits(spark, sf).select("split", "source_row_idx", "style"), path)
    return spark.read.schema("source_row_idx long, style long, split string").option("header", True).csv(path)


ADAPTIVE = (
    "SELECT source_row_idx, CASE WHEN rn <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM "
    "(SELECT source_row_idx, row_number() OVER (ORDER BY md5(CAST(source_row_idx AS VARCHAR) || '|7'), source_row_idx) AS rn, "
    "count(*) OVER () AS n FROM geom)"
)


@query(having(B.GEOM, then=ADAPTIVE))
def adaptive_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.adaptive_split(B.geom(spark, sf), "source_row_idx", 10**12, 10**11, 7)
    return rows.select("source_row_idx", "split")


@query(
    having(
        B.GEOM,
        then="SELECT source_row_idx, CASE WHEN rn <= 900 THEN 'train' ELSE 'val' END AS split FROM (SELECT source_row_idx, row_number() OVER "
        "(ORDER BY md5(CAST(source_row_idx AS VARCHAR) || '|7'), source_row_idx) AS rn FROM geom) WHERE rn <= 1000",
    )
)
def adaptive_split_of_many_rows(spark: SparkSession, sf: str) -> DataFrame:
    """More rows than asked for: the sizes are as asked, and the rest is left out."""
    return X.adaptive_split(B.geom(spark, sf), "source_row_idx", 900, 100, 7).select("source_row_idx", "split")


@query(
    "SELECT vec_id, CAST(ntile(5) OVER (ORDER BY vec_id) - 1 AS INTEGER) AS fold FROM embeddings"
)
def kfold_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return X.kfold_id(B.table(spark, sf, "embeddings").select("vec_id"), ["vec_id"])


# Prompts and scores


@query(
    "SELECT CAST(p_partkey * 3 + t.id AS BIGINT) AS prompt_id, p_partkey AS class_id, CAST(t.id AS INTEGER) AS template_id, replace(t.tmpl, '{style}', p_name) AS prompt_text "
    "FROM part CROSS JOIN (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(STYLE_TEMPLATES[:3])) + ") AS t(id, tmpl)"
)
def prompt_grid(spark: SparkSession, sf: str) -> DataFrame:
    classes = B.table(spark, sf, "part").select(F.col("p_partkey").alias("class_id"), F.col("p_name").alias("name"))
    return S.build_prompts(classes, STYLE_TEMPLATES, 3)


@query(having(B.GEOM, then="SELECT source_row_idx, 'a painting in style_' || style AS text FROM geom"))
def caption_rows(spark: SparkSession, sf: str) -> DataFrame:
    return S.caption_rows(B.geom(spark, sf), "style", CAPTION_TEMPLATE).select("source_row_idx", "text")


@query(having(B.VEC, B.SCORES, then="SELECT vec_id, class_id, round(score, 9) AS score FROM scores"))
def prompt_scores(spark: SparkSession, sf: str) -> DataFrame:
    df, bank = B.scored(spark, sf)
    return B.rounded(S.scores_to_rows(df, ["vec_id"], bank.class_ids))


@query(having(B.VEC, B.SCORES, then="SELECT vec_id, class_id, round(score, 9) AS score FROM scores"))
def prompt_scores_builtin(spark: SparkSession, sf: str) -> DataFrame:
    items, rows = B.items_and_bank(spark, sf)
    bank = B.bank_of(rows)
    return B.rounded(S.scores_to_rows(S.score_classes(items, bank, "embedding", engine="catalyst"), ["vec_id"], bank.class_ids))


@query(having(B.VEC, B.SCORES, then="SELECT vec_id, class_id, round(score, 9) AS score FROM scores"))
def prompt_scores_blocked(spark: SparkSession, sf: str) -> DataFrame:
    items, rows = B.items_and_bank(spark, sf)
    return B.rounded(S.score_long(items, rows, ["vec_id"], "embedding", block_bytes=4096))


@query(having(B.VEC, B.SCORES, then="SELECT vec_id, true_label, pred_label, true_rank FROM preds"))
def predicted_class_and_rank(spark: SparkSession, sf: str) -> DataFrame:
    df, _bank = B.predicted(spark, sf)
    return df.select("vec_id", "true_label", "pred_label", "true_rank")


@query(having(B.VEC, B.SCORES, then="SELECT vec_id, pred_label, true_rank FROM preds"))
def rank_from_score_rows(spark: SparkSession, sf: str) -> DataFrame:
    df, bank = B.scored(spark, sf)
    rows = S.scores_to_rows(df, ["vec_id"], bank.class_ids)
    truth = df.select("vec_id", "label")
    ranked = S.true_rank(rows, truth, ["vec_id"], "label")
    return S.argmax_class(rows, ["vec_id"]).join(ranked, "vec_id").select("vec_id", "pred_label", "true_rank")


@query(
    having(
        B.VEC, B.SCORES,
        then="SELECT vec_id, string_agg(class_id, ',' ORDER BY place) AS top_classes FROM placed WHERE place <= 5 GROUP BY 1",
    )
)
def top_five_classes(spark: SparkSession, sf: str) -> DataFrame:
    df, bank = B.scored(spark, sf)
    top = S.topk_classes(df, bank.class_ids, 5)
    return top.select("vec_id", F.array_join(F.transform("top_classes", lambda x: x.cast("string")), ",").alias("top_classes"))


CLASS_NAMES = [f"class_{i}" for i in range(10)]


@query(
    having(
        B.VEC, B.SCORES,
        then="SELECT s.vec_id, p.true_label, p.pred_label, "
        + ", ".join(f"round(max(score) FILTER (class_id = {i}), 9) AS class_{i}" for i in range(10))
        + " FROM scores s JOIN preds p USING (vec_id) GROUP BY 1, 2, 3",
    )
)
def wide_prediction_table(spark: SparkSession, sf: str) -> DataFrame:
    df, _bank = B.predicted(spark, sf)
    path = scratch_path(spark, "predictions")
    write_predictions(df, path, CLASS_NAMES, ["vec_id", "true_label", "pred_label"])
    return B.rounded(spark.read.parquet(path))


@query(
    having(
        B.VEC, B.SCORES,
        then="SELECT vec_id, true_label, pred_label, 'class_' || class_id AS label, round(score, 9) AS score FROM scores JOIN preds USING (vec_id)",
    )
)
def score_rows_from_wide(spark: SparkSession, sf: str) -> DataFrame:
    df, _bank = B.predicted(spark, sf)
    base = ["vec_id", "true_label", "pred_label"]
    return B.rounded(S.columns_to_rows(S.scores_to_columns(df, base, CLASS_NAMES), base))


@query(
    having(
        B.VEC,
        then="SELECT i.vec_id, b.class_id, b.template_id, 'class_' || b.class_id AS owner, round(list_cosine_similarity(i.v, b.w), 9) AS score "
        "FROM items i CROSS JOIN bank b",
    )
)
def prompt_owner_lookup(spark: SparkSession, sf: str) -> DataFrame:
    items, rows = B.items_and_bank(spark, sf)
    prompts = rows.select(
        (F.col("class_id") * B.N_PROMPTS + F.col("template_id")).alias("prompt_id"), "template_id", "vector", "class_id"
    )
    each = S.load_bank(prompts.select("prompt_id", "template_id", "vector"), class_col="prompt_id")
    long = S.scores_to_rows(S.score_classes(items, each, "embedding"), ["vec_id"], each.class_ids)
    owners = prompts.select(F.col("prompt_id").alias("class_id"), F.col("class_id").alias("owner_id"), "template_id")
    joined = lookup_join(long, owners, ["class_id"])
    owner = F.concat(F.lit("class_"), "owner_id")
    return B.rounded(
        joined.select("vec_id", F.col("owner_id").alias("class_id"), F.col("template_id").cast("bigint"), owner.alias("owner"), "score")
    )


@query(
    having(
        B.VEC,
        then="SELECT i.vec_id, b.class_id, CAST(arg_max(b.template_id, {'s': list_cosine_similarity(i.v, b.w), 't': -b.template_id}) AS INTEGER) AS place, "
        "'class_' || b.class_id AS owner, round(max(list_cosine_similarity(i.v, b.w)), 9) AS score FROM items i, bank b GROUP BY i.vec_id, b.class_id",
    )
)
def best_prompt_of_class(spark: SparkSession, sf: str) -> DataFrame:
    items, rows = B.items_and_bank(spark, sf)
    bank = S.load_bank(rows)
    ids = F.lit(list(bank.class_ids))
    best = S.best_prompts(items, bank, "embedding").select("vec_id", F.posexplode("best_prompts").alias("_at", "_b"))
    owner = F.get(ids, F.col("_at"))
    return B.rounded(best.select("vec_id", owner.alias("class_id"), F.col("_b.place").alias("place"), F.concat(F.lit("class_"), owner).alias("owner"), F.col("_b.score").alias("score")))


@query(
    having(
        B.VEC, B.SCORES,
        then="SELECT vec_id, round(exp(score) / sum(exp(score)) OVER (PARTITION BY vec_id), 9) AS prob, class_id, round(score, 9) AS logit FROM scores",
    )
)
def class_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    df, bank = B.scored(spark, sf)
    both = df.withColumn("m", V.model_scores(F.col("class_scores")))
    rows = both.select("vec_id", F.posexplode(F.arrays_zip("m.scores", "m.logits")).alias("at", "z"))
    ids = F.lit(list(bank.class_ids))
    return B.rounded(rows.select("vec_id", F.get(ids, F.col("at")).alias("class_id"), F.col("z.scores").alias("prob"), F.col("z.logits").alias("logit")))


@query(
    "SELECT vec_id, round(sqrt(list_dot_product(v, v)), 9) AS norm, round(list_dot_product(v, v) / greatest(sqrt(list_dot_product(v, v)), 1e-12) "
    "/ greatest(sqrt(list_dot_product(v, v)), 1e-12), 9) AS unit_square, round(v[1] / greatest(sqrt(list_dot_product(v, v)), 1e-12), 9) AS first "
    "FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
)
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = V.as_double(F.col("embedding"))
    rows = B.table(spark, sf, "embeddings").select("vec_id", V.norm(v).alias("norm"), V.l2_normalize(v).alias("u"))
    return B.rounded(rows.select("vec_id", "norm", V.dot(F.col("u"), F.col("u")).alias("unit_square"), F.get("u", F.lit(0)).alias("first")))


@query(
    having(
        B.PAIRS,
        then="SELECT vec_id, round(list_dot_product(x, y), 9) AS dot, round(list_cosine_similarity(x, y), 9) AS cosine FROM pairs",
    )
)
def pair_similarity(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return B.rounded(B.pairs(spark, sf).select("vec_id", V.dot(x, y).alias("dot"), V.cosine(x, y).alias("cosine")))


WEIGHTS = "weights AS (SELECT class_id AS out_dim, w FROM bank WHERE template_id = 0)"


def _weights(spark: SparkSession, sf: str) -> tuple[DataFrame, B.Bank]:
    items, rows = B.items_and_bank(spark, sf)
    return items, B.bank_of(rows.filter("template_id = 0"))


@query(
    having(
        B.VEC, WEIGHTS,
        then="SELECT vec_id, out_dim, round(list_dot_product(v, w), 9) AS value FROM items CROSS JOIN weights",
    )
)
def linear_projection(spark: SparkSession, sf: str) -> DataFrame:
    items, bank = _weights(spark, sf)
    out = L.project(items, "embedding", bank.vectors)
    return B.rounded(S.scores_to_rows(out, ["vec_id"], bank.class_ids, "projected").select("vec_id", F.col("class_id").alias("out_dim"), F.col("score").alias("value")))


@query(
    having(
        B.VEC, WEIGHTS,
        then="SELECT vec_id, out_dim, round(list_dot_product(v, w) + out_dim / 10::DOUBLE, 9) AS logit FROM items CROSS JOIN weights",
    )
)
def classifier_head_logits(spark: SparkSession, sf: str) -> DataFrame:
    items, bank = _weights(spark, sf)
    bias = [c / 10 for c in bank.class_ids]
    v = V.as_double(F.col("embedding"))
    out = items.withColumn("logits", V.head_logits(v, V.constant(bank.vectors), V.constant(bias)))
    return B.rounded(S.scores_to_rows(out, ["vec_id"], bank.class_ids, "logits").select("vec_id", F.col("class_id").alias("out_dim"), F.col("score").alias("logit")))


@query(
    having(
        B.VEC,
        then="SELECT class_id, i AS dim, round(avg(w[i + 1]), 9) AS value FROM bank, (SELECT unnest(range(64)) AS i) GROUP BY 1, 2",
    )
)
def mean_pooled_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.bank_rows(spark, sf)  # three vectors per label
    pooled = rows.groupBy("class_id").agg(V.mean_pool(F.collect_list(V.as_double(F.col("vector")))).alias("v"))
    flat = pooled.select("class_id", F.posexplode("v").alias("dim", "value"))
    return B.rounded(flat.select("class_id", F.col("dim").cast("bigint").alias("dim"), "value"))


@query(
    "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 32 ELSE 64 END AS dim, vec_id % 7 <> 0 AS fits FROM embeddings"
)
def vector_dimension_check(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("embedding")
    cut = F.when(F.col("vec_id") % 7 == 0, F.slice(v, 1, 32)).otherwise(v)
    good, bad = S.check_dims(B.table(spark, sf, "embeddings").select("vec_id", cut.alias("v")), "v", 64)
    mark = lambda df, flag: df.select("vec_id", F.size("v").alias("dim"), F.lit(flag).alias("fits"))
    return mark(good, True).unionByName(mark(bad, False))


@query(
    "SELECT vec_id, c AS class_at, round(list_max(v[c * 4 + 1 : c * 4 + 4]), 9) AS best FROM "
    "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), (SELECT unnest(range(16)) AS c)"
)
def flat_scores_to_classes(spark: SparkSession, sf: str) -> DataFrame:
    best = V.pooled_max(V.as_double(F.col("embedding")), 4)
    rows = B.table(spark, sf, "embeddings").select("vec_id", F.posexplode(best).alias("class_at", "best"))
    return B.rounded(rows.select("vec_id", F.col("class_at").cast("bigint").alias("class_at"), "best"))


@query(
    having(
        B.VEC, B.SCORES,
        then="SELECT 'run_1' AS run_id, 'prototype' AS model_id, CAST(vec_id AS VARCHAR) AS image_id, 'class_' || class_id AS label, "
        "round(score, 9) AS score, 'class_' || pred_label AS prediction, 'test' AS split FROM scores JOIN preds USING (vec_id)",
    )
)
def standard_prediction_rows(spark: SparkSession, sf: str) -> DataFrame:
    df, _bank = B.scored(spark, sf)
    return B.rounded(E.prediction_rows(df, "run_1", "prototype", F.col("vec_id"), CLASS_NAMES, "class_scores", F.lit("test")))


# Metrics


@query(
    having(
        B.VEC, B.SCORES,
        then="SELECT count(*) AS n_images, round(avg((pred_label = true_label)::INTEGER), 9) AS top1_accuracy, "
        "round(avg((true_rank <= 5)::INTEGER), 9) AS top5_accuracy FROM preds",
    )
)
def accuracy_summary(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(M.evaluate(B.predicted(spark, sf)[0]))


@query(
    having(
        B.VEC, B.SCORES,
        then="SELECT count(*) AS n_images, round(avg((pred_label = true_label)::INTEGER), 9) AS top1_accuracy, "
        "CAST(printf('%.4f', avg((pred_label = true_label)::INTEGER)) AS DOUBLE) AS top1_accuracy_4 FROM preds",
    )
)
def top1_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(M.accuracy(B.predicted(spark, sf)[0]))


@query(having(B.VEC, B.SCORES, then="SELECT round(avg((true_rank <= 3)::INTEGER), 9) AS top3_accuracy FROM preds"))
def top3_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(M.topk_accuracy(B.predicted(spark, sf)[0], 3))


@query(
    having(
        B.VEC, B.SCORES,
        then="SELECT true_label AS class_id, 'class_' || true_label AS name, count(*) AS n, round(avg((pred_label = true_label)::INTEGER), 9) AS top1_acc, "
        "CAST(printf('%.4f', avg((pred_label = true_label)::INTEGER)) AS DOUBLE) AS top1_acc_4 FROM preds GROUP BY 1",
    )
)
def per_class_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame(list(enumerate(CLASS_NAMES)), "class_id int, name string")
    return B.rounded(M.per_class_accuracy(B.predicted(spark, sf)[0], names))


@query(
    having(
        B.VEC, B.SCORES,
        "c AS (SELECT true_label, count(*) AS n, avg((pred_label = true_label)::INTEGER) AS acc FROM preds GROUP BY 1)",
        then="SELECT count(*) AS n_images, CAST(printf('%.4f', avg((pred_label = true_label)::INTEGER)) AS DOUBLE) AS top1_accuracy, "
        "CAST(printf('%.4f', avg((true_rank <= 5)::INTEGER)) AS DOUBLE) AS top5_accuracy, "
        "(SELECT string_agg('class_' || true_label || '=' || n || '/' || printf('%.4f', acc), ',' ORDER BY true_label) FROM c) AS per_class FROM preds",
    )
)
def metrics_document(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame(list(enumerate(CLASS_NAMES)), "class_id int, name string")
    record = M.metrics_record(B.predicted(spark, sf)[0], names)
    one = lambda e: F.concat(e["key"], F.lit("="), e["value"]["n"].cast("string"), F.lit("/"), fixed(e["value"]["top1_acc"], 4))
    return record.withColumn("per_class", F.array_join(F.transform(F.map_entries("per_class"), one), ","))


@query(
    having(
        B.VEC, B.SCORES,
        "grid AS (SELECT CAST(t.i AS INTEGER) AS true_label, CAST(p.i AS INTEGER) AS pred_label FROM range(10) t(i) CROSS JOIN range(10) p(i))",
        "cells AS (SELECT g.true_label, g.pred_label, count(r.vec_id) AS n FROM grid g LEFT JOIN preds r ON r.true_label = g.true_label AND r.pred_label = g.pred_label GROUP BY 1, 2)",
        then="SELECT true_label, pred_label, n, round(n / greatest(sum(n) OVER (PARTITION BY true_label), 1), 9) AS share FROM cells",
    )
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(M.confusion_matrix(B.predicted(spark, sf)[0], 10))


@query(
    "SELECT event_type, count(*) AS n_images, round(epoch(max(ts)) - epoch(min(ts)), 4) AS elapsed, "
    "round(count(*) / greatest(epoch(max(ts)) - epoch(min(ts)), 1e-6), 9) AS rate FROM events GROUP BY 1"
)
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    out = M.throughput(B.table(spark, sf, "events"), "ts", ["event_type"])
    return B.rounded(out.select("event_type", "n_images", "elapsed", "rate"), 9, elapsed=4)


@query(having(B.BINARY, then="SELECT doc_id, label, round(score, 9) AS score, truth FROM binary_rows"))
def aligned_truth(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(B.binary_rows(spark, sf))


def _prf_sql(t: str) -> str:
    return (
        f"count(*) FILTER (score >= {t} AND truth = 1) AS tp, count(*) FILTER (score >= {t} AND truth = 0) AS fp, "
        f"count(*) FILTER (score < {t} AND truth = 1) AS fn"
    )


PRF_COLS = (
    "tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS \"precision\", round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, "
    "round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1"
)


@query(having(B.BINARY, f"prf AS (SELECT label, {_prf_sql('0.2')} FROM binary_rows GROUP BY 1)", then=f"SELECT label, {PRF_COLS} FROM prf"))
def precision_recall_f1(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(M.prf_by_label(B.binary_rows(spark, sf), 0.2))


@query(
    having(
        B.BINARY,
        f"prf AS (SELECT label, threshold, {_prf_sql('threshold')} FROM binary_rows CROSS JOIN (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) AS t(threshold) GROUP BY 1, 2)",
        then=f"SELECT label, threshold, {PRF_COLS} FROM prf",
    )
)
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(M.threshold_sweep(B.binary_rows(spark, sf), [0.1, 0.5, 0.9]))


@query(
    having(
        B.BINARY, f"prf AS (SELECT label, {_prf_sql('0.2')} FROM binary_rows GROUP BY 1)",
        then="SELECT round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 9) AS macro_f1 FROM prf",
    )
)
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(M.macro_f1(M.prf_by_label(B.binary_rows(spark, sf), 0.2)))


@query(
    having(
        B.BINARY,
        "folded AS (SELECT label, score, sum(truth) AS tp, count(*) AS n FROM binary_rows GROUP BY 1, 2)",
        "walked AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY label) AS pos, sum(n) OVER (PARTITION BY label) AS total "
        "FROM folded WINDOW w AS (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING))",
        then="SELECT label, round(sum(tp / pos * (ctp / cn)), 9) AS average_precision FROM walked WHERE pos > 0 AND pos < total GROUP BY 1",
    )
)
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(M.average_precision(B.binary_rows(spark, sf)))


@query(having(B.BINARY, then="SELECT doc_id, label, CAST(score >= 0.2 AS INTEGER) AS predicted FROM binary_rows"))
def thresholded_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return B.binary_rows(spark, sf).select("doc_id", "label", (F.col("score") >= 0.2).cast("int").alias("predicted"))


@query("SELECT event_id, CAST(user_id % 7 - 1 AS INTEGER) AS label FROM events WHERE user_id % 7 - 1 >= 0")
def labelled_rows_only(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.table(spark, sf, "events").select("event_id", (F.col("user_id") % 7 - 1).cast("int").alias("label"))
    return M.drop_unlabelled(rows, "label")


HISTORY = """history AS (SELECT epoch, phase, avg(loss) AS mean_loss, sum(loss * n) / sum(n) AS weighted_loss, sum(correct) / sum(n) AS accuracy
  FROM log GROUP BY 1, 2)"""


@query(
    having(
        B.LOG, HISTORY,
        then="SELECT epoch, phase, round(mean_loss, 9) AS mean_loss, round(weighted_loss, 9) AS weighted_loss, round(accuracy, 9) AS accuracy FROM history",
    )
)
def training_history(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(M.training_history(B.training_log(spark, sf)))


@query(
    having(
        B.LOG, HISTORY,
        then="SELECT epoch AS best_epoch, round(accuracy, 9) AS best_accuracy FROM history WHERE phase = 'O' ORDER BY accuracy DESC, epoch LIMIT 1",
    )
)
def best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(M.best_epoch(M.training_history(B.training_log(spark, sf)).filter("phase = 'O'")))


@query(
    having(
        B.VEC, B.SCORES,
        "losses AS (SELECT vec_id, ln(sum(exp(10 * score))) - max(CASE WHEN class_id = label THEN 10 * score END) AS loss FROM scores GROUP BY 1)",
        then="SELECT count(*) AS n, round(avg(loss), 9) AS mean_loss, round(avg((pred_label = true_label)::INTEGER), 9) AS accuracy FROM losses JOIN preds USING (vec_id)",
    )
)
def cross_entropy_loss(spark: SparkSession, sf: str) -> DataFrame:
    df, _bank = B.scored(spark, sf)
    logits = df.withColumn("logits", F.transform("class_scores", lambda s: s * 10))
    out = M.cross_entropy(logits, "logits", "label")
    return B.rounded(out.agg(F.count("*").alias("n"), F.avg("loss").alias("mean_loss"), F.avg("correct").alias("accuracy")))


@query(
    having(
        B.PAIRS,
        "b AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) // 8 AS batch_id FROM pairs)",
        "z AS (SELECT p.batch_id, p.vec_id AS i, q.vec_id AS j, 100 * list_cosine_similarity(p.x, q.y) AS z FROM b p JOIN b q ON p.batch_id = q.batch_id)",
        "by_row AS (SELECT batch_id, i, max(z) + ln(sum(exp(z - m))) AS lse FROM (SELECT *, max(z) OVER (PARTITION BY i) AS m FROM z) GROUP BY 1, 2)",
        "by_col AS (SELECT batch_id, j, max(z) + ln(sum(exp(z - m))) AS lse FROM (SELECT *, max(z) OVER (PARTITION BY j) AS m FROM z) GROUP BY 1, 2)",
        "own AS (SELECT batch_id, i, z FROM z WHERE i = j)",
        then="SELECT o.batch_id, CAST(count(*) AS INTEGER) AS n, round(avg(r.lse - o.z + c.lse - o.z) / 2, 6) AS loss FROM own o JOIN by_row r ON r.i = o.i JOIN by_col c ON c.j = o.i GROUP BY 1",
    )
)
def contrastive_loss(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(M.contrastive_loss(B.pairs(spark, sf), "vec_id", "x", "y"), 6)


@query(
    having(
        B.PAIRS,
        "z AS (SELECT p.vec_id AS i, q.vec_id AS j, 100 * list_cosine_similarity(p.x, q.y) AS z FROM pairs p, pairs q)",
        "by_row AS (SELECT i, max(m) + ln(sum(exp(z - m))) AS lse FROM (SELECT *, max(z) OVER (PARTITION BY i) AS m FROM z) GROUP BY 1)",
        "by_col AS (SELECT j, max(m) + ln(sum(exp(z - m))) AS lse FROM (SELECT *, max(z) OVER (PARTITION BY j) AS m FROM z) GROUP BY 1)",
        then="SELECT CAST(0 AS BIGINT) AS batch_id, CAST(count(*) AS INTEGER) AS n, round(avg(r.lse + c.lse - 2 * o.z) / 2, 6) AS loss "
        "FROM z o JOIN by_row r ON r.i = o.i JOIN by_col c ON c.j = o.i WHERE o.i = o.j HAVING count(*) > 0",
    )
)
def contrastive_loss_of_one_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The whole table as one batch, by tiles."""
    return B.rounded(M.contrastive_loss(B.pairs(spark, sf), "vec_id", "x", "y", batch_size=1 << 40), 6)


# Linear map, encoders, heads


@query()
def ridge_linear_map(spark: SparkSession, sf: str) -> DataFrame:
    return L.fit_linear_map(B.pairs(spark, sf), "x", "y", ["vec_id"]).as_rows(spark)


@query()
def ridge_alpha_search(spark: SparkSession, sf: str) -> DataFrame:
    return L.fit_linear_map(B.pairs(spark, sf), "x", "y", ["vec_id"]).search(spark)


@query(
    having(
        B.PAIRS,
        "folds AS (SELECT *, ntile(5) OVER (ORDER BY vec_id) - 1 AS fold FROM pairs)",
        then="SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, (SELECT count(*) FROM pairs) AS n_pairs, TRUE AS solved, TRUE AS error_agrees, TRUE AS solvers_agree FROM folds GROUP BY 1",
    )
)
def ridge_residuals(spark: SparkSession, sf: str) -> DataFrame:
    pairs = B.pairs(spark, sf)
    fitted, other = (L.fit_linear_map(pairs, "x", "y", ["vec_id"], solver=s) for s in ("normal", "qr"))
    told = {f: e for a, f, e in fitted.scores if a == fitted.best_alpha}
    same = other.best_alpha == fitted.best_alpha and abs(fitted.weights - other.weights).max() < 1e-8
    solved = max(L.normal_residual(pairs, "x", "y", m) for m in (fitted, other)) < 1e-9
    keyed = X.kfold_id(pairs, ["vec_id"])
    expected = F.element_at(F.create_map(*[F.lit(v) for pair in told.items() for v in pair]), F.col("fold"))
    return L.heldout_errors(keyed, "x", "y", "fold", fitted.fold_weights).select(
        "fold", "n", F.lit(fitted.n_pairs).cast("bigint").alias("n_pairs"), F.lit(solved).alias("solved"),
        (F.abs(F.col("mse") - expected) <= 1e-9 * expected).alias("error_agrees"), F.lit(bool(same)).alias("solvers_agree"),
    )


@query(
    having(
        B.PAIRS,
        "folds AS (SELECT *, ntile(5) OVER (ORDER BY vec_id) - 1 AS fold FROM pairs)",
        then="SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, round(sum(list_dot_product(y, y)), 6) AS squares, "
        "round(sum(x[1] * x[1]), 6) AS g_first, round(sum(x[32] * y[32]), 6) AS c_last FROM folds GROUP BY 1",
    )
)
def ridge_fold_sums(spark: SparkSession, sf: str) -> DataFrame:
    keyed = X.kfold_id(B.pairs(spark, sf), ["vec_id"])
    sums = L.fold_sums(keyed, "x", "y", "fold")
    at = lambda row, i: F.max(F.when(F.col("row") == row, F.get("v", F.lit(i))))
    return B.rounded(
        sums.groupBy("fold").agg(
            at(-1, 1).cast("bigint").alias("n"), at(-1, 0).alias("squares"), at(0, 0).alias("g_first"), at(31, 63).alias("c_last")
        ),
        6,
    )


@query(
    having(
        B.VEC, B.SCORES,
        then="SELECT vec_id, true_label, pred_label, true_rank FROM preds",
    )
)
def prompt_evaluation_beyond_broadcast(spark: SparkSession, sf: str) -> DataFrame:
    items, rows = B.items_and_bank(spark, sf)
    done = evaluate_prompts(items, rows, ["vec_id"], "embedding", "label", max_bank_bytes=1)
    return done.select("vec_id", "true_label", "pred_label", "true_rank")


FIRST_ONLY = B.SCORES.replace("scores AS", "scores1 AS").replace("CROSS JOIN bank b", "CROSS JOIN (SELECT * FROM bank WHERE template_id = 0) b").replace("FROM scores)", "FROM scores1)").replace("placed AS", "placed1 AS").replace("FROM placed ", "FROM placed1 ").replace("preds AS", "preds1 AS")


@query(
    having(
        B.VEC, B.SCORES, FIRST_ONLY,
        "scored AS (SELECT 'lab/all' AS model_id, * FROM preds UNION ALL SELECT 'lab/first', * FROM preds1)",
        then="SELECT 'run_1' AS run_id, 'label' AS target, model_id, count(*) AS n_images, CAST(printf('%.4f', avg((pred_label = true_label)::INTEGER)) AS DOUBLE) AS top1_accuracy, "
        "CAST(printf('%.4f', avg((true_rank <= 5)::INTEGER)) AS DOUBLE) AS top5_accuracy, count(*) AS n_predictions FROM scored GROUP BY model_id",
    )
)
def evaluated_index(spark: SparkSession, sf: str) -> DataFrame:
    """From an index over shards to the metrics read back from the documents of a run, started twice; and the predictions it left."""
    items, rows = B.items_and_bank(spark, sf)
    shards = B.table(spark, sf, "embeddings").select(F.lit("embeddings").alias("source_shard"), F.col("vec_id").alias("source_row_idx"), F.col("embedding").alias("payload"))
    index = items.select(F.lit("embeddings").alias("source_shard"), F.col("vec_id").alias("source_row_idx"), "label")
    names = spark.createDataFrame(list(enumerate(CLASS_NAMES)), "class_id int, name string")
    banks = {"lab/all": {"label": S.load_bank(rows)}, "lab/first": {"label": S.load_bank(rows.where("template_id = 0"))}}
    root = scratch_path(spark, "evaluated")
    for _ in range(2):  # the second start finds everything there
        told = evaluate_run(spark, root, "run_1", index, shards, lambda df: df.withColumnRenamed("payload", "vector"), banks, {"label": names})
    made = spark.read.parquet(f"{root}/run_1/label/predictions_*.parquet").groupBy(F.regexp_extract("_metadata.file_path", "predictions_([^/]+)\\.parquet", 1).alias("tag")).agg(F.count("*").alias("n_predictions"))
    joined = told.join(made, F.replace("model_id", F.lit("/"), F.lit("__")) == F.col("tag"))
    return joined.select("run_id", "target", "model_id", "n_images", "top1_accuracy", "top5_accuracy", "n_predictions")


@query()
def linear_map_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    halves = B.pairs(spark, sf).join(B.table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    fitted = L.fit_linear_map(halves, "x", "y", ["vec_id"])
    rows = B.bank_rows(spark, sf).withColumn("vector", F.slice("vector", 33, 32))
    return M.evaluate(evaluate_linear_map(halves, fitted.weights, rows, ["vec_id"], "x", "label"))


@query()
def encoded_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = B.table(spark, sf, "documents").select("doc_id", "text")
    encoded = E.batch_encode(docs, "text", lambda: E.hashed_token_encoder(32), 32)
    return encoded.select("doc_id", F.size("vector").alias("dim"), V.total(V.as_double(F.col("vector"))).alias("mass"))


@query()
def fitted_classifier_head(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    model = E.fit_head(rows, "embedding", "label", max_iter=20, reg=0.01)
    out = M.cross_entropy(E.apply_head(rows, "embedding", model), "logits", "label")
    return out.agg(F.count("*").alias("n"), F.avg("loss").alias("mean_loss"), F.avg("correct").alias("accuracy"))
