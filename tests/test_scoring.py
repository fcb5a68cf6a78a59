"""Vector functions, scoring engines, metrics and losses against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from limner.functions import vectors as V
from limner.functions.labels import STYLE_NAMES, STYLE_TEMPLATES, vocabulary
from limner.operators import encoding as E
from limner.operators import linear_map as L
from limner.operators import metrics as M
from limner.operators import scoring as S
from limner.operators.indexing import kfold_id
from tests.conftest import rows

RNG = np.random.default_rng(11)
ITEMS = RNG.normal(size=(40, 6))
PROMPTS = RNG.normal(size=(9, 6))
OWNERS = [2, 2, 5, 5, 5, 7, 9, 9, 9]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(ITEMS)], "id int, v array<float>").select(
        "id", F.col("v").cast("array<double>").alias("v")
    )


@pytest.fixture(scope="module")
def bank_rows(spark):
    data = [(c, i, [float(x) for x in v]) for i, (c, v) in enumerate(zip(OWNERS, PROMPTS))]
    return spark.createDataFrame(data, "class_id int, template_id int, vector array<double>")


def _expected(cosine=True):
    x, w = np.asarray(ITEMS, dtype=np.float32).astype(float), PROMPTS
    if cosine:
        x, w = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, w))
    raw = x @ w.T
    return np.stack([raw[:, [i for i, o in enumerate(OWNERS) if o == c]].max(axis=1) for c in (2, 5, 7, 9)], axis=1)


@pytest.mark.parametrize("engine", ["arrow", "catalyst"])
@pytest.mark.parametrize("cosine", [True, False])
def test_engines_agree_with_numpy(items, bank_rows, engine, cosine):
    bank = S.load_bank(bank_rows)
    assert bank.class_ids == [2, 5, 7, 9]
    got = S.score_classes(items, bank, "v", cosine, engine).orderBy("id").collect()
    assert np.allclose([r["class_scores"] for r in got], _expected(cosine), atol=1e-12)


def test_blocked_scores_equal_the_broadcast_ones(monkeypatch, items, bank_rows):
    monkeypatch.setattr(S, "TILE_SCORES", 11)
    assert S.load_bank(bank_rows, max_bytes=10) is None
    long = S.score_long(items, bank_rows, ["id"], "v", block_bytes=100)
    got = {(r["id"], r["class_id"]): r["score"] for r in long.collect()}
    want = _expected()
    assert len(got) == want.size
    for (i, c), score in got.items():
        assert score == pytest.approx(want[i, [2, 5, 7, 9].index(c)], abs=1e-12)


def test_wrong_length_raises_and_null_stays_null(spark, bank_rows):
    bank = S.load_bank(bank_rows)
    df = spark.createDataFrame([(1, None), (2, [1.0] * 6)], "id int, v array<double>")
    got = {r["id"]: r["class_scores"] for r in S.score_classes(df, bank, "v").collect()}
    assert got[1] is None and len(got[2]) == 4
    bad = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    with pytest.raises(Exception, match="item vector has 2 values, the bank has 6"):
        S.score_classes(bad, bank, "v").collect()
    good, misfit = S.check_dims(df.union(bad), "v", 6)
    assert (good.count(), misfit.count()) == (1, 2)


def test_ties_go_to_the_lower_class(spark):
    df = spark.createDataFrame([(1, 7, [0.5, 0.9, 0.9]), (2, 9, [0.9, 0.9, 0.9]), (3, 4, [0.1, 0.2, 0.3])], "id int, label int, class_scores array<double>")
    got = {r["id"]: (r["pred_label"], r["true_rank"]) for r in S.predict(df, [5, 7, 9], "label").collect()}
    assert got == {1: (7, 1), 2: (5, 3), 3: (9, None)}
    top = {r["id"]: r["top_classes"] for r in S.topk_classes(df, [5, 7, 9], 2).collect()}
    assert top == {1: [7, 9], 2: [5, 7], 3: [9, 7]}


def test_more_places_than_classes_is_always_a_hit(spark):
    df = spark.createDataFrame([(3,), (1,)], "true_rank int")
    assert M.topk_accuracy(df, 5).first()[0] == 1.0


def test_softmax_and_losses(spark):
    z = [1000.0, 1001.0, 999.0]
    df = spark.createDataFrame([(z, 1)], "z array<double>, y int")
    p = np.exp(np.array(z) - 1001) / np.exp(np.array(z) - 1001).sum()
    assert np.allclose(df.select(V.softmax(F.col("z"))).first()[0], p)
    row = M.cross_entropy(df, "z", "y").first()
    assert row["loss"] == pytest.approx(-np.log(p[1])) and row["correct"] == 1


def test_normalising_a_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    assert df.select(V.l2_normalize(F.col("v"))).first()[0] == [0.0, 0.0]
    assert df.select(V.cosine(F.col("v"), F.col("v"))).first()[0] == 0.0


def test_slices_and_pooling(spark):
    df = spark.createDataFrame([([1.0, 5.0, 2.0, 4.0, 3.0, 6.0],)], "v array<double>")
    assert df.select(V.class_slices(F.col("v"), 2)).first()[0] == [[1.0, 5.0], [2.0, 4.0], [3.0, 6.0]]
    assert df.select(V.pooled_max(F.col("v"), 3)).first()[0] == [5.0, 6.0]
    seq = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],)], "v array<array<double>>")
    assert seq.select(V.mean_pool(F.col("v"))).first()[0] == [2.0, 4.0]


def test_prompts(spark):
    prompts = S.build_prompts(vocabulary(spark, STYLE_NAMES), STYLE_TEMPLATES, 9).collect()
    assert len(prompts) == 27 * 4
    assert {r["prompt_id"] for r in prompts} == set(range(27 * 4))
    one = S.build_prompts(vocabulary(spark, STYLE_NAMES), STYLE_TEMPLATES, 0).filter("class_id = 12").first()
    assert one["prompt_text"] == "a painting in the style of Impressionism"


def test_confusion_ignores_labels_out_of_range(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (2, 9), (-1, 0)], "true_label int, pred_label int")
    got = {(r["true_label"], r["pred_label"]): (r["n"], r["share"]) for r in M.confusion_matrix(df, 3).collect()}
    assert len(got) == 9
    assert got[0, 1] == (2, pytest.approx(2 / 3)) and got[2, 0] == (0, 0.0)


def _ap(y, s):
    order = sorted(set(s), reverse=True)
    total, ap, last = sum(y), 0.0, 0.0
    for t in order:
        hit = [a for a, b in zip(y, s) if b >= t]
        recall = sum(hit) / total
        ap += (recall - last) * sum(hit) / len(hit)
        last = recall
    return ap


def test_average_precision_with_ties(spark):
    y = [int(v) for v in RNG.integers(0, 2, 120)]
    s = [float(v) for v in RNG.integers(0, 15, 120) / 15]
    data = [("a", v, t) for v, t in zip(s, y)] + [("one", 0.5, 1), ("one", 0.1, 1)]
    df = spark.createDataFrame(data, "label string, score double, truth int").repartition(6)
    got = {r["label"]: r["average_precision"] for r in M.average_precision(df).collect()}
    assert set(got) == {"a"} and got["a"] == pytest.approx(_ap(y, s), abs=1e-12)


def test_precision_recall_without_hits_is_zero(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("b", 0.9, 1), ("b", 0.1, 1)], "label string, score double, truth int")
    got = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in M.prf_by_label(df, 0.5).collect()}
    assert got == {"a": (0.0, 0.0, 0.0), "b": (1.0, 0.5, pytest.approx(2 / 3))}


def test_truth_is_aligned_by_key(spark):
    scores = spark.createDataFrame([(2, 0.2, 0.9), (1, 0.1, 0.8)], "id int, a double, b double")
    truth = spark.createDataFrame([(1, 1), (2, 0)], "id int, a int")
    assert rows(M.align_truth(scores, truth, ["id"], ["a", "b"])) == [(1, "a", 0.1, 1), (2, "a", 0.2, 0)]


@pytest.mark.parametrize("n", [1, 8, 19])
def test_contrastive_loss(spark, n):
    a, b = RNG.normal(size=(n, 5)), RNG.normal(size=(n, 5))
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(n)], "id long, a array<double>, b array<double>")
    got = {r["batch_id"]: r["loss"] for r in M.contrastive_loss(df, "id", "a", "b", 8, 10.0).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    for start in range(0, n, 8):
        z = 10.0 * unit(a[start : start + 8]) @ unit(b[start : start + 8]).T
        lse = lambda m: np.log(np.exp(m).sum(axis=1))
        want = ((lse(z) - np.diag(z)).mean() + (lse(z.T) - np.diag(z)).mean()) / 2
        assert got[start // 8] == pytest.approx(want, abs=1e-10)


def test_first_best_epoch_wins(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.8), (3, 0.8), (4, None)], "epoch int, accuracy double")
    assert tuple(M.best_epoch(df).first()) == (2, 0.8)


def test_throughput_of_one_instant_has_a_floor(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' AS ts FROM range(3)")
    row = M.throughput(df, "ts").first()
    assert row["elapsed"] == 0.0 and row["rate"] == pytest.approx(3e6)


@pytest.mark.parametrize("solver", ["normal", "qr"])
@pytest.mark.parametrize("parts", [1, 6])
def test_ridge_map_matches_a_direct_search(spark, parts, solver):
    x, noise = RNG.normal(size=(53, 4)), RNG.normal(size=(53, 3))
    y = x @ RNG.normal(size=(4, 3)) + 0.5 * noise
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(53)], "id long, x array<double>, y array<double>")
    got = L.fit_linear_map(df.repartition(parts), "x", "y", ["id"], solver=solver)
    assert L.normal_residual(df, "x", "y", got) < 1e-12
    keyed = kfold_id(df, ["id"])
    for r in L.heldout_errors(keyed.repartition(3), "x", "y", "fold", got.fold_weights).collect():
        assert r.mse == pytest.approx(next(e for a, f, e in got.scores if (a, f) == (got.best_alpha, r.fold)), rel=1e-9)
    solve = lambda a, b, alpha: np.linalg.solve(a.T @ a + alpha * np.eye(4), a.T @ b)
    folds = np.array_split(np.arange(53), 5)
    errors = {}
    for alpha in L.ALPHAS:
        per_fold = []
        for f in folds:
            rest = np.setdiff1d(np.arange(53), f)
            per_fold.append(((y[f] - x[f] @ solve(x[rest], y[rest], alpha)) ** 2).mean())
        errors[alpha] = np.mean(per_fold)
    best = min(errors, key=errors.get)
    assert got.best_alpha == best and got.n_pairs == 53
    assert np.allclose(got.weights, solve(x, y, best).T, atol=1e-10)
    for alpha, want in errors.items():
        assert np.mean([m for a, _f, m in got.scores if a == alpha]) == pytest.approx(want, abs=1e-10)
    assert np.allclose(L.load_linear_map(got.as_rows(spark)), got.weights)
    assert got.meta() == {"best_alpha": best, "n_pairs": 53, "image_dim": 4, "text_dim": 3}
    out = L.project(df, "x", got.weights).orderBy("id").collect()
    assert np.allclose([r["projected"] for r in out], x @ got.weights.T)


def test_factors_keep_the_digits_that_squares_lose(spark):
    """Two columns that differ by 1e-9: the squares no longer tell them apart, the factors do."""
    base = RNG.normal(size=(80, 1))
    x = np.hstack([base, base + 1e-9 * RNG.normal(size=(80, 1)), RNG.normal(size=(80, 1))])
    y = x @ np.array([[1e9], [-1e9], [2.0]])
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(80)], "id long, x array<double>, y array<double>").repartition(7)
    tiny = [1e-30]
    got = L.fit_linear_map(df, "x", "y", ["id"], alphas=tiny, solver="qr")
    plain = L.fit_linear_map(df, "x", "y", ["id"], alphas=tiny)
    off = [np.abs(x @ m.weights.T - y).max() / np.abs(y).max() for m in (got, plain)]
    assert off[0] < 1e-6 and off[1] > 10 * off[0]


def test_sums_of_many_partitions_meet_in_levels(spark):
    df = spark.range(900).select("id", F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("x"), F.array((F.col("id") % 5).cast("double")).alias("y"), (F.col("id") % 3).cast("int").alias("f"))
    few, many = (sorted(map(tuple, L.fold_sums(df.repartition(n), "x", "y", "f").collect()), key=lambda r: r[:2]) for n in (2, 150))
    assert few == many and len(few) == 9


def test_linear_map_needs_pairs_and_equal_lengths(spark):
    with pytest.raises(ValueError):
        L.fit_linear_map(spark.createDataFrame([], "id long, x array<double>, y array<double>"), "x", "y", ["id"])
    mixed = spark.createDataFrame([(1, [1.0], [1.0]), (2, [1.0, 2.0], [1.0])], "id long, x array<double>, y array<double>")
    with pytest.raises(ValueError):
        L.fit_linear_map(mixed, "x", "y", ["id"])
    with pytest.raises(ValueError):
        L.load_linear_map(spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "out_dim int, in_dim int, w double"))


def test_batch_encode(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "id int, text string")
    got = {r["id"]: r["vector"] for r in E.batch_encode(df, "text", lambda: E.hashed_token_encoder(8), 8).collect()}
    want = E.hashed_token_encoder(8)(["a b a"])[0]
    assert got[2] is None and got[3] == [0.0] * 8 and np.allclose(got[1], want)


def test_head_separates_separable_classes(spark):
    data = [(i, [float(i % 3 == c) + 0.01 * (i % 7) for c in range(3)], i % 3) for i in range(60)]
    df = spark.createDataFrame(data, "id int, v array<double>, y int")
    model = E.fit_head(df, "v", "y", max_iter=50)
    out = M.cross_entropy(E.apply_head(df, "v", model), "logits", "y").agg(F.avg("correct")).first()[0]
    assert out == 1.0


@pytest.mark.parametrize("block_bytes", [64, 200, 1 << 20])
def test_block_predictions_are_those_of_whole_rows(spark, block_bytes):
    rng = np.random.default_rng(8)
    vectors = np.round(rng.normal(size=(60, 4)), 1)
    # class 3 has more prompts than a block holds; classes 5 and 6 are equal; class 9 has no prompts
    sizes = {0: 1, 1: 2, 2: 1, 3: 14, 5: 1, 6: 1, 7: 3}
    bank = [(c, i, np.round(rng.normal(size=4), 1).tolist()) for c, n in sizes.items() for i in range(n)]
    bank = [(c, i, v if c != 6 else next(x for k, _, x in bank if k == 5)) for c, i, v in bank]
    truth = [[0, 1, 2, 3, 5, 6, 7, 9][i % 8] for i in range(len(vectors))]
    items = spark.createDataFrame([(i, v.tolist(), t) for i, (v, t) in enumerate(zip(vectors, truth, strict=True))] + [(99, None, 3)], "id long, v array<double>, label int")
    rows = spark.createDataFrame(bank, "class_id int, template_id int, vector array<double>")
    got = S.block_predictions(items.repartition(3), rows.repartition(2), ["id"], "v", "label", block_bytes=block_bytes)
    unit = lambda x: x / np.linalg.norm(x)
    want = [(99, 3, None, None)]
    for i, (v, t) in enumerate(zip(vectors, truth, strict=True)):
        best = {c: max(float(unit(v) @ unit(np.array(w))) for k, _, w in bank if k == c) for c in sizes}
        order = sorted(best, key=lambda c: (-round(best[c], 12), c))
        want.append((i, t, order[0], order.index(t) + 1 if t in order else None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_ranks_from_score_rows_need_no_list_of_scores(spark):
    rows = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.5), (2, 0, 0.1), (2, 2, 0.2), (3, 1, 0.3)], "id long, class_id int, score double")
    truth = spark.createDataFrame([(1, 2), (2, 0), (3, 0)], "id long, label int")
    ranked = S.true_rank(rows, truth, ["id"], "label")
    assert sorted((r.id, r.true_rank) for r in ranked.collect()) == [(1, 3), (2, 2), (3, None)]
    assert "collect_list" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_best_prompts_carry_their_place(spark):
    bank = S.Bank([4, 7], [0, 2], np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]))
    items = spark.createDataFrame([(1, [0.0, 2.0]), (2, [3.0, 3.0]), (3, None)], "id long, v array<double>")
    got = {r.id: r.best_prompts and [(round(x.score, 6), x.place) for x in r.best_prompts] for r in S.best_prompts(items, bank, "v").collect()}
    assert got == {1: [(1.0, 1), (0.707107, 0)], 2: [(0.707107, 0), (1.0, 0)], 3: None}


@pytest.mark.parametrize("n", [1, 7, 23])
def test_tiled_losses_are_those_of_whole_batches(spark, monkeypatch, n):
    x, y = RNG.normal(size=(n, 5)), RNG.normal(size=(n, 5))
    df = spark.createDataFrame([(3 * i, x[i].tolist(), y[i].tolist()) for i in range(n)], "id long, x array<double>, y array<double>").repartition(4)
    for size in (9, 50):
        monkeypatch.setattr(M, "TILE", 1024)
        whole = rows(M.contrastive_loss(df, "id", "x", "y", size))
        monkeypatch.setattr(M, "TILE", 4)
        tiled = rows(M.contrastive_loss(df, "id", "x", "y", size))
        assert [r[:2] for r in whole] == [r[:2] for r in tiled] and np.allclose([r[2] for r in whole], [r[2] for r in tiled], atol=1e-9)
    assert M.contrastive_loss(df.limit(0), "id", "x", "y", 50).count() == 0


@pytest.mark.parametrize("scale", [100.0, 5000.0])
def test_tiles_of_a_batch_do_not_grow_in_number(spark, monkeypatch, scale):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)], [float(i % 5), 2.0, float(i % 11)]) for i in range(300)], "id long, x array<double>, y array<double>")
    whole = rows(M.contrastive_loss(df, "id", "x", "y", 300, scale))
    monkeypatch.setattr(M, "TILE", 2)
    monkeypatch.setattr(M, "SIDES", 3)
    monkeypatch.setattr(M, "_PRODUCTS", 50)
    tiles = M.contrastive_loss(df, "id", "x", "y", 300, scale)
    assert "sequence(0, 2," in tiles._jdf.queryExecution().analyzed().toString()  # three, not one for every two rows
    tiled = rows(tiles)
    assert [r[:2] for r in tiled] == [r[:2] for r in whole] and tiled[0][2] == pytest.approx(whole[0][2], rel=1e-12)


def test_built_in_scores_use_all_cores(spark):
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, v array<double>").coalesce(1)
    bank = S.Bank([4, 7], [0, 2], np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]))
    scored = S.score_classes(items, bank, "v", engine="catalyst")
    assert scored.select(F.spark_partition_id()).distinct().count() == 4
    plain = {r.id: r.class_scores for r in S.score_classes(items, bank, "v").collect()}
    assert all(np.allclose(r.class_scores, plain[r.id], atol=1e-12) for r in scored.collect())
