"""Language ID, toxicity and the language model: held-out accuracy and brute force."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from limner.llm import byte_cnn as B
from limner.llm import class_lm as L
from limner.llm import toxicity as X
from limner.llm.catalog import remainder


def test_language_of_held_out_texts(docs):
    model = B.fit_language_model(docs, remainder(4) != 2)
    got = {r.doc_id: r for r in B.predict_languages(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.where(remainder(4) == 2).collect()}
    assert np.mean([got[d].lang_pred == lang for d, lang in truth.items()]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == docs.count()


def test_tables_give_the_network(docs):
    model = B.ByteCNN.new(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (5, B.WINDOW)).astype(np.uint8)
    pooled = []
    for w in B.WIDTHS:
        columns = np.concatenate([model.bytes_[x][:, k : B.WINDOW - w + 1 + k] for k in range(w)], axis=2)
        pooled.append(np.maximum((columns @ model.filters[w] + model.shifts[w]).max(axis=1), 0))
    plain = B.softmax(np.concatenate(pooled, axis=1) @ model.out + model.out_shift)
    assert np.allclose(model.probabilities(x, model.tables()), plain, atol=1e-5)


def test_gradients_match_differences():
    model = B.ByteCNN.new(["a", "b", "c"])
    x = np.random.default_rng(2).integers(60, 70, (4, 32)).astype(np.uint8)
    y = np.array([0, 1, 2, 1])

    def loss():
        pooled = []
        for w in B.WIDTHS:
            columns = np.concatenate([model.bytes_[x][:, k : 32 - w + 1 + k] for k in range(w)], axis=2).astype(np.float64)
            pooled.append(np.maximum((columns @ model.filters[w] + model.shifts[w]).max(axis=1), 0))
        return -np.log(B.softmax(np.concatenate(pooled, axis=1) @ model.out + model.out_shift)[np.arange(4), y]).mean()

    for weights, gradient in zip(model._weights(), model._gradients(x, y), strict=True):
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        before = weights[at]
        weights[at] = before + 1e-3
        up = loss()
        weights[at] = before - 1e-3
        down = loss()
        weights[at] = before
        assert abs((up - down) / 2e-3 - gradient[at]) < 2e-2 * max(1e-2, abs(gradient[at]))


def test_language_of_awkward_rows(awkward, nothing):
    model = B.fit_language_model(awkward, F.lit(True))
    got = [tuple(r) for r in B.predict_languages(awkward, model).collect()]
    assert len(got) == awkward.count()
    assert {p for d, p, _ in got if d in (1, 2, 3, 9)} == {"und"}
    assert B.fit_language_model(nothing, F.lit(True)) is None
    assert {r.lang_pred for r in B.predict_languages(awkward, None).collect()} == {"und"}
    clash = awkward.withColumns({"score": F.lit("mine"), "lang_pred": F.lit(3)})
    kept = B.with_language(clash, model, 0.0)
    assert kept.columns == clash.columns and kept.schema == clash.schema
    assert kept.where("doc_id IN (1, 2, 3, 9)").count() == 0 and kept.where("doc_id = 5").count() == 2


def test_toxicity_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = X.fit_toxicity(docs, labels, remainder(5) != 0)
    scored = X.toxicity_scores(docs, model).join(labels, "doc_id").where(remainder(5) == 0).toPandas()
    called = scored.score >= 0.5
    assert (called & (scored.toxic == 1)).sum() >= 0.85 * (scored.toxic == 1).sum()
    assert (called & (scored.toxic == 0)).sum() <= 0.01 * (scored.toxic == 0).sum()


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (7, 0, 0), (None, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    model = X.fit_toxicity(awkward, labels, F.lit(True))
    got = X.toxicity_scores(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert X.fit_toxicity(awkward, labels.where("toxic = 0"), F.lit(True)) is None
    assert X.fit_toxicity(nothing, labels.limit(0), F.lit(True)) is None
    assert X.without_toxic(awkward, None).count() == awkward.count()
    assert X.without_toxic(nothing, model).count() == 0


def test_risk_never_falls_below_zero():
    """Toxic and unlabelled texts that are told apart by one feature alone."""
    toxic, unlabelled = np.zeros(X.BUCKETS), np.zeros(X.BUCKETS)
    toxic[5], unlabelled[5], unlabelled[9] = 20, 8, 72
    chosen = X.chosen_buckets(toxic, unlabelled, 20, 80)
    assert chosen.tolist() == [5]
    value = X.density(np.array([3]), 100)
    x = np.zeros((80, 1), np.float32)
    x[:8] = value
    weights, shift = X.fit(np.full((20, 1), value, np.float32), x, prior=0.1)
    assert weights[0] > 0 and shift < 0


def test_scores_are_those_of_a_plain_sum_over_grams(docs):
    """The scores of texts, gram by gram in plain Python, from the model's table of features and weights."""
    labels = docs.sparkSession.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = X.fit_toxicity(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in X.toxicity_scores(docs, model).collect()}
    letters = {**{c: c - 96 for c in range(97, 123)}, **{c: c - 64 for c in range(65, 91)}, **{c: c for c in range(128, 256)}}
    for row in docs.limit(25).collect():
        raw = [0] * 5 + [letters.get(c, 0) for c in (row.text or "").encode()] + [0] * 5
        hits = Counter()
        for i in range(len(raw) - 5):
            h = sum(raw[i + k] * int(X._TIMES[k]) for k in range(5)) & 0xFFFFFFFF
            h ^= h >> 15
            h = h * 0x2C1B3C6D & 0xFFFFFFFF
            at = int(model.column[h >> (32 - X.BUCKETS.bit_length() + 1)])
            if at >= 0:
                hits[at] += 1
        size = len(raw) - 5
        total = sum(model.weights[at] * min(n * 400 / (size + 200), 3) for at, n in hits.items()) + model.shift
        assert abs(got[row.doc_id] - 1 / (1 + math.exp(-total))) < 1e-6, row.doc_id


def brute(rows, held):
    words = {i: (t or "").encode().lower().split() + [None] for i, (_, t) in enumerate(rows)}
    counts = Counter(w for i in words if not held[i] for w in words[i])
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (
            (rows[i][0], held[i], len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6))
            for i, w in words.items()
        ),
        key=repr,
    )


def scored(df):
    return [tuple(r) for r in L.class_model_scores(df, remainder(7) == 2).collect()]


def test_language_model_counts_match_brute_force(docs, awkward, nothing, monkeypatch):
    monkeypatch.setattr(L, "SWEEPS", 1)
    for df in (docs, awkward):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        held = [zlib.crc32(str(d).encode() if d is not None else b"") % 7 == 2 for d, _ in rows]
        got = scored(df)
        assert sorted(((*r[:5], round(r[5], 6)) for r in got), key=repr) == brute(rows, held)
        assert all(math.isfinite(r[6]) and r[6] <= 0 and r[7] >= 1 for r in got)
    assert scored(nothing) == []


def test_classes_make_held_out_texts_likelier(docs):
    got = [r for r in scored(docs) if r[1]]
    assert sum(r[6] for r in got) > sum(r[5] for r in got)


def test_probabilities_of_a_class_add_up(spark):
    train = spark.createDataFrame([("a a b c",), ("a b d",), ("e",)], "text string")
    words, _ = L.count_words(train)
    unit = np.append(words.unit_of(), L._UNITS)
    classes = np.append(np.arange(L._UNITS) % L.CLASSES, L.CLASSES)
    model = L.build(words, classes, np.ones((L.CLASSES + 1, L.CLASSES + 1), np.int64))
    assert np.allclose((10.0**model.step).sum(axis=1), 1)
    n = len(words.count)
    of_top = classes[unit[np.arange(n)]]
    for k in set(of_top.tolist()):
        seen = (10.0 ** model.of_code[:n][of_top == k]).sum()
        codes = np.flatnonzero(classes[unit[L.WORDS : L.WORDS + L.ENDINGS]] == k)
        unseen = 10.0 ** (model.of_code[L.WORDS + codes[0]] + model.unseen[codes[0]])
        assert math.isclose(seen + unseen, 1, rel_tol=1e-9)


def test_exchange_raises_the_likelihood(docs, monkeypatch):
    seen = []
    likelihood = L.likelihood
    monkeypatch.setattr(L, "likelihood", lambda t: seen.append(likelihood(t)) or seen[-1])
    scored(docs)
    assert max(seen) > seen[0]
