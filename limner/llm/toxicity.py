"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear in the density of byte 5-grams. It is trained from texts confirmed to be
toxic and from unlabelled texts: the risk of calling an unlabelled text clean is corrected by the class
prior times the risk of the toxic texts, and never taken below zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limner.llm.words import give_back, text_bytes, text_groups, tidy
from limner.plans.staging import discard, stage

GRAM = 5
BUCKETS = 1 << 18
FEATURES = 1024
#: The classifier is fitted on so many toxic and so many unlabelled texts at most.
TOXIC_TEXTS = 2000
UNLABELLED_TEXTS = 4000
EPOCHS = 300
#: Standard deviations by which a 5-gram must be more frequent in toxic than in unlabelled texts to be a feature.
SURPRISE = 3.0

_VALUE = np.zeros(256, np.uint32)
_VALUE[97:123] = np.arange(1, 27)
_VALUE[65:91] = np.arange(1, 27)
_VALUE[128:] = np.arange(128, 256)
_TIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def gram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of GRAM letters or gaps, and the bounds of each text; texts are apart by gaps."""
    raw, offsets = text_bytes(texts)
    n = len(offsets) - 1
    spread = np.zeros(len(raw) + GRAM * (n + 1), np.uint32)
    lengths = np.diff(offsets)
    spread[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1) * GRAM, lengths)] = _VALUE[raw]
    size = len(spread) - GRAM + 1
    h = spread[:size] * _TIMES[0]
    for k in range(1, GRAM):
        h += spread[k : size + k] * _TIMES[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    bounds = offsets + GRAM * np.arange(n + 1)
    return (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32), np.minimum(bounds, size)


def density(counts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Occurrences per 400 bytes, damped for short texts, 3 at most."""
    return np.minimum(counts * 400 / (size + 200), 3)


@dataclass
class Classifier:
    """``column[bucket]`` is the feature of a bucket, -1 for none."""

    column: np.ndarray
    weights: np.ndarray
    shift: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        buckets, bounds = gram_buckets(texts)
        column = self.column[buckets]
        hits = np.flatnonzero(column >= 0)
        owner = np.searchsorted(bounds, hits, "right") - 1
        n, width = len(texts), len(self.weights)
        inside = (owner >= 0) & (owner < n)
        pairs, counts = np.unique(owner[inside] * width + column[hits[inside]], return_counts=True)
        dense = density(counts, np.diff(bounds)[pairs // width]) if width else counts
        total = np.bincount(pairs // width, weights=self.weights[pairs % width] * dense, minlength=n) if width else np.zeros(n)
        return 1 / (1 + np.exp(-np.clip(total + self.shift, -40, 40)))


def chosen_buckets(toxic: np.ndarray, unlabelled: np.ndarray, n_toxic: int, n_unlabelled: int, features: int = FEATURES) -> np.ndarray:
    """The buckets that tell toxic texts best, ascending, from how many texts of each kind have each bucket."""
    share = [c / max(1, n) for c, n in ((toxic, n_toxic), (unlabelled, n_unlabelled))]
    floor = 1 / (n_unlabelled + 1)
    gain = share[0] * np.log((share[0] + floor) / (share[1] + floor))
    by_chance = n_toxic * share[1]
    gain[toxic - by_chance < SURPRISE * np.sqrt(by_chance + 1)] = 0
    chosen = np.argsort(-gain, kind="stable")[:features]
    return np.sort(chosen[gain[chosen] > 0])


def fit(p: np.ndarray, u: np.ndarray, prior: float, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and shift from the densities of toxic texts and of unlabelled ones, by the non-negative risk

    ``prior * R(toxic, 1) + max(0, R(unlabelled, 0) - prior * R(toxic, 0))`` with the sigmoid loss.
    """
    width = p.shape[1]
    w, b = np.zeros(width, np.float32), np.float32(np.log(prior / (1 - prior)))
    m, s = np.zeros(width + 1, np.float32), np.zeros(width + 1, np.float32)
    for step in range(1, epochs + 1):
        to_p, to_u = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
        slope_p, slope_u = to_p * (1 - to_p) / max(1, len(p)), to_u * (1 - to_u) / max(1, len(u))
        below = to_u.mean() - prior * to_p.mean() if len(u) else 0.0
        if below >= 0:
            on_p, on_u = -2 * prior * slope_p, slope_u
        else:  # the corrected risk went below zero: step back from it
            on_p, on_u = prior * slope_p, -slope_u
        g = np.append(on_p @ p + on_u @ u + 1e-6 * w, on_p.sum() + on_u.sum()).astype(np.float32)
        m += 0.1 * (g - m)
        s += 0.001 * (g * g - s)
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return w.astype(np.float64), float(b)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@tidy
def _sets(batches):
    for batch in batches:
        for start, stop in text_groups(batch):
            buckets, bounds = gram_buckets(batch.column("text").slice(start, stop - start))
            n = stop - start
            sets = [np.unique(buckets[bounds[i] : bounds[i + 1]], return_counts=True) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(start, n), batch.column("kind").slice(start, n), pa.array([b.astype("<i4").tobytes() for b, _ in sets], pa.binary()),
                    pa.array([c.astype("<i4").tobytes() for _, c in sets], pa.binary()), pa.array(np.diff(bounds), pa.int64()),
                ],
                names=["doc_id", "kind", "buckets", "counts", "size"],
            )


def _bucket_counts(batches):
    """How many texts of each kind have each bucket, for a part of the texts."""
    counts = {}
    for batch in batches:
        for kind, own in zip(batch.column("kind").to_pylist(), batch.column("buckets"), strict=True):
            counts.setdefault(kind, np.zeros(BUCKETS, np.int64))[np.frombuffer(own.as_py(), "<i4")] += 1
    for kind, count in counts.items():
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), kind), pa.int32()), pa.array(met, pa.int32()), pa.array(count[met])], names=["kind", "bucket", "n"])


def _densities(column: np.ndarray, width: int):
    """The features of each text, as bytes of 32-bit numbers."""

    @tidy
    def run(batches):
        for batch in batches:
            rows = []
            for own, count, size in zip(batch.column("buckets"), batch.column("counts"), batch.column("size").to_pylist(), strict=True):
                at, n = column[np.frombuffer(own.as_py(), "<i4")], np.frombuffer(count.as_py(), "<i4")
                x = np.zeros(width, "<f4")
                x[at[at >= 0]] = density(n[at >= 0], size)
                rows.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("doc_id"), pa.array(rows, pa.binary())], names=["kind", "doc_id", "x"])

    return run


def _drawn(ids: DataFrame, n: int, total: int, seed: int) -> DataFrame:
    """The ``n`` ids of the smallest hash; those beyond four times their expected range never leave their task."""
    draw = F.xxhash64("doc_id", F.lit(seed))
    reach = -(1 << 63) + min(2**64 - 1, int(2**64 * 4 * n / max(1, total)))
    return ids.where(draw <= F.lit(reach)).orderBy(draw, "doc_id").limit(n)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, toxic_texts: int = TOXIC_TEXTS, unlabelled_texts: int = UNLABELLED_TEXTS, prior: float | None = None) -> Classifier | None:
    """A classifier from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, both where ``learn`` holds.

    A text is confirmed toxic if any of its labels is 1; the unlabelled texts are any texts. Of both, those of the
    smallest hash of the id are taken, up to the given numbers. ``prior`` is the share of toxic texts, by default
    that among the labels. None without any toxic text. The driver sees a count for each bucket and, of each text taken,
    the chosen features: at most ``2 * BUCKETS`` counts and ``FEATURES`` numbers a text, however long the texts are.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & learn)
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not counts.toxic:
        return None
    prior = prior or min(max(counts.toxic / counts.n, 1e-3), 0.5)
    confirmed = _drawn(known.where("toxic = 1").select("doc_id"), toxic_texts, counts.toxic, 0).select("doc_id", F.lit(1).alias("kind"))
    others = _drawn(rows.select("doc_id"), unlabelled_texts, rows.select("doc_id").count(), 1).distinct().select("doc_id", F.lit(0).alias("kind"))
    asked = F.broadcast(confirmed.union(others))
    sets = rows.join(asked, "doc_id").mapInArrow(_sets, "doc_id long, kind int, buckets binary, counts binary, size long")
    one = F.min(F.struct("size", "buckets", "counts")).alias("one")  # of different texts under one id, the shorter
    sets = stage(sets.groupBy("kind", "doc_id").agg(one).select("kind", "doc_id", "one.*"), "toxic-sets")
    sizes = {r.kind: r.n for r in sets.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1):
        return None
    counts = np.zeros((2, BUCKETS))
    met = sets.select("kind", "buckets").mapInArrow(_bucket_counts, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[met["kind"].to_numpy(), met["bucket"].to_numpy()] = met["n"].to_numpy()
    chosen = chosen_buckets(counts[1], counts[0], sizes[1], sizes.get(0, 0))
    column = np.full(BUCKETS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    table = sets.mapInArrow(_densities(column, len(chosen)), "kind int, doc_id long, x binary").orderBy("kind", "doc_id").toArrow()
    discard(sets)
    x = np.frombuffer(b"".join(table["x"].to_pylist()), "<f4").reshape(-1, len(chosen)) if len(chosen) else np.zeros((table.num_rows, 0), np.float32)
    kind = table["kind"].to_numpy()
    toxic, unlabelled = x[kind == 1], x[kind == 0]
    del table, x, met, counts
    weights, shift = fit(toxic, unlabelled, prior)
    del toxic, unlabelled
    give_back()
    return Classifier(column, weights, shift)


def _scores_of(model: Classifier | None, batch: pa.RecordBatch) -> np.ndarray:
    if model is None or not batch.num_rows:
        return np.zeros(batch.num_rows)
    return np.concatenate([model.scores(batch.column("text").slice(a, b - a)) for a, b in text_groups(batch)])


def toxicity_scores(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """``doc_id, score`` for every row and whole text of ``docs(doc_id, text)``; null counts as empty.

    The score is that of a text without any known 5-gram for empty texts, and 0 without a model.
    """

    @tidy
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores_of(model, batch))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Classifier | None, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below ``threshold``; all their columns as they are."""

    @tidy
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores_of(model, batch) < threshold))

    return docs.mapInArrow(run, docs.schema)
