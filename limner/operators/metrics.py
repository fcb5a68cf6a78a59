"""Classification metrics, losses and training history."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limner.functions import vectors as V
from limner.functions.numbers import round_exact
from limner.plans.ordering import dense_index, running_totals


def drop_unlabelled(df: DataFrame, label: str) -> DataFrame:
    """Drop rows whose label is the missing marker (below 0) or NULL."""
    return df.filter(F.col(label) >= 0)


def _share(cond: Column) -> Column:
    """Share of rows where ``cond`` holds; a row without a prediction or label is a miss."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def accuracy(df: DataFrame, truth: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Rows and top-1 accuracy, also at 4 decimals."""
    out = df.agg(F.count("*").alias("n_images"), _share(F.col(pred) == F.col(truth)).alias("top1_accuracy"))
    return out.withColumn("top1_accuracy_4", round_exact(F.col("top1_accuracy"), 4))


def topk_accuracy(df: DataFrame, k: int, rank: str = "true_rank", by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose true class ranks within ``k``; a class outside the vocabulary is a miss."""
    hit = F.coalesce(F.col(rank) <= k, F.lit(False))
    return df.groupBy(*by).agg(_share(hit).alias(f"top{k}_accuracy"))


def evaluate(df: DataFrame, by: Sequence[str] = (), k: int = 5) -> DataFrame:
    """Rows, top-1 and top-k accuracy in one pass."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_images"),
        _share(F.col("pred_label") == F.col("true_label")).alias("top1_accuracy"),
        _share(F.coalesce(F.col("true_rank") <= k, F.lit(False))).alias(f"top{k}_accuracy"),
    )


def per_class_accuracy(df: DataFrame, names: DataFrame, truth: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Rows and accuracy of every class that occurs: ``class_id, name, n, top1_acc``."""
    stats = df.groupBy(F.col(truth).alias("class_id")).agg(
        F.count("*").alias("n"), _share(F.col(pred) == F.col(truth)).alias("top1_acc")
    )
    return stats.join(names, "class_id").select("class_id", "name", "n", "top1_acc", round_exact(F.col("top1_acc"), 4).alias("top1_acc_4"))


def metrics_record(df: DataFrame, names: DataFrame, by: Sequence[str] = (), k: int = 5) -> DataFrame:
    """One row per ``by`` with rounded metrics and a ``per_class`` map keyed by class name."""
    by = list(by)
    stats = df.groupBy(*by, F.col("true_label").alias("class_id")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("pred_label") == F.col("true_label")).alias("hits"),
        F.count_if(F.col("true_rank") <= k).alias("hits_k"),
    )
    entry = F.struct("name", F.struct("n", round_exact(F.col("hits") / F.col("n"), 4).alias("top1_acc")))
    named = F.when(F.col("name").isNotNull(), entry)
    total = F.sum("n")
    # At most one row per class and ``by`` value reaches the collected list.
    return stats.join(names, "class_id", "left").groupBy(*by).agg(
        total.alias("n_images"),
        round_exact(F.sum("hits") / total, 4).alias("top1_accuracy"),
        round_exact(F.sum("hits_k") / total, 4).alias(f"top{k}_accuracy"),
        F.map_from_entries(F.array_sort(F.collect_list(named))).alias("per_class"),
    )


def throughput(df: DataFrame, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """Elapsed seconds and rows per second between the first and the last time, with a floor of 1e-6 s."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    out = df.groupBy(*by).agg(
        F.count("*").alias("n_images"), (seconds(F.max(ts)) - seconds(F.min(ts))).alias("elapsed")
    )
    return out.select(
        *by,
        "n_images",
        "elapsed",
        (F.col("n_images") / F.greatest(F.col("elapsed"), F.lit(1e-6))).alias("rate"),
        round_exact(F.col("elapsed"), 1).alias("elapsed_seconds"),
        round_exact(F.col("n_images") / F.greatest(F.col("elapsed"), F.lit(1e-6)), 2).alias("images_per_second"),
    )


def confusion_matrix(df: DataFrame, n_classes: int, truth: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Dense matrix as rows ``true_label, pred_label, n, share``; share is within the true class.

    Labels outside 0..n-1 are ignored and classes without rows stay 0.
    """
    inside = F.col(truth).between(0, n_classes - 1) & F.col(pred).between(0, n_classes - 1)
    counts = df.filter(inside).groupBy(
        F.col(truth).cast("int").alias("true_label"), F.col(pred).cast("int").alias("pred_label")
    ).agg(F.count("*").alias("n"))
    rows = counts.groupBy("true_label").agg(F.sum("n").alias("_row"))
    grid = df.sparkSession.range(n_classes * n_classes).select(
        (F.expr(f"id div {n_classes}")).cast("int").alias("true_label"), (F.col("id") % n_classes).cast("int").alias("pred_label")
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    return (
        grid.join(counts, ["true_label", "pred_label"], "left")
        .join(rows, "true_label", "left")
        .select("true_label", "pred_label", n.alias("n"), (n / F.coalesce(F.col("_row"), F.lit(1))).alias("share"))
    )


def align_truth(scores: DataFrame, truth: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """``keys, label, score, truth`` for the labels that have a truth column; joined by key, not by position.

    The wide rows are joined, one per item, and become one row per label afterwards.
    """
    known = [c for c in labels if c in truth.columns]
    keys = list(keys)
    s = scores.select(*keys, F.array(*[F.col(c).cast("double") for c in known]).alias("_scores"))
    t = truth.select(*keys, F.array(*[F.col(c).cast("int") for c in known]).alias("_truths"))
    names = F.array(*[F.lit(c) for c in known])
    cells = F.inline(F.arrays_zip(names.alias("label"), F.col("_scores").alias("score"), F.col("_truths").alias("truth")))
    return s.join(t, keys).select(*keys, cells).toDF(*keys, "label", "score", "truth")


def prf_by_label(df: DataFrame, threshold: float, by: Sequence[str] = ("label",)) -> DataFrame:
    """Precision, recall and F1 per label at a score threshold; 0 where undefined."""
    hit, true = F.col("score") >= threshold, F.col("truth") == 1
    counts = df.groupBy(*by).agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
    )


def threshold_sweep(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """``prf_by_label`` at several thresholds in one pass over the scores."""
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    swept = df.select("label", "score", "truth", each.alias("threshold"))
    shifted = swept.withColumn("score", (F.col("score") >= F.col("threshold")).cast("double"))
    return prf_by_label(shifted, 1.0, ("label", "threshold"))


def macro_f1(prf: DataFrame) -> DataFrame:
    """Mean F1 over the evaluated labels."""
    return prf.agg(F.avg("f1").alias("macro_f1"))


def average_precision(df: DataFrame) -> DataFrame:
    """Average precision per label over its distinct scores; labels with one class only are left out.

    Rows with equal scores are folded first; the running counts are then built by
    score range, so continuous scores of one label still spread over all tasks.
    """
    folded = df.groupBy("label", "score").agg(
        F.sum((F.col("truth") == 1).cast("bigint")).alias("tp"), F.count("*").alias("n")
    )
    ranked = running_totals(folded, [F.desc("score")], {"ctp": "tp", "cn": "n"}, by=["label"])
    both = (F.col("ctp_all") > 0) & (F.col("ctp_all") < F.col("cn_all"))
    step = F.col("tp") / F.col("ctp_all") * (F.col("ctp") / F.col("cn"))
    return ranked.filter(both).groupBy("label").agg(F.sum(step).alias("average_precision"))


def metric_pivot(df: DataFrame, row: str, col: str, values: Sequence[str], metric: str) -> DataFrame:
    """Largest ``metric`` per row with one column per value of ``col``."""
    return df.groupBy(row).agg(*[F.max(F.when(F.col(col) == v, F.col(metric))).alias(v) for v in values])


def training_history(log: DataFrame) -> DataFrame:
    """Per epoch and phase: mean batch loss, row-weighted loss, accuracy.

    ``log`` has ``epoch, phase, loss, correct, n`` with one row per batch.
    """
    return log.groupBy("epoch", "phase").agg(
        F.avg("loss").alias("mean_loss"),
        F.try_divide(F.sum(F.col("loss") * F.col("n")), F.sum("n")).alias("weighted_loss"),
        F.try_divide(F.sum("correct"), F.sum("n")).alias("accuracy"),
    )


def best_epoch(history: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Epoch with the best metric, the first one on ties."""
    return history.agg(
        F.max_by("epoch", F.struct(F.col(metric), (-F.col("epoch")).alias("_tie"))).alias("best_epoch"),
        F.max(metric).alias(f"best_{metric}"),
    )


def cross_entropy(df: DataFrame, logits: str, label: str) -> DataFrame:
    """Add ``loss`` (natural log) and ``correct`` for a 0-based label."""
    z = F.col(logits)
    return df.withColumns(
        {
            "loss": V.log_sum_exp(z) - F.get(z, F.col(label)),
            "correct": (V.argmax(z) == F.col(label)).cast("int"),
        }
    )


#: Rows of a batch that are multiplied at once; larger batches are cut into tiles of at least so many rows and columns.
TILE = 1_024
#: Tiles along a side of a batch while a tile's side is within ``SIDE_BYTES``: every vector is shuffled so many times, however many there are.
SIDES, SIDE_BYTES = 16, 64 << 20
#: Products of a tile that are in memory at once, and the largest scale whose exponentials need no maximum of their own.
_PRODUCTS, _SAFE_SCALE = 1 << 18, 300.0


def contrastive_loss(pairs: DataFrame, order: str, a: str, b: str, batch_size: int = 8, scale: float = 100.0) -> DataFrame:
    """Symmetric contrastive loss per batch of consecutive pairs: ``batch_id, n, loss``.

    Batches are cut from the row order. Only the key is numbered; the vectors move to their batch. A batch
    of more than ``TILE`` pairs is cut into tiles, and its logarithms of sums are merged from the largest value and the sum of each
    tile, so that no task holds a batch. All products are taken; what is shuffled grows with the rows up to ``SIDES`` tiles of
    ``SIDE_BYTES`` a side, and with their square beyond.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be 1 or more")
    ids = dense_index(pairs.select(order), [order], "_at")
    batches = ids.select(order, F.expr(f"_at div {batch_size}").alias("batch_id"))
    unit = lambda c: V.l2_normalize(V.as_double(F.col(c)))
    if batch_size > TILE:
        place = ids.select(order, F.expr(f"_at div {batch_size}").alias("batch_id"), F.expr(f"_at % {batch_size}").alias("_at"))
        return _tiled_loss(pairs.select(order, unit(a).alias("_a"), unit(b).alias("_b")).join(place, order), batch_size, scale)
    rows = pairs.select(order, unit(a).alias("_a"), unit(b).alias("_b")).join(batches, order)
    # Never more than batch_size rows per batch.
    packed = rows.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col("_a").alias("a"), F.col("_b").alias("b")))).alias("_p")
    )
    side = lambda name: F.flatten(F.transform("_p", lambda p: p[name]))
    return packed.select("batch_id", F.size("_p").alias("n"), _batch_loss(scale)(F.size("_p"), side("a"), side("b")).alias("loss"))


def _tiled_loss(rows: DataFrame, batch_size: int, scale: float) -> DataFrame:
    """``batch_id, n, loss`` of ``batch_id, _at, _a, _b`` by tiles of rows and columns of each batch."""
    found = rows.agg(F.max("_at").alias("last"), F.max(F.size("_a")).alias("dim")).first()
    longest = 0 if found.last is None else found.last + 1
    most = max(TILE, SIDE_BYTES // (8 * (found.dim or 1) + 64))
    length = min(most, max(TILE, -(-longest // SIDES)))
    tiles = max(1, -(-longest // length))
    own = F.expr(f"_at div {length}").cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    left = rows.select("batch_id", "_at", F.col("_a").alias("v"), own.alias("_i"), each.alias("_j"))
    # columns of its own, so that the two sides of one table can be told apart
    right = rows.select((F.col("batch_id") + 0).alias("_batch"), (F.col("_at") + 0).alias("_at"), F.col("_b").alias("v"), own.alias("_j"), each.alias("_i"))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {"batch_id": [], "_at": [], "side": [], "top": [], "total": [], "own": []}
        if a.num_rows and b.num_rows:
            at, x = _sides(a)
            to, y = _sides(b)
            diagonal = np.full(len(at), np.nan)
            meet = np.intersect1d(at, to, return_indices=True)
            diagonal[meet[1]] = scale * np.einsum("ij,ij->i", x[meet[1]], y[meet[2]])
            across, down = _exponentials(scale * x, y, abs(scale))
            for side, place, (top, total), mine in ((0, at, across, diagonal), (1, to, down, np.full(len(to), np.nan))):
                for name, column in zip(out, (np.full(len(place), a["batch_id"][0].as_py()), place, np.full(len(place), side), top, total, mine), strict=True):
                    out[name].append(column)
        columns = [np.concatenate(x) if x else np.zeros(0) for x in out.values()]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, k, from_pandas=True) if k == pa.float64() else pa.array(c.astype(np.int64)).cast(k) for c, k in zip(columns, kinds, strict=True)], names=list(out))

    schema = "batch_id long, _at long, side int, top double, total double, own double"
    parts = left.groupBy("batch_id", "_i", "_j").cogroup(right.groupBy("_batch", "_i", "_j")).applyInArrow(tile, schema)
    # one entry for each tile of a row or column
    merged = parts.groupBy("batch_id", "_at", "side").agg(F.max("top").alias("m"), F.collect_list(F.struct("top", "total")).alias("l"), F.max("own").alias("own"))
    total = F.aggregate("l", F.lit(0.0), lambda s, p: s + p["total"] * F.exp(p["top"] - F.col("m")))
    each_row = merged.select("batch_id", "side", (F.col("m") + F.ln(total)).alias("lse"), "own")
    n = F.count_if(F.col("side") == 0)
    return each_row.groupBy("batch_id").agg(n.cast("int").alias("n"), ((F.sum("lse") - 2 * F.sum("own")) / (2 * n)).alias("loss"))


def _exponentials(x: np.ndarray, y: np.ndarray, bound: float) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """``largest value, sum of exponentials relative to it`` of the rows and of the columns of ``x @ y.T``, some of it at a time.

    No product of unit vectors is beyond ``bound``. A small one stands for the largest value, so that one exponential serves both sides.
    """
    safe = bound <= _SAFE_SCALE
    sides = [(np.full(len(v), bound if safe else -np.inf), np.zeros(len(v))) for v in (x, y)]
    wide = min(len(y), 2_048)
    high = max(1, _PRODUCTS // wide)
    for i in range(0, len(x), high):
        for j in range(0, len(y), wide):
            z = x[i : i + high] @ y[j : j + wide].T
            if safe:
                z -= bound
                np.exp(z, out=z)
                sides[0][1][i : i + high] += z.sum(axis=1)
                sides[1][1][j : j + wide] += z.sum(axis=0)
                continue
            for (top, total), at, values in ((sides[0], slice(i, i + high), z), (sides[1], slice(j, j + wide), z.T)):
                best = np.maximum(top[at], values.max(axis=1))
                total[at] = total[at] * np.exp(top[at] - best) + np.exp(values - best[:, None]).sum(axis=1)
                top[at] = best
    return sides[0], sides[1]


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    at = rows["_at"].to_numpy()
    order = np.argsort(at)
    return at[order], rows["v"].combine_chunks().flatten().to_numpy().reshape(len(at), -1)[order]


def _batch_loss(scale: float):
    """Arrow UDF ``n, flat unit vectors a, b -> loss``: batches of one size are multiplied together."""

    @F.arrow_udf(T.DoubleType())
    def loss(n: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        sizes = n.to_numpy(zero_copy_only=False)
        out = np.zeros(len(sizes))
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            x, y = (side.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size, -1) for side in (a, b))
            z = scale * x @ y.transpose(0, 2, 1)
            own = np.einsum("bii->bi", z)
            total = np.zeros(len(at))
            for axis in (1, 2):
                top = z.max(axis=axis, keepdims=True)
                total += (np.log(np.exp(z - top).sum(axis=axis)) + top.squeeze(axis) - own).sum(axis=1)
            out[at] = total / (2 * size)
        return pa.array(out)

    return loss
