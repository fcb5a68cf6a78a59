"""Ridge map between two embedding spaces, fitted from per-fold sums or, for badly conditioned pairs, from per-fold QR factors.

Both are combined like a tree: every task adds up its rows, ``FAN`` groups take the results of the tasks, and one group for each fold
the results of those.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limner.operators.indexing import kfold_id
from limner.operators.scoring import linear_scorer

# Regularisation strengths and number of folds of the search.
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
FOLDS = 5

MAX_SUM_BYTES = 1 << 30
#: Groups of the first level in which the results of tasks meet.
FAN = 64


@dataclass(frozen=True)
class LinearMap:
    """Matrix of shape (out, in) with the search that chose it."""

    weights: np.ndarray
    best_alpha: float
    n_pairs: int
    scores: list[tuple[float, int, float]]  # alpha, fold, held-out mean squared error
    fold_weights: dict[int, np.ndarray]  # the maps fitted without each fold, with the best alpha

    def as_rows(self, spark: SparkSession) -> DataFrame:
        """``out_dim, in_dim, w`` rows."""
        t, d = self.weights.shape
        out, col = np.divmod(np.arange(t * d), d)
        return spark.createDataFrame(pa.table({"out_dim": out, "in_dim": col, "w": self.weights.ravel()}))

    def search(self, spark: SparkSession) -> DataFrame:
        """``alpha, fold, mse`` rows."""
        return spark.createDataFrame(self.scores, "alpha double, fold int, mse double")

    def meta(self) -> dict:
        """What has to be stored beside the matrix."""
        t, d = self.weights.shape
        return {"best_alpha": self.best_alpha, "n_pairs": self.n_pairs, "image_dim": d, "text_dim": t}


def load_linear_map(rows: DataFrame) -> np.ndarray:
    """Matrix from ``out_dim, in_dim, w`` rows; every cell has to be there."""
    size = rows.agg(F.max("out_dim").alias("t"), F.max("in_dim").alias("d"), F.count("*").alias("n")).first()
    if size["n"] == 0 or (size["t"] + 1) * (size["d"] + 1) != size["n"]:
        raise ValueError("the linear map is not a full two-dimensional matrix")
    if size["n"] * 8 > MAX_SUM_BYTES:
        raise ValueError("the linear map is too large to send to the executors")
    table = rows.orderBy("out_dim", "in_dim").toArrow()
    return table["w"].to_numpy().reshape(size["t"] + 1, size["d"] + 1)


def _prepared(pairs: DataFrame, x: str, y: str, fold: str) -> DataFrame:
    return pairs.select(
        F.col(fold).cast("int").alias("f"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")
    ).filter("x IS NOT NULL AND y IS NOT NULL")


def _by_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of each fold in each batch, as two matrices."""
    for batch in batches:
        if not batch.num_rows:
            continue
        folds = batch.column("f").to_numpy()
        xs, ys = (
            batch.column(c).flatten().to_numpy().astype(np.float64, copy=False).reshape(batch.num_rows, -1) for c in ("x", "y")
        )
        for f in np.unique(folds):
            yield int(f), xs[folds == f], ys[folds == f]


def _rows_of(fold: int, rows: Sequence[int], values: Sequence[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "fold": pa.array([fold] * len(values), pa.int32()),
            "row": pa.array(rows, pa.int32()),
            "v": pa.array([np.asarray(v).tolist() for v in values], pa.list_(pa.float64())),
        }
    )


_PARTS = "fold int, row int, v array<double>"


def _matrix(table: pa.Table) -> np.ndarray:
    return table["v"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


def _tree(parts: DataFrame, keys: Sequence[str], merge) -> DataFrame:
    """``merge`` over the results of the tasks by ``keys``, in two levels, so that no group grows with the number of tasks alone."""
    dealt = parts.withColumn("_bucket", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    first = dealt.groupBy("_bucket", *keys).applyInArrow(merge, _PARTS)
    return first.groupBy(*keys).applyInArrow(merge, _PARTS)


def fold_sums(pairs: DataFrame, x: str, y: str, fold: str) -> DataFrame:
    """Per fold the rows of ``X'X | X'Y`` plus, at row -1, ``sum(Y^2)`` and the row count.

    Each partition adds its batches up before anything is shuffled; what is
    shuffled has the size of the matrix, not of the data.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for f, a, b in _by_fold(batches):
            part = [a.T @ np.hstack([a, b]), float((b * b).sum()), len(a)]
            old = sums.get(f)
            sums[f] = part if old is None else [p + q for p, q in zip(old, part)]
        for f, (block, squares, n) in sums.items():
            yield _rows_of(f, [*range(len(block)), -1], [*block, np.array([squares, n])])

    def add(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_rows_of(group["fold"][0].as_py(), [group["row"][0].as_py()], [_matrix(group).sum(axis=0)])])

    return _tree(_prepared(pairs, x, y, fold).mapInArrow(partial, _PARTS), ["fold", "row"], add)


def _factor(block: np.ndarray) -> np.ndarray:
    """The triangular factor of a matrix, with as many rows as columns at most."""
    return np.linalg.qr(block, mode="r")


def fold_factors(pairs: DataFrame, x: str, y: str, fold: str) -> DataFrame:
    """Per fold the triangular factor ``R`` of ``X | Y``: ``fold, row, v``, and at row -1 the row count.

    Factors of tasks are stacked and factored again on the way up. ``R'R`` are the sums of ``fold_sums``, but without
    the loss of half of all digits that squaring costs.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, int]] = {}
        for f, a, b in _by_fold(batches):
            block, n = found.get(f, (np.zeros((0, a.shape[1] + b.shape[1])), 0))
            found[f] = _factor(np.vstack([block, np.hstack([a, b])])), n + len(a)
        for f, (block, n) in found.items():
            yield _rows_of(f, [*range(len(block)), -1], [*block, np.array([float(n)])])

    def stacked(group: pa.Table) -> pa.Table:
        rows = group["row"].to_numpy()
        block = _factor(_matrix(group.filter(pa.array(rows >= 0))))
        n = _matrix(group.filter(pa.array(rows < 0))).sum()
        return pa.Table.from_batches([_rows_of(group["fold"][0].as_py(), [*range(len(block)), -1], [*block, np.array([n])])])

    return _tree(_prepared(pairs, x, y, fold).mapInArrow(partial, _PARTS), ["fold"], stacked)


def heldout_errors(pairs: DataFrame, x: str, y: str, fold: str, weights: dict[int, np.ndarray]) -> DataFrame:
    """``fold, n, mse`` of the pairs of each fold under its own map, from the rows themselves."""

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, a, b in _by_fold(batches):
            miss = a @ weights[f].T - b
            yield pa.RecordBatch.from_pydict({"fold": pa.array([f], pa.int32()), "n": pa.array([len(a)], pa.int64()), "sse": [float((miss * miss).sum())], "width": pa.array([b.shape[1]], pa.int32())})

    parts = _prepared(pairs, x, y, fold).mapInArrow(errors, "fold int, n long, sse double, width int")
    return parts.groupBy("fold").agg(F.sum("n").alias("n"), (F.sum("sse") / (F.sum("n") * F.max("width"))).alias("mse"))


@dataclass
class _Sums:
    """Normal equations of each fold."""

    gram: np.ndarray
    cross: np.ndarray
    square: np.ndarray
    count: np.ndarray

    @classmethod
    def collect(cls, keyed: DataFrame, x: str, y: str, folds: int, d: int, t: int) -> _Sums:
        out = cls(np.zeros((folds, d, d)), np.zeros((folds, d, t)), np.zeros(folds), np.zeros(folds))
        for r in fold_sums(keyed, x, y, "_fold").collect():  # folds * (d + 1) rows
            v = np.asarray(r["v"])
            if r["row"] < 0:
                out.square[r["fold"]], out.count[r["fold"]] = v
            else:
                out.gram[r["fold"], r["row"]], out.cross[r["fold"], r["row"]] = v[:d], v[d:]
        return out

    def solve(self, alpha: float, without: int | None = None) -> np.ndarray:
        used = [f for f in range(len(self.count)) if f != without]
        return np.linalg.solve(self.gram[used].sum(axis=0) + alpha * np.eye(self.gram.shape[1]), self.cross[used].sum(axis=0))

    def error(self, w: np.ndarray, f: int) -> float:
        return self.square[f] - 2 * np.sum(w * self.cross[f]) + np.sum(w * (self.gram[f] @ w))


@dataclass
class _Factors:
    """Triangular factors of each fold."""

    blocks: dict[int, np.ndarray]
    count: np.ndarray
    d: int

    @classmethod
    def collect(cls, keyed: DataFrame, x: str, y: str, folds: int, d: int, t: int) -> _Factors:
        rows: dict[int, dict[int, np.ndarray]] = {}
        count = np.zeros(folds)
        for r in fold_factors(keyed, x, y, "_fold").collect():  # folds * (d + t + 1) rows at most
            if r["row"] < 0:
                count[r["fold"]] = r["v"][0]
            else:
                rows.setdefault(r["fold"], {})[r["row"]] = np.asarray(r["v"])
        return cls({f: np.stack([own[i] for i in sorted(own)]) for f, own in rows.items()}, count, d)

    def solve(self, alpha: float, without: int | None = None) -> np.ndarray:
        width = next(iter(self.blocks.values())).shape[1]
        block = np.vstack([np.zeros((0, width)), *[b for f, b in sorted(self.blocks.items()) if f != without]])
        a = np.vstack([block[:, : self.d], np.sqrt(alpha) * np.eye(self.d)])
        b = np.vstack([block[:, self.d :], np.zeros((self.d, block.shape[1] - self.d))])
        return np.linalg.lstsq(a, b, rcond=None)[0]

    def error(self, w: np.ndarray, f: int) -> float:
        miss = self.blocks[f][:, : self.d] @ w - self.blocks[f][:, self.d :]
        return float((miss * miss).sum())


def fit_linear_map(
    pairs: DataFrame, x: str, y: str, order: Sequence[str], alphas: Sequence[float] = ALPHAS, folds: int = FOLDS,
    solver: str = "normal",
) -> LinearMap:
    """Ridge without intercept from ``x`` to ``y``; alpha chosen by cross-validated mean squared error.

    The rows are read once for the sums, or, with ``solver="qr"``, for triangular factors, which keep all digits where
    the vectors are nearly dependent. The held-out error of every alpha and
    fold follows from them, and only systems of the size of the vectors are
    solved on the driver.
    """
    if solver not in ("normal", "qr"):
        raise ValueError(f"unknown solver {solver!r}")
    # folds are drawn among the pairs that exist
    pairs = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    dims = pairs.agg(
        F.min(F.size(x)).alias("x0"), F.max(F.size(x)).alias("x1"), F.min(F.size(y)).alias("y0"), F.max(F.size(y)).alias("y1")
    ).first()
    if dims["x0"] is None:
        raise ValueError("there are no pairs to fit a linear map to")
    if dims["x0"] != dims["x1"] or dims["y0"] != dims["y1"]:
        raise ValueError("vectors of one side differ in length")
    d, t = dims["x0"], dims["y0"]
    if folds * (d + t) ** 2 * 8 > MAX_SUM_BYTES:
        raise ValueError("vectors are too long for a solve on the driver")

    keyed = kfold_id(pairs, order, folds, "_fold")
    kept = (_Factors if solver == "qr" else _Sums).collect(keyed, x, y, folds, d, t)
    used = [f for f in range(folds) if kept.count[f]]
    scores, means = [], []
    for alpha in alphas:
        errors = [float(kept.error(kept.solve(alpha, f), f) / (kept.count[f] * t)) for f in used]
        scores += [(float(alpha), f, e) for f, e in zip(used, errors, strict=True)]
        means.append(np.mean(errors))
    best = float(alphas[int(np.argmin(means))])
    return LinearMap(kept.solve(best).T, best, int(kept.count.sum()), scores, {f: kept.solve(best, f).T for f in used})


def normal_residual(pairs: DataFrame, x: str, y: str, fitted: LinearMap) -> float:
    """Largest entry of ``(X'X + alpha I) W' - X'Y``, as a share of the largest of ``X'Y``, from the rows themselves."""
    rows = fold_sums(pairs.withColumn("_fold", F.lit(0)), x, y, "_fold").filter("row >= 0").orderBy("row").collect()
    block = np.array([r["v"] for r in rows])
    d = len(block)
    cross = block[:, d:]
    return float(np.abs((block[:, :d] + fitted.best_alpha * np.eye(d)) @ fitted.weights.T - cross).max() / np.abs(cross).max())


def project(df: DataFrame, vector: str, weights: np.ndarray, out: str = "projected") -> DataFrame:
    """Add ``W v``."""
    return df.withColumn(out, linear_scorer(weights)(F.col(vector)))


def head_logits(df: DataFrame, vector: str, weights: np.ndarray, bias: np.ndarray, out: str = "logits") -> DataFrame:
    """Add ``W v + b``."""
    return df.withColumn(out, linear_scorer(weights, bias=bias)(F.col(vector)))
