"""Pluggable batch encoders and a classifier head on frozen vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limner.operators.linear_map import head_logits

Encoder = Callable[[Sequence], np.ndarray]


def hashed_token_encoder(dim: int) -> Encoder:
    """Deterministic stand-in for a pretrained encoder: signed token counts in ``dim`` hash buckets."""

    def encode(texts: Sequence) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        seen: dict[str, tuple[int, float]] = {}
        for i, text in enumerate(texts):
            for token in (text or "").lower().split():
                if token not in seen:
                    h = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "big")
                    seen[token] = (h % dim, 1.0 if h >> 63 else -1.0)
                place, sign = seen[token]
                out[i, place] += sign
        return out

    return encode


def batch_encode(df: DataFrame, col: str, make_encoder: Callable[[], Encoder], dim: int, out: str = "vector") -> DataFrame:
    """Add ``out``: the encoding of ``col``. The encoder is built once per Python worker task.

    Only ``col`` travels to Python; NULL stays NULL.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for values in batches:
            result: list[np.ndarray | None] = [None] * len(values)
            present = np.flatnonzero(values.notna())
            if len(present):
                vectors = np.asarray(encoder([values.iloc[i] for i in present]), dtype=np.float32)
                if vectors.shape[1] != dim:
                    raise ValueError(f"the encoder returned {vectors.shape[1]} values, expected {dim}")
                for i, vector in zip(present, vectors):
                    result[i] = vector
            yield pd.Series(result, index=values.index, dtype=object)

    return df.withColumn(out, encode(F.col(col)))


def fit_head(df: DataFrame, vector: str, label: str, max_iter: int = 100, reg: float = 0.0) -> LogisticRegressionModel:
    """Multinomial linear classifier on frozen vectors, trained on the executors."""
    prepared = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    model = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg, standardization=False)
    return model.fit(prepared)


def apply_head(df: DataFrame, vector: str, model: LogisticRegressionModel, out: str = "logits") -> DataFrame:
    """Add the logits of a fitted head."""
    return head_logits(df, vector, model.coefficientMatrix.toArray(), model.interceptVector.toArray(), out)


def prediction_rows(
    df: DataFrame, run_id: str, model_id: str, image_id: Column, names: Sequence[str], scores: str, split: Column
) -> DataFrame:
    """Scores in the standard output schema: one row per item and label with the item's prediction."""
    labels = F.lit(list(names))
    best = F.get(labels, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
    return df.select(
        F.lit(run_id).alias("run_id"),
        F.lit(model_id).alias("model_id"),
        image_id.cast("string").alias("image_id"),
        F.posexplode(F.col(scores).cast("array<double>")).alias("_at", "score"),
        best.alias("prediction"),
        split.alias("split"),
    ).select("run_id", "model_id", "image_id", F.get(labels, F.col("_at")).alias("label"), "score", "prediction", "split")
