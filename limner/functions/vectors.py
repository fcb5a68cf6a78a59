"""Vector math on ``ARRAY<DOUBLE>`` columns with built-in higher-order functions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def as_double(v: Column) -> Column:
    """Widen a float vector to double before any arithmetic."""
    return v.cast("array<double>")


def total(v: Column) -> Column:
    """Sum of the elements."""
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, floor: float = NORM_FLOOR) -> Column:
    """Divide by the length, with the length held above ``floor``."""
    length = F.greatest(norm(v), F.lit(floor))
    return F.transform(v, lambda x: x / length)


def cosine(a: Column, b: Column, floor: float = NORM_FLOOR) -> Column:
    """Inner product of the two normalised vectors."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def softmax(z: Column) -> Column:
    """Probabilities from logits, shifted by the maximum so that nothing overflows."""
    top = F.array_max(z)
    mass = F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.transform(z, lambda x: F.exp(x - top) / mass)


def log_sum_exp(z: Column) -> Column:
    """``ln(sum(exp(z)))`` without overflow."""
    top = F.array_max(z)
    return F.ln(F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))) + top


def model_scores(z: Column) -> Column:
    """``struct(scores, logits)``: softmax probabilities beside the raw logits."""
    return F.struct(softmax(z).alias("scores"), z.alias("logits"))


def project(v: Column, weights: Column) -> Column:
    """``W v`` for a matrix given as an array of rows."""
    return F.transform(weights, lambda row: dot(row, v))


def head_logits(v: Column, weights: Column, bias: Column) -> Column:
    """``W v + b``: the logits of a linear classifier."""
    return F.zip_with(project(v, weights), bias, lambda x, b: x + b)


def mean_pool(vectors: Column) -> Column:
    """Element-wise mean of an array of equally long vectors."""
    count = F.size(vectors)
    head = F.transform(F.element_at(vectors, 1), lambda _x: F.lit(0.0))
    sums = F.aggregate(vectors, head, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    return F.transform(sums, lambda x: x / count)


def class_slices(flat: Column, per_class: int) -> Column:
    """Cut a flat score vector into one slice of ``per_class`` values per class."""
    starts = F.sequence(F.lit(0), (F.size(flat) / per_class).cast("int") - 1)
    return F.transform(starts, lambda i: F.slice(flat, i * per_class + 1, per_class))


def pooled_max(flat: Column, per_class: int) -> Column:
    """Best score of each class over its ``per_class`` templates."""
    return F.transform(class_slices(flat, per_class), lambda s: F.array_max(s))


def argmax(scores: Column) -> Column:
    """0-based position of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def rank_of(scores: Column, position: Column) -> Column:
    """1-based rank of the score at a 0-based position; ties go to the lower position."""
    mine = F.get(scores, position)
    ahead = F.filter(scores, lambda s, i: (s > mine) | ((s == mine) & (i < position)))
    return F.when(mine.isNotNull(), F.size(ahead) + 1)


def best_positions(scores: Column, k: int) -> Column:
    """0-based positions of the ``k`` largest scores, best first."""
    keyed = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["i"])


def _plain(x):
    x = x.tolist() if hasattr(x, "tolist") else x
    return [_plain(e) for e in x] if isinstance(x, (list, tuple)) else float(x)


def constant(values: Sequence) -> Column:
    """A constant vector, matrix or stack of matrices as one folded literal."""
    plain = _plain(values)
    depth, inner = 0, plain
    while isinstance(inner, list):
        inner, depth = (inner[0] if inner else 0.0), depth + 1
    return F.from_json(F.lit(json.dumps(plain)), "array<" * depth + "double" + ">" * depth)
