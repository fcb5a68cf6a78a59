"""Scoring jobs end to end: vectors and prompts in, predictions out.

Target, run and model can be columns among ``keys``; all of them are then
evaluated by one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limner.operators.linear_map import project
from limner.operators.metrics import drop_unlabelled
from limner.operators.scoring import BLOCK_BYTES, MAX_BANK_BYTES, block_predictions, load_bank, predict, score_classes


def evaluate_prompts(
    items: DataFrame, bank: DataFrame, keys: Sequence[str], vector: str, truth: str, max_bank_bytes: int = MAX_BANK_BYTES
) -> DataFrame:
    """``keys, true_label, pred_label, true_rank`` of all labelled items.

    A bank that fits ``max_bank_bytes`` is sent to the executors and the scores
    stay in the row; a larger one meets the items block by block (``block_predictions``).
    """
    keys = list(keys)
    labelled = drop_unlabelled(items, truth).select(*keys, F.col(truth).alias("true_label"), vector)
    small = load_bank(bank, max_bytes=max_bank_bytes)
    if small is None:
        return block_predictions(labelled, bank, keys, vector, "true_label", block_bytes=min(BLOCK_BYTES, max(max_bank_bytes, 4096)))
    scored = predict(score_classes(labelled, small, vector), small.class_ids, "true_label")
    return scored.select(*keys, "true_label", "pred_label", "true_rank")


def evaluate_linear_map(
    items: DataFrame, weights: np.ndarray, bank: DataFrame, keys: Sequence[str], vector: str, truth: str
) -> DataFrame:
    """Project the items into the space of the bank, then ``evaluate_prompts``."""
    mapped = project(items, vector, weights, "_mapped")
    return evaluate_prompts(mapped, bank, keys, "_mapped", truth)
