"""Row positions, folds and prefixes in a declared order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limner.plans.joins import if_small
from limner.plans.ordering import dense_index, hash_cuts, hash_histogram, hash_order


TOP_ROWS = 1_000


def cap_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in ``order`` (unique); 0 keeps all.

    A short list is a top-k. For a longer one the key of the last row is looked
    up and the rows are filtered by it, so that no task has to hold ``n`` rows
    of every other task.
    """
    if n <= 0:
        return df
    if n <= TOP_ROWS:
        return df.orderBy(*order).limit(n)
    last = dense_index(df.select(*order), order, "_idx").filter(F.col("_idx") == n - 1).first()
    if last is None:  # fewer than n rows
        return df
    return df.filter(F.struct(*[F.col(c) for c in order]) <= F.struct(*[F.lit(last[c]).alias(c) for c in order]))


def fold_starts(n: int, k: int) -> list[int]:
    """First position of each of ``k`` contiguous folds; the first ``n % k`` are one larger."""
    base, extra = divmod(n, k)
    return [f * base + min(f, extra) for f in range(k)]


def _at_or_after(order: Sequence[str], row) -> Column:
    here = F.struct(*[F.col(c) for c in order])
    return here >= F.struct(*[F.lit(row[c]).alias(c) for c in order])


def kfold_id(df: DataFrame, order: Sequence[str], k: int = 5, name: str = "fold") -> DataFrame:
    """Contiguous fold number 0..k-1 in ``order`` (unique).

    Only the k-1 keys at which a fold begins are looked up; assigning the fold is
    then a comparison, so wide rows are neither sorted nor moved.
    """
    keys = dense_index(df.select(*order), order, "_idx")
    n = keys.count()
    starts = fold_starts(n, k)
    inner = [s for s in starts[1:] if s < n]
    bounds = keys.filter(F.col("_idx").isin(inner)).collect() if inner else []
    at = {r["_idx"]: r for r in bounds}
    fold = F.lit(0)
    for s in starts[1:]:
        if s in at:
            fold = fold + _at_or_after(order, at[s]).cast("int")
    return df.withColumn(name, fold)


def budgeted_prefix(df: DataFrame, shard: str, position: str, budget: int) -> DataFrame:
    """The first ``budget`` rows in (shard, position) order, without sorting the rows.

    ``position`` counts from 0 inside a shard. Every shard that appears holds at
    least one row, so at most ``budget`` shards can matter.
    """
    sizes = df.groupBy(shard).agg(F.count("*").alias("_n")).orderBy(shard).limit(budget)
    before = Window.partitionBy(F.lit(0)).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum("_n").over(before), F.lit(0))
    quota = sizes.select(shard, left.alias("_take")).filter("_take > 0")
    small = if_small(quota)
    quota = quota if small is None else F.broadcast(small)
    return df.join(quota, shard).filter(F.col(position) < F.col("_take")).drop("_take")


def split_sizes(n: int, want_train: int, want_val: int) -> tuple[int, int]:
    """Requested sizes, or 90/10 of what there is when that is less."""
    if n >= want_train + want_val:
        return want_train, want_val
    if n < 2:
        raise ValueError(f"{n} rows cannot be split")
    train = max(1, math.floor(n * 0.9))
    return train, max(1, n - train)


def adaptive_split(df: DataFrame, id_col: str, want_train: int, want_val: int, seed: int) -> DataFrame:
    """Shuffle by hash, take train rows and then validation rows; the rest is dropped."""
    keyed = df.withColumn("_hash", hash_order([id_col], seed))
    hist = hash_histogram(keyed, "_hash")
    n = hist.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    train, val = split_sizes(n, want_train, want_val)
    cuts = df.sparkSession.createDataFrame([("train", train), ("val", train + val)], "cut string, rank bigint")
    found = {r["cut"]: r for r in hash_cuts(keyed, "_hash", id_col, cuts, hist=hist).collect()}  # two rows
    def within(cut: str) -> Column:
        bound = found[cut]
        return (F.col("_hash") < bound["_hash"]) | (
            (F.col("_hash") == bound["_hash"]) & (F.col(id_col) <= F.lit(bound[id_col]))
        )
    out = keyed.withColumn("split", F.when(within("train"), "train").when(within("val"), "val"))
    return out.filter(F.col("split").isNotNull()).drop("_hash")
