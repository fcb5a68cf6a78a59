"""Exact deduplication by content hash, first occurrence kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limner.plans.joins import join_unique
from limner.plans.ordering import dense_index


def keep_first(df: DataFrame, hash_col: str, order: Sequence[str]) -> DataFrame:
    """One row per hash, the first in ``order``, with the number of ``copies``.

    ``min`` over a struct combines on the map side, so a hash shared by a third
    of all rows costs one row per map task.
    """
    rest = [c for c in df.columns if c not in order and c != hash_col]
    first = F.min(F.struct(*order, *rest)).alias("first")
    grouped = df.groupBy(hash_col).agg(first, F.count("*").alias("copies"))
    return grouped.select(hash_col, *[F.col(f"first.{c}").alias(c) for c in [*order, *rest]], "copies")


def dedupe_exact(df: DataFrame, hash_col: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(unique, duplicates)`` of rows whose payload column is already dropped.

    ``unique`` is numbered 0..n-1 in ``order`` as ``unique_idx``; ``duplicates``
    are all other rows with the ``primary_unique_idx`` they repeat.
    """
    order = list(order)
    unique = dense_index(keep_first(df, hash_col, order), order, "unique_idx")
    return unique.drop("copies"), link_duplicates(df, unique, hash_col, order)


def link_duplicates(df: DataFrame, unique: DataFrame, hash_col: str, order: Sequence[str]) -> DataFrame:
    """Rows that are not the kept one of their hash, with its ``primary_unique_idx``.

    Hashes without a copy are left out of the join. Those with more copies than a shuffle partition's even share, fewer than
    there are partitions, meet their rows by a broadcast; see ``join_unique``.
    """
    order = list(order)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    repeated = unique.filter("copies > 1")
    rows = unique.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = repeated.filter(F.col("copies") * ranges > F.lit(rows)).select(hash_col)
    primary = repeated.select(
        hash_col,
        F.col("unique_idx").alias("primary_unique_idx"),
        F.struct(*order).alias("_kept"),
    )
    linked = join_unique(df, primary, [hash_col], hot=hot)
    return linked.filter(F.struct(*order) != F.col("_kept")).drop("_kept")


def hash_counts(df: DataFrame, hash_col: str, error: str | None = None) -> DataFrame:
    """Rows per hash, and how many of them are valid."""
    valid = F.lit(True) if error is None else F.col(error).isNull()
    return df.groupBy(hash_col).agg(F.count("*").alias("n"), F.count_if(valid).alias("n_valid"))


def dedupe_summary(counts: DataFrame) -> DataFrame:
    """Total, unique, duplicate and quarantined rows with the duplicate rate."""
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count_if(F.col("n_valid") > 0).alias("unique_rows"),
        F.coalesce(F.sum(F.greatest(F.col("n_valid") - 1, F.lit(0))), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.col("n") - F.col("n_valid")), F.lit(0)).alias("quarantined_rows"),
    ).withColumn("duplicate_rate", F.col("duplicate_rows") / F.greatest(F.col("total_rows"), F.lit(1)))


def dup_group_sizes(counts: DataFrame) -> DataFrame:
    """How many hashes occur 2, 3, ... times."""
    return counts.filter("n > 1").groupBy(F.col("n").alias("group_size")).agg(F.count("*").alias("hashes"))


def top_duplicate_hashes(counts: DataFrame, hash_col: str, k: int = 20) -> DataFrame:
    """Of the ``k`` most frequent hashes, those that occur more than once."""
    return counts.orderBy(F.desc("n"), hash_col).limit(k).filter("n > 1").select(hash_col, "n")


def repeated_hashes(counts: DataFrame) -> DataFrame:
    """Number of hashes seen more than once."""
    return counts.agg(F.count_if(F.col("n") > 1).alias("repeated_hashes"))
