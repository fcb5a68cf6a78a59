"""Exact deduplication with a heavy-hitter split, in built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limner.plans.staging import stage

#: Share of all rows from which on a digest is sure to be found frequent.
SUPPORT = 1 / 2048
_SPACES = " \t\n\x0b\x0c\r"


def without_spaces(text: Column) -> Column:
    """The text without any of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), _SPACES, F.coalesce(text, F.lit("")))


def exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs(doc_id, text)``.

    Rows are equal when their texts agree without white space (SHA-256 of what is left).
    The row with the most code points stays, among those the smallest ``doc_id``; a row
    without an id comes after all others. Rows of one group that agree in id and length
    (also those without any id) are one document and share the verdict.

    A Misra-Gries pass over the digests finds all that hold more than ``support`` of the rows:
    at most ``1 / support`` candidates, so they may be broadcast. Their exact winners and counts are
    computed by partial aggregates and broadcast; their rows are decided where they are.
    The other digests, none of them frequent, are shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.char_length(text).alias("length"), F.sha2(F.encode(without_spaces(F.col("text")), "utf-8"), 256).alias("text_sha256"))
    rows = stage(rows, "digests")
    candidates = rows.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256")).where("text_sha256 IS NOT NULL")
    order = F.struct((-F.col("length")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"))
    total = rows.count()
    winners = rows.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256")
    winners = winners.agg(F.min(order).alias("best"), F.count("*").alias("group_size")).where(F.col("group_size") > total * support)
    winners = stage(winners, "winners")
    frequent = rows.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    others = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    others = others.select("*", F.min(order).over(group).alias("best"), F.count("*").over(group).alias("group_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("best.keep_id")) & (F.col("length") == -F.col("best.less"))
    return frequent.unionByName(others).select("doc_id", F.col("best.keep_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")
