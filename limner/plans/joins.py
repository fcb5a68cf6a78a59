"""Joins that check the size of what they broadcast and do not gather a hot key in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20


def if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame | None:
    """``df`` as a local table when it is proven small, else ``None``.

    Rows of variable width are counted and measured on the executors first; at most ``max_rows + 1`` rows of at most
    ``MAX_BROADCAST_BYTES`` reach the driver.
    """
    rows = df.limit(max_rows + 1)
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType | T.BinaryType | T.ArrayType | T.MapType | T.StructType)]
    if wide:
        size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in wide])))
        found = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
        if found.n > max_rows or found.bytes > MAX_BROADCAST_BYTES:
            return None
    table = rows.toArrow()
    if table.num_rows > max_rows or table.nbytes > MAX_BROADCAST_BYTES:
        return None
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def hot_keys(facts: DataFrame, keys: Sequence[str], ranges: int) -> DataFrame:
    """Keys with more than one in ``ranges`` of all rows; so there are fewer than ``ranges`` of them."""
    counts = facts.groupBy(*keys).agg(F.count("*").alias("_n"))
    return counts.where(F.col("_n") * F.lit(ranges) > F.lit(facts.count())).select(*keys)


def join_unique(facts: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Join of ``facts`` with a table that has one row per key, of any size. ``how`` is inner, left, left_semi or left_anti.

    Keys with more rows than an even share of the shuffle partitions are fewer than the partitions: their rows of ``dim`` are
    broadcast to the rows of ``facts`` where they lie. No other key has more rows than a partition takes, and those are shuffled.
    Rows with a missing key, which match nothing, are not shuffled either. ``hot`` names the keys, if they are known.
    """
    keys = list(keys)
    ranges = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = if_small(hot_keys(facts, keys, ranges) if hot is None else hot, ranges)
    if found is None:
        raise ValueError(f"more than {ranges} keys are called hot")
    lacking = reduce(or_, [F.col(k).isNull() for k in keys])
    found = F.broadcast(found)
    few = F.broadcast(dim.join(found, keys, "left_semi"))
    here = facts.where(~lacking).join(found, keys, "left_semi").unionByName(facts.where(lacking))
    rest = facts.where(~lacking).join(found, keys, "left_anti")
    return here.join(few, keys, how).unionByName(rest.join(dim, keys, how))


def lookup_join(facts: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "inner", max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join to a table unique on ``keys``: broadcast when proven small, else ``join_unique``."""
    small = if_small(dim, max_rows)
    if small is not None:
        return facts.join(F.broadcast(small), list(keys), how)
    return join_unique(facts, dim, keys, how)
