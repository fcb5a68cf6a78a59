"""Conversations in order: whole where they fit into a task, in pieces where they do not.

A row's place in its conversation is given by ``turn`` (nulls first), then ``role``, then the SHA-256 of its text, so
that it does not depend on the layout of the table. A conversation beyond ``LONG_ROWS`` or ``LONG_CHARS`` is cut into
pieces, ranges of that order; all others come to a task whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limner.plans.joins import lookup_join

LONG_ROWS = 1 << 16
LONG_CHARS = 4 << 20
_ORDER = ("turn", "role", "digest")


def ordered_conversations(rows: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> tuple[DataFrame, DataFrame | None]:
    """Rows with whole conversations one after the other, and those of long conversations in ranges, or None.

    ``rows`` has ``conv_id, turn, role, text`` without a null in ``text``; further columns stay, ``digest`` is added.
    Every partition of both tables is in order; in the second one a conversation spans partitions, in their order,
    and rows that are equal in all four columns may be dealt to several.
    """
    rows = rows.withColumns({"digest": F.sha2("text", 256), "conv": F.coalesce(F.col("conv_id").cast("string"), F.lit(""))})
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    long = sizes.where((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select("conv")
    if long.isEmpty():
        return _whole(rows), None
    short = lookup_join(rows, long, ["conv"], "left_anti")
    salted = lookup_join(rows, long, ["conv"], "left_semi").withColumn("salt", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = salted.repartitionByRange(parts, "conv_id", *_ORDER, "salt").sortWithinPartitions("conv_id", *_ORDER, "salt")
    return _whole(short), ranges.drop("conv", "salt")


def _whole(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv").drop("conv").sortWithinPartitions("conv_id", *_ORDER)


def records(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of record batches, one batch in memory at a time."""
    for batch in batches:
        yield from batch.to_pylist()


def by_conversation(batches: Iterable[pa.RecordBatch], *more: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Each conversation of sorted batches, as a tuple of its id and the columns ``more``, with an iterator over its rows."""
    return groupby(records(batches), key=itemgetter("conv_id", *more) if more else lambda r: (r["conv_id"],))


def record_batches(rows: Iterable[dict], schema: pa.Schema, size: Callable[[dict], int], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``most`` by ``size`` of each, and 1024 rows at most."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= most or len(held) == 1024:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
