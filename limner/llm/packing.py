"""Packing of token sequences: Martello-Toth dominance reduction, then best fit.

Piece lengths are at most the capacity, so the whole instance is a table of how many
pieces have each length, whatever the size of the corpus. That table is planned on the
driver: sets that provably dominate every alternative for their largest piece are fixed,
many equal bins at once, and best fit by decreasing length places the remainder. The plan says
which ranks of each length go where; ranks are given by windows over (length, share).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limner.llm.word_tokens import shared_words
from limner.llm.words import text_groups, tidy
from limner.plans.staging import stage

CAPACITY = 4096
END_ID = 1
#: Parts into which the pieces of one length are dealt before they are numbered.
SHARES = 64

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(capacity: int, end_id: int, path: str | None):
    @tidy
    def run(batches):
        words = shared_words(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for first, stop in text_groups(batch):
                rows: list[list] = [[], [], [], [], []]
                texts = [t or "" for t in batch.column("text").slice(first, stop - first).to_pylist()]
                for doc, ids in zip(batch.column("doc_id").slice(first, stop - first).to_pylist(), words.ids_of(texts), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, value in zip(rows, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _PIECES, strict=True)], schema=_PIECES)
        words.forget()

    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every text's ids and a closing ``end_id``, cut at ``capacity``."""
    return docs.select("doc_id", "text").mapInArrow(_cut(capacity, end_id, path), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Places for the pieces of a table ``length -> count``: runs of ranks of one length in runs of bins."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = dict(counts)
        self.used = dict.fromkeys(counts, 0)
        self.sizes = sorted(k for k, n in counts.items() if n)
        self.bins = 0
        self.fixed_bins = 0
        #: (length, first rank, end of ranks, first bin, pieces a bin, offset of the first)
        self.places: list[tuple[int, int, int, int, int, int]] = []
        self._reduce()
        self.fixed_bins = self.bins
        self._best_fit()

    def _take(self, size: int, n: int, first_bin: int, per_bin: int, offset: int) -> None:
        rank = self.used[size]
        self.places.append((size, rank, rank + n, first_bin, per_bin, offset))
        self.used[size] += n
        self.left[size] -= n
        if not self.left[size]:
            self.sizes.pop(bisect_left(self.sizes, size))

    def _largest(self, limit: int, without: list[int]) -> int | None:
        """The largest length up to ``limit`` of which a piece is left besides those of ``without``."""
        at = bisect_left(self.sizes, limit + 1) - 1
        while at >= 0 and self.left[self.sizes[at]] <= without.count(self.sizes[at]):
            at -= 1
        return self.sizes[at] if at >= 0 else None

    def _smallest(self, n: int, without: list[int], above: int = 0) -> list[int]:
        found: list[int] = []
        for size in self.sizes[bisect_left(self.sizes, above + 1) :]:
            found += [size] * min(n - len(found), self.left[size] - without.count(size))
            if len(found) >= n:
                break
        return found

    def _dominating(self, size: int) -> list[int] | None:
        """What to put beside a piece of ``size`` so that no other choice can be better, if that is certain."""
        free = self.capacity - size
        best = self._largest(free, [size])
        if best is None:
            return []
        if best == free:
            return [best]
        small = self._smallest(3, [size])
        if len(small) < 2 or sum(small[:2]) > free:
            return [best]
        if len(small) == 3 and sum(small) <= free:
            return None
        # at most two pieces fit beside it
        second = self._largest(free - best, [size, best])
        pair = self._best_pair(free, size)
        if pair <= best:
            return [best]
        if second is not None:
            over = self._smallest(2, [size], second)
            if len(over) < 2 or sum(over) > free:
                return [best, second]
        return None

    def _best_pair(self, free: int, size: int) -> int:
        """The largest sum of two pieces that does not exceed ``free``."""
        best, low, high = 0, 0, bisect_left(self.sizes, free + 1) - 1
        spare = {k: self.left[k] - (k == size) for k in self.sizes[: high + 1]}
        while low <= high:
            a, b = self.sizes[low], self.sizes[high]
            if not spare[a]:
                low += 1
            elif not spare[b] or a + b > free or (low == high and spare[a] < 2):
                high -= 1
            else:
                best = max(best, a + b)
                low += 1
        return best

    def _reduce(self) -> None:
        """Fix dominating sets, largest pieces first, until a whole pass finds none."""
        changed = True
        while changed:
            changed = False
            for size in sorted(self.sizes, reverse=True):
                while self.left[size]:
                    others = self._dominating(size)
                    if others is None:
                        break
                    members = [size, *others]
                    bins = min(self.left[k] // members.count(k) for k in members)
                    if len(others) == 2 or (others and size + others[0] < self.capacity):
                        bins = 1 if len(set(members)) < len(members) else bins
                    offset = 0
                    for k in members:
                        self._take(k, bins, self.bins, 1, offset)
                        offset += k
                    self.bins += bins
                    changed = True

    def _best_fit(self) -> None:
        spaces: dict[int, list[tuple[int, int]]] = {}
        order: list[int] = []

        def add(space: int, first: int, n: int) -> None:
            if n and space:
                if space not in spaces:
                    spaces[space] = []
                    insort(order, space)
                spaces[space].append((first, n))

        for size in sorted(self.sizes, reverse=True):
            while self.left[size]:
                at = bisect_left(order, size)
                if at < len(order):
                    space = order[at]
                    first, n = spaces[space].pop()
                    if not spaces[space]:
                        del spaces[space]
                        order.pop(at)
                else:
                    space, first, n = self.capacity, self.bins, -(-self.left[size] // (self.capacity // size))
                    self.bins += n
                each = space // size
                whole = min(n, self.left[size] // each)
                offset = self.capacity - space
                if whole:
                    self._take(size, whole * each, first, each, offset)
                    add(space - each * size, first, whole)
                rest = min(self.left[size], each - 1) if whole < n else 0
                if rest:
                    self._take(size, rest, first + whole, rest, offset)
                    add(space - rest * size, first + whole, 1)
                add(space, first + whole + bool(rest), n - whole - bool(rest))


_PLACES = "length long, first_rank long, end_rank long, first_bin long, per_bin long, first_offset long"


def pack(pieces: DataFrame, capacity: int = CAPACITY, shares: int = SHARES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: each sequence holds at most ``capacity`` ids, without gaps.

    ``pieces`` has a positive ``length`` up to ``capacity`` and the columns of ``token_pieces``. What the driver gets is
    one count per length; what is broadcast is one row per (length, share) and the plan, both bounded by the capacity.
    """
    spark = pieces.sparkSession
    pieces = stage(pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares))), "pieces")
    counts = stage(pieces.groupBy("length", "share").count(), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = Plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("number", number).join(F.broadcast(starts), ["length", "share"]).withColumn("rank", F.col("first") + F.col("number") - 1)
    places = spark.createDataFrame(plan.places, _PLACES)
    met = ranked.join(F.broadcast(places.withColumnRenamed("length", "place_length")), F.expr("length = place_length AND rank >= first_rank AND rank < end_rank"))
    step = F.col("rank") - F.col("first_rank")
    return met.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.expr("(rank - first_rank) div per_bin")).alias("sequence_id"),
        (F.col("first_offset") + step % F.col("per_bin") * F.col("length")).alias("offset"),
    )


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Every piece of every row of ``docs(doc_id, text)`` and its place.

    A null or empty text has one piece with the closing id alone. Rows without a ``doc_id`` and rows that repeat
    one are packed like all others. An empty table gives no rows.
    """
    return pack(token_pieces(docs, capacity, end_id, path), capacity)
