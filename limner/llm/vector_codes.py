"""Codes of vectors: four bytes that name the nearest entry of a codebook for each quarter of the vector.

Components are integers, ``floor(1024 * x)``, and all distances that decide are integers. The codebooks are refined in
rounds. With each quarter of each vector its ``b`` closest entries other than its own are kept, with lower bounds of their
distances in ascending order, and one outer bound below the distances of all the rest. When the entries
move, bounds shrink by the moves. An entry is looked at again only if its bound does not lie safely above
the distance to the own entry; what is looked at gets its distance, and the winner, by integers. Only where the outer bound gives
way are all entries compared. ``b`` follows how far the last round had to look.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limner.plans.joins import lookup_join
from limner.plans.staging import discard, stage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Largest component, so that sums of squares fit into 64 bits.
LARGEST = 1 << 24
#: Squares of components up to this are exact in floating point.
_EXACT = 1 << 21
#: Kept entries at first, and their limits.
CLOSEST, LEAST, MOST = 16, 4, 64
#: Share of the parts that the next number of kept entries has to serve.
SERVED = 0.98
#: Relative slack of a bound against rounding.
_SLACK = 1e-9
_ROWS = 2048


def quantized(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, x`` for rows of ``vectors`` without a missing or non-finite component; ``x`` are integers."""
    x = F.col("embedding")
    number = x.cast("array<double>")
    sound = x.isNotNull() & F.forall(number, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    most = F.lit(LARGEST / SCALE)
    scaled = F.transform(number, lambda v: F.floor(F.greatest(F.least(v, most), -most) * SCALE).cast("int"))
    return vectors.where(sound).select("vec_id", "label", scaled.alias("x"))


@dataclass
class Codebooks:
    """Entries of each part as integers, ``parts x entries x components``, and how far each has come since the last round."""

    entries: np.ndarray
    moves: np.ndarray
    closest: int = CLOSEST

    @classmethod
    def of(cls, entries: np.ndarray) -> Codebooks:
        return cls(entries, np.zeros(entries.shape[:2]))

    def moved(self, entries: np.ndarray, closest: int) -> Codebooks:
        way = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(2)) * (1 + _SLACK)
        return Codebooks(entries, way, closest)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``x`` to rows of ``entries`` (or to one row each), exact integers."""
    difference = x - entries
    return (difference * difference).sum(-1)


def squared_all(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all ``entries``, exact integers."""
    if not x.shape[1]:
        return np.zeros((len(x), len(entries)), np.int64)
    if max(np.abs(x).max(initial=0), np.abs(entries).max()) <= _EXACT and x.shape[1] <= 512:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([squared(x, e) for e in entries], 1)


@dataclass
class Bounds:
    """Of each vector's part: its entry, the kept entries by ascending lower bound, and the outer bound of all others."""

    own: np.ndarray
    kept: np.ndarray
    lower: np.ndarray
    outer: np.ndarray

    @classmethod
    def fresh(cls, x: np.ndarray, entries: np.ndarray, closest: int) -> tuple[Bounds, np.ndarray]:
        """All entries compared. The bounds, and the squared distances to the own entries."""
        n, k = len(x), len(entries)
        b = min(closest, k - 1)
        distances = squared_all(x, entries)
        own = distances.argmin(1)
        best = distances[np.arange(n), own]
        rest = distances.copy()
        rest[np.arange(n), own] = np.iinfo(np.int64).max
        near = np.argpartition(rest, b, 1) if b < k - 1 else np.argsort(rest, 1)
        outer = np.sqrt(rest[np.arange(n), near[:, b]].astype(np.float64)) if b < k - 1 else np.full(n, np.inf)
        near = near[:, :b]
        lower = np.sqrt(np.take_along_axis(rest, near, 1).astype(np.float64))
        order = lower.argsort(1)
        return cls(own, np.take_along_axis(near, order, 1), np.take_along_axis(lower, order, 1) * (1 - _SLACK), outer * (1 - _SLACK)), best

    def after(self, moves: np.ndarray) -> None:
        """Lower bounds once the entries have moved: each by its own way, the outer one by the longest."""
        self.lower = np.maximum(self.lower - moves[self.kept], 0) * (1 - _SLACK)
        order = self.lower.argsort(1)
        self.kept, self.lower = np.take_along_axis(self.kept, order, 1), np.take_along_axis(self.lower, order, 1)
        self.outer = np.maximum(self.outer - moves.max(initial=0), 0) * (1 - _SLACK)

    def resized(self, closest: int) -> None:
        """Keep fewer entries: the outer bound then has to hold for those let go as well. Or have room for more."""
        n, b = self.kept.shape
        if closest < b:
            self.outer = np.minimum(self.outer, self.lower[:, closest:].min(1))
            self.kept, self.lower = self.kept[:, :closest], self.lower[:, :closest]
        elif closest > b:
            self.kept = np.concatenate((self.kept, np.zeros((n, closest - b), np.int64)), 1)
            self.lower = np.concatenate((self.lower, np.full((n, closest - b), np.inf)), 1)

    def settle(self, x: np.ndarray, entries: np.ndarray, closest: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entries after a move: squared distances, and how many kept entries were looked at (one more: all of them)."""
        best = squared(x, entries[self.own])
        reach = np.sqrt(best.astype(np.float64)) * (1 + _SLACK)
        looked = (self.lower <= reach[:, None]).sum(1)
        for j in range(int(looked.max(initial=0))):
            rows = np.flatnonzero(looked > j)
            other = self.kept[rows, j]
            distance = squared(x[rows], entries[other])
            own, now = self.own[rows], best[rows]
            wins = (distance < now) | ((distance == now) & (other < own))
            # the loser takes the winner's place among the kept
            self.own[rows] = np.where(wins, other, own)
            best[rows] = np.where(wins, distance, now)
            self.kept[rows, j] = np.where(wins, own, other)
            self.lower[rows, j] = np.sqrt(np.where(wins, now, distance).astype(np.float64)) * (1 - _SLACK)
        order = self.lower.argsort(1)
        self.kept, self.lower = np.take_along_axis(self.kept, order, 1), np.take_along_axis(self.lower, order, 1)
        self.resized(min(closest, len(entries) - 1))
        far = np.flatnonzero(self.outer <= reach)
        looked[far] = self.kept.shape[1] + 1
        if len(far):
            new, best[far] = Bounds.fresh(x[far], entries, self.kept.shape[1])
            self.own[far], self.kept[far], self.lower[far], self.outer[far] = new.own, new.kept, new.lower, new.outer
        return best, looked

    def packed(self) -> np.ndarray:
        """A row of bytes for each part: own entry, kept entries, bounds rounded down to 32 bits."""
        floor = np.nextafter(np.column_stack((self.lower, self.outer)).astype(np.float32), np.float32(-1))
        codes = np.column_stack((self.own, self.kept)).astype(np.uint8)
        return np.concatenate((codes, np.maximum(floor, 0).astype("<f4").view(np.uint8).reshape(len(codes), -1)), 1)

    @classmethod
    def unpacked(cls, raw: np.ndarray) -> Bounds:
        b = (raw.shape[1] - 5) // 5
        bounds = np.ascontiguousarray(raw[:, b + 1 :]).view("<f4").astype(np.float64)
        return cls(raw[:, 0].astype(np.int64), raw[:, 1 : b + 1].astype(np.int64), bounds[:, :b], bounds[:, b])


_SCHEMA = pa.schema(
    [("vec_id", pa.int64()), ("label", pa.int64()), ("x", pa.list_(pa.int32())), ("state", pa.binary()), ("code", pa.binary()), ("error", pa.int64())]
    + [("part", pa.int32()), ("entry", pa.int32()), ("sums", pa.list_(pa.int64())), ("n", pa.int64()), ("looked", pa.list_(pa.int64()))]
)
_COLUMNS = "vec_id long, label long, x array<int>, state binary, code binary, error long, part int, entry int, sums array<long>, n long, looked array<long>"


def _matrix(x: pa.ListArray, width: int) -> np.ndarray:
    """Rows of one width; shorter ones end in zeros."""
    sizes = np.diff(x.offsets.to_numpy())
    values = x.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _assigned(books: Codebooks):
    """One round over a part of the table: rows with new states, then sums by part and entry and how far it had to look."""
    parts, k, width = books.entries.shape

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, k, width), np.int64)
        counts = np.zeros((parts, k), np.int64)
        depth = np.zeros(MOST + 2, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                x = _matrix(batch.column("x"), parts * width).reshape(-1, parts, width)
                n = len(x)
                states, codes, error = [], np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
                known = batch.column("state")
                for p in range(parts):
                    if known.null_count:
                        bounds, best = Bounds.fresh(x[:, p], books.entries[p], books.closest)
                    else:
                        raw = np.frombuffer(b"".join(known.to_pylist()), np.uint8).reshape(n, parts, -1)[:, p]
                        bounds = Bounds.unpacked(raw)
                        bounds.after(books.moves[p])
                        best, looked = bounds.settle(x[:, p], books.entries[p], books.closest)
                        depth += np.bincount(looked, minlength=len(depth))
                    states.append(bounds.packed())
                    codes[:, p] = bounds.own
                    error += best
                    np.add.at(sums[p], bounds.own, x[:, p])
                    counts[p] += np.bincount(bounds.own, minlength=k)
                state = np.stack(states, 1).reshape(n, -1)
                columns = [batch.column("vec_id"), batch.column("label"), batch.column("x"), pa.array([r.tobytes() for r in state], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(error)]
                columns += [pa.nulls(n, f.type) for f in list(_SCHEMA)[6:]]
                yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)
        used = np.argwhere(counts)
        if len(used):
            rows = [{"part": p, "entry": e, "sums": sums[p, e].tolist(), "n": int(counts[p, e])} for p, e in used.tolist()]
            rows.append({"looked": depth.tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


def _refined(table: DataFrame, books: Codebooks) -> tuple[np.ndarray, int]:
    """Entries as means of their parts, rounded down, and the number of entries to keep; both from sums over the tasks."""
    parts, k, width = books.entries.shape
    entries = books.entries.copy()
    sums = table.where("part IS NOT NULL").groupBy("part", "entry")
    for r in sums.agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"c{i}") for i in range(width)]).collect():
        entries[r.part, r.entry] = [r[f"c{i}"] // r.n for i in range(width)]
    looked = np.zeros(MOST + 2, np.int64)
    for r in table.where("looked IS NOT NULL").select(F.posexplode("looked")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        looked[r.pos] = r.n
    if not looked.sum():
        return entries, books.closest
    depth = int(np.searchsorted(np.cumsum(looked), SERVED * looked.sum())) + 1
    return entries, min(MOST, max(LEAST, depth))


def vector_codes(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, code, error`` for each row of ``vectors`` (``vec_id, embedding, label``) that is whole, and the codebooks.

    Rows whose vector is null or holds a null or non-finite component are left out. The first codebooks are the parts of the
    vectors with the smallest ids (of equal ids, the smaller vector; rows without an id come last); a table of
    fewer vectors has fewer entries. Each round assigns every part to its nearest entry, the lower one of equally near
    ones, and makes each used entry the mean of its parts, rounded down. Vectors of another length than the longest one, or
    of a length that is no multiple of four, count as if zeros followed. Components beyond ``LARGEST`` count as that. Repeated rows are rows like any
    other; an empty table has empty codebooks and no codes. Other columns are ignored.

    The driver sees the entries (at most 256 a part) and their sums, whatever the number of rows.
    """
    kept = stage(quantized(vectors), "vectors")
    ids = kept.select("vec_id").where("vec_id IS NOT NULL").orderBy("vec_id").limit(entries).agg(F.count("*"), F.max("vec_id")).first()
    near = kept.where(F.col("vec_id") <= ids[1]) if ids[0] == entries else kept
    first = near.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    longest = kept.agg(F.max(F.size("x"))).first()[0] or 0
    width = -(-longest // PARTS)
    start = np.zeros((len(first), PARTS * width), np.int64)
    for row, r in zip(start, first, strict=True):
        row[: len(r.x)] = r.x
    books = Codebooks.of(np.ascontiguousarray(start.reshape(len(first), PARTS, width).transpose(1, 0, 2)))
    columns = ("vec_id", "label", "x", "state")
    table = kept.select("vec_id", F.col("label").cast("long").alias("label"), "x", F.lit(None).cast("binary").alias("state"))
    if not first:
        return table.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(0).cast("long").alias("error")), books
    last = kept
    for turn in range(rounds + 1):
        now = stage(table.select(*columns).mapInArrow(_assigned(books), _COLUMNS), f"vector-codes-{turn}")
        discard(last)  # each round reads the table of the one before and no other
        last, table = now, now.where("part IS NULL AND looked IS NULL")
        if turn < rounds:
            books = books.moved(*_refined(now, books))
    return table.select("vec_id", "label", "code", "error"), books


def vector_code_report(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each kept row of ``vectors``."""
    codes, books = vector_codes(vectors)
    keyed = codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.coalesce(F.col("label").cast("string"), F.lit("")).alias("key"))
    sums = keyed.groupBy("key").agg(F.sum("error").alias("label_error"))
    out = lookup_join(keyed, sums, ["key"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
