"""Jaccard self-join of word shingle sets by vertical partitioning.

The shingles of all texts have one global order (frequent ones last, else by hash).
Texts can only reach the threshold if they share a shingle among the first quarter
of their sets, so only those are brought together. The overlap of a candidate pair
is counted by cutting the order into fragments: each fragment of both sets meets in
its own row, its partial overlap is counted there, and the counts are summed per pair.

Groups of similar texts are not expanded into pairs. Each list of texts that share a
shingle is first compared with its smallest text; then only pairs whose texts are not
yet connected are looked at. A parity bitmap of each set bounds the size of the
symmetric difference from below and drops pairs that cannot reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limner.llm.components import stars
from limner.llm.frequent import most_frequent
from limner.llm.words import give_back, mix, shingle_sets, text_groups, tidy, word_hashes
from limner.plans.staging import stage

WIDTH = 5
PERCENT = 75
FRAGMENTS = 8
#: Counters of frequent shingles each task keeps, and how many shingles the order puts last.
COUNTERS = 1 << 16
#: Bits of the smallest parity bitmaps.
BITS = 512
#: Parts into which the list of a frequent shingle is dealt.
SHARES = 64
BLOCK = 1024
BLOOM_BITS = 1 << 22


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for start, stop in text_groups(batch):
        values, bounds = shingle_sets(*word_hashes(batch.column("text").slice(start, stop - start)), width)
        yield start, stop, values, bounds


def _per_set(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per set, modulo 2**64."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _digests(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = np.diff(bounds).astype(np.uint64)
    return mix(_per_set(mix(values ^ np.uint64(0x5851F42D4C957F2D)), bounds) ^ (n * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def _parity(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set a bitmap: the parity of the number of its elements that fall on each bit.

    It has as many bits as the set has elements, rounded up to a power of two, BITS at least.
    """
    n = np.diff(bounds)
    bits = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    starts = np.concatenate(([0], np.cumsum(bits)))
    place = (mix(values ^ np.uint64(0x2545F4914F6CDD1D)) & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(np.repeat(starts[:-1], n) + place, minlength=starts[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8)).tobytes()
    return [packed[i // 8 : j // 8] for i, j in zip(starts[:-1], starts[1:], strict=True)]


def _folded(parity: bytes, size: int) -> np.ndarray:
    """A bitmap of ``size`` bytes as words: of a longer one, the exclusive or of its parts."""
    words = np.frombuffer(parity, np.uint64)
    return words if len(parity) == size else np.bitwise_xor.reduce(words.reshape(-1, size // 8))


class _Frequent:
    """Misra-Gries counters over batches of values."""

    def __init__(self, size: int):
        self.size, self.values, self.counts = size, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        both = np.concatenate((self.values, values))
        seen = np.concatenate((self.counts, np.ones(len(values), np.int64)))
        order = np.argsort(both, kind="stable")
        both, seen = both[order], seen[order]
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
        values, counts = both[first], np.add.reduceat(seen, first) if len(first) else seen
        if len(values) > self.size:
            counts = counts - np.partition(counts, -self.size - 1)[-self.size - 1]
            values, counts = values[counts > 0], counts[counts > 0]
        self.values, self.counts = values, counts


def _described(width: int, counters: int):
    """Rows of kind 0: digest, size and bitmap of each set; of kind 1: frequent shingles of the task."""

    @tidy
    def run(batches):
        frequent, waiting, held = _Frequent(counters), [], 0
        for batch in batches:
            for start, stop, values, bounds in _sets(batch, width):
                n = stop - start
                yield _batch(
                    kind=pa.array(np.zeros(n, np.int8)), doc_id=batch.column("doc_id").slice(start, n), value=_digests(values, bounds),
                    n=np.diff(bounds), parity=pa.array(_parity(values, bounds), pa.binary()),
                )
                waiting.append(values)
                held += len(values)
                if held > 1 << 20:
                    frequent.add(np.concatenate(waiting))
                    waiting, held = [], 0
        if waiting:
            frequent.add(np.concatenate(waiting))
        keep = frequent.counts > 1
        n = int(keep.sum())
        yield _batch(
            kind=pa.array(np.ones(n, np.int8)), doc_id=pa.nulls(n, pa.int64()), value=frequent.values[keep].view(np.int64),
            n=frequent.counts[keep], parity=pa.nulls(n, pa.binary()),
        )

    return run


def _prefixes(width: int, percent: int, last: np.ndarray):
    """The shingles of each set by which it can meet a similar one."""

    @tidy
    def run(batches):
        for batch in batches:
            for _, _, values, bounds in _sets(batch, width):
                digests, n = _digests(values, bounds), np.diff(bounds)
                _, first = np.unique(digests, return_index=True)
                rare = np.ones(len(values), bool)
                if len(last) and len(values):
                    at = np.minimum(np.searchsorted(last, values), len(last) - 1)
                    rare = last[at] != values
                length = n - (percent * n + 99) // 100 + 1
                taken = []
                for i in first:
                    if n[i]:
                        a, b = bounds[i], bounds[i + 1]
                        own = rare[a:b]
                        some = a + np.flatnonzero(own)[: length[i]]
                        if len(some) < length[i]:
                            some = np.concatenate((some, a + np.flatnonzero(~own)[: length[i] - len(some)]))
                        taken.append(some)
                if not taken:
                    continue
                owner = np.repeat(first[n[first] > 0], [len(x) for x in taken])
                at = np.concatenate(taken)
                share = np.where(rare[at], 0, 1 + (digests[owner].view(np.uint64) % np.uint64(SHARES)).astype(np.int64))
                yield _batch(h=values[at].view(np.int64), share=share, d=digests[owner], n=n[owner])

    return run


@tidy
def _shared_lists(batches):
    """Postings in the order of list, part, size and set: those of lists with several sets, with the list's first set."""
    h0 = share0 = a0 = n0 = d0 = None
    told = True
    for batch in batches:
        h, share, d, n = (batch.column(k).to_numpy() for k in ("h", "share", "d", "n"))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (share[1:] != share[:-1])
        again = np.zeros(len(h), bool)
        again[1:] = ~new[1:] & (d[1:] == d[:-1])
        if len(h) and h0 is not None and h[0] == h0 and share[0] == share0:
            new[0], again[0] = False, d[0] == d0
        group = np.cumsum(new)
        heads = np.flatnonzero(new)
        firsts = np.concatenate(([a0 if a0 is not None else 0], d[heads]))
        sizes = np.concatenate(([n0 if n0 is not None else 0], n[heads]))
        lists = np.concatenate(([h0 if h0 is not None else 0], h[heads]))
        parts = np.concatenate(([share0 if share0 is not None else 0], share[heads]))
        member = ~again & ~new
        named = np.zeros(len(firsts), bool)
        named[group[member]] = True
        named |= parts > 0
        full = named.copy()
        named[0] = named[0] and not told
        at = np.flatnonzero(named)
        yield _batch(
            h=np.concatenate((lists[at], h[member])), d=np.concatenate((firsts[at], d[member])),
            n=np.concatenate((sizes[at], n[member])), a=np.concatenate((firsts[at], firsts[group[member]])),
        )
        if len(h):
            told = bool(full[-1]) or (len(firsts) == 1 and told)
            h0, share0, a0, n0, d0 = lists[-1], parts[-1], firsts[-1], sizes[-1], d[-1]


def _may_reach(percent: int):
    @tidy
    def run(batches):
        for batch in batches:
            n = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            ok = 100 * np.minimum(*n) >= percent * np.maximum(*n)
            left, right = batch.column("parity_a"), batch.column("parity_b")
            for i in np.flatnonzero(ok):
                one, two = left[i].as_py(), right[i].as_py()
                size = min(len(one), len(two))
                diff = int(np.bitwise_count(_folded(one, size) ^ _folded(two, size)).sum())
                ok[i] = diff * (100 + percent) <= int(n[0][i] + n[1][i]) * (100 - percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and bitmaps leave the threshold within reach."""
    for k in ("a", "b"):
        own = nodes.select(F.col("d").alias(k), F.col("n").alias(f"n_{k}"), F.col("parity").alias(f"parity_{k}"))
        pairs = pairs.join(own, k)
    return pairs.mapInArrow(_may_reach(percent), "a long, b long")


def _with_component(nodes: DataFrame, joined: DataFrame, *columns: str) -> DataFrame:
    """``d`` and the component ``c`` of each node, which is the node itself unless it hangs on another in ``joined``."""
    return nodes.join(joined, F.col("d") == F.col("u"), "left").select("d", F.coalesce("v", "d").alias("c"), *columns)


def _cross_pairs(lists: DataFrame, nodes: DataFrame, joined: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs of a list whose texts are not connected and may reach the threshold.

    Lists longer than BLOCK are dealt into blocks, and each pair of blocks is its own task row group.
    """
    owner = _with_component(nodes, joined)
    every_row = Window.partitionBy("h")
    rows = lists.join(owner, "d").withColumns({
        "lo": F.min("c").over(every_row), "hi": F.max("c").over(every_row), "size": F.count("*").over(every_row),
        "one": F.min("a").over(every_row) == F.max("a").over(every_row),
    })
    # two texts that share a list with their first one have been compared with it
    rows = rows.where("lo < hi AND (size > 2 OR NOT one)").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("d"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 3).when(F.col("block") < F.col("other"), 1).otherwise(2)
    rows = rows.select("h", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), side.cast("long").alias("side"), "d", "n", "c")
    rows = rows.join(nodes.select("d", "parity"), "d")
    rows = rows.repartition("h", "low", "high").sortWithinPartitions("h", "low", "high")
    return rows.mapInArrow(_crossing(percent, every), "a long, b long").distinct()


def _segments(width: int, fragments: int, wanted: np.ndarray):
    """The part of each wanted set that lies in each fragment of the order."""

    @tidy
    def run(batches):
        for batch in batches:
            bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
            asked = (wanted[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 > 0
            if not asked.any():
                continue
            batch = batch.filter(pa.array(asked))
            for start, stop, values, bounds in _sets(batch, width):
                place = (values >> np.uint64(64 - fragments.bit_length() + 1)).astype(np.int64)
                digests = _digests(values, bounds)
                own = batch.column("row_no").slice(start, stop - start).to_pylist()
                rows: dict[str, list] = {"row_no": [], "d": [], "n": [], "fragment": [], "part": []}
                for i in range(stop - start):
                    a, b = bounds[i], bounds[i + 1]
                    cuts = a + np.searchsorted(place[a:b], np.arange(fragments + 1))
                    for f in range(fragments):
                        if cuts[f] < cuts[f + 1]:
                            rows["row_no"].append(own[i])
                            rows["d"].append(digests[i])
                            rows["n"].append(b - a)
                            rows["fragment"].append(f)
                            rows["part"].append(values[cuts[f] : cuts[f + 1]].tobytes())
                yield _batch(row_no=pa.array(rows["row_no"], pa.int64()), d=pa.array(rows["d"], pa.int64()), n=pa.array(rows["n"], pa.int64()), fragment=pa.array(rows["fragment"], pa.int32()), part=pa.array(rows["part"], pa.binary()))

    return run


@tidy
def _partial_overlaps(batches):
    for batch in batches:
        left, right = batch.column("part_a"), batch.column("part_b")
        common = np.zeros(batch.num_rows, np.int64)
        for i in range(batch.num_rows):
            both = np.concatenate((np.frombuffer(left[i].as_py(), np.uint64), np.frombuffer(right[i].as_py(), np.uint64)))
            both.sort()
            common[i] = np.count_nonzero(both[1:] == both[:-1])
        yield _batch(**{k: batch.column(k) for k in ("a", "b", "n_a", "n_b")}, common=common)


def _crossing(percent: int, every: bool):
    """Pairs within each (list, block, block) whose texts are not connected yet and may reach the threshold.

    Unless ``every``, the closest such pair of each component only.
    """

    def pairs(rows: list[np.ndarray], parity: list[bytes], seen: set):
        order = np.lexsort((rows[0], rows[1]))
        d, n, c, side = (x[order] for x in rows)
        parity = [parity[i] for i in order]
        sizes = np.array([len(x) for x in parity])
        best: dict[int, tuple] = {}
        for start, stop, end, bits in chunks(n, sizes, parity):
            diff = np.bitwise_count(bits[: stop - start, None] ^ bits[None]).sum(axis=2, dtype=np.int64)
            both = n[start:stop, None] + n[None, start:end]
            ok = diff * (100 + percent) <= both * (100 - percent)
            ok &= 100 * n[start:stop, None] >= percent * n[None, start:end]
            ok &= c[start:stop, None] != c[None, start:end]
            ok &= np.arange(start, stop)[:, None] < np.arange(start, end)[None]
            ok &= (side[start:stop, None] | side[None, start:end]) == 3
            i, j = np.nonzero(ok)
            gap = diff[i, j] / both[i, j]
            for x, y, g in zip((i + start).tolist(), (j + start).tolist(), gap.tolist(), strict=True):
                pair = (int(min(d[x], d[y])), int(max(d[x], d[y])))
                if every:
                    if pair not in seen:
                        seen.add(pair)
                        yield pair
                else:
                    for k in (c[x], c[y]):
                        if k not in best or (g, pair) < best[k]:
                            best[k] = (g, pair)
        for _, pair in best.values():
            if pair not in seen:
                seen.add(pair)
                yield pair

    def chunks(n, sizes, parity):
        """Runs of sets with bitmaps of one size, each with all sets not smaller that are within reach."""
        for size in np.unique(sizes):
            first, last = np.searchsorted(sizes, size), np.searchsorted(sizes, size, "right")
            reach = np.searchsorted(n, n[last - 1] * 100 // percent, "right")
            words = np.stack([_folded(x, size) for x in parity[first:reach]])
            start = first
            while start < last:
                stop = min(last, start + max(1, (1 << 20) // (words.shape[1] * (reach - start))))
                end = np.searchsorted(n, n[stop - 1] * 100 // percent, "right")
                yield start, stop, end, words[start - first : end - first]
                start = stop

    @tidy
    def run(batches):
        key, rest, seen = None, [], set()
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_numpy() for k in ("h", "low", "high")), strict=True))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if keys[a] != key:
                    out += _of(rest, seen)
                    key, rest = keys[a], []
                rest.append(batch.slice(a, b - a))
            if len(seen) > 1 << 18:
                seen.clear()
            if out:
                yield _batch(a=pa.array([p[0] for p in out], pa.int64()), b=pa.array([p[1] for p in out], pa.int64()))
        if out := _of(rest, seen):
            yield _batch(a=pa.array([p[0] for p in out], pa.int64()), b=pa.array([p[1] for p in out], pa.int64()))

    def _of(parts: list[pa.RecordBatch], seen: set) -> list:
        if sum(p.num_rows for p in parts) < 2:
            return []
        table = pa.Table.from_batches(parts).combine_chunks()
        return list(pairs([table.column(k).to_numpy() for k in ("d", "n", "c", "side")], table.column("parity").to_pylist(), seen))

    return run


def _bitmap(ids: DataFrame) -> np.ndarray:
    """BLOOM_BITS bits, set for the bucket of each id; at most 128 rows of 4 KB reach the driver."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BLOOM_BITS))
    rows = ids.select((bucket + 1).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
    bits = np.zeros(BLOOM_BITS // 8, np.uint8)
    for row in rows:
        bits[(row.k - 1) * 4096 : row.k * 4096] |= np.frombuffer(bytes(row.bits), np.uint8)
    return bits


def _met(parts: DataFrame, pairs: DataFrame, *about: str) -> DataFrame:
    """Fragments of both sides of each pair, from one row of each digest, however many rows with its set passed the bitmap.

    ``about`` names columns of ``parts`` that are the same in all rows of a digest; they come for both sides.
    """
    rows = parts.groupBy("d").agg(F.min("row_no").alias("row_no"), *[F.first(c).alias(c) for c in about])
    for side in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("d").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("row_no", *about)]), side)
    left, right = (parts.select(F.col("d").alias(x), F.col("row_no").alias(f"row_no_{x}"), "fragment", F.col("part").alias(f"part_{x}")) for x in ("a", "b"))
    met = pairs.join(right, ["b", "row_no_b"]).join(left, ["a", "row_no_a", "fragment"])
    return met.select("a", "b", "fragment", "part_a", "part_b", *[f"{c}_{x}" for c in about for x in ("a", "b")])


def overlaps(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int = WIDTH, fragments: int = FRAGMENTS) -> DataFrame:
    """``(a, b, common, n_a, n_b)`` for pairs of digests with anything in common: the partial overlaps of all fragments, summed per pair, and the sizes."""
    asked = pairs.select(F.col("a").alias("d")).union(pairs.select("b")).distinct().join(nodes.select("d", "doc_id"), "d")
    source = docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(BLOOM_BITS)).alias("bucket"), F.monotonically_increasing_id().alias("row_no")).where("doc_id IS NOT NULL")
    parts = stage(source.mapInArrow(_segments(width, fragments, _bitmap(asked)), "row_no long, d long, n long, fragment int, part binary"), "segments")
    counted = _met(parts, pairs.select("a", "b"), "n").mapInArrow(_partial_overlaps, "a long, b long, n_a long, n_b long, common long")
    return counted.groupBy("a", "b").agg(F.sum("common").alias("common"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def _links(docs, nodes, pairs, width, percent) -> DataFrame:
    found = overlaps(docs, nodes, pairs, width)
    return found.where(f"100 * common >= {percent} * (n_a + n_b - common)").select(F.col("a").alias("u"), F.col("b").alias("v"))


def shingle_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id``.

    Texts link when ``100 * intersection >= percent * union`` of their sets of ``width``-word
    shingles; the component is the smallest ``doc_id`` reachable by links. Equal sets are one
    node from the start. Null and empty texts have no shingle and stay alone. Rows without
    a ``doc_id`` link with nothing and have no component; rows that repeat a ``doc_id`` are kept,
    each with its own set. Sets count as equal when their size and 64-bit digest agree.
    """
    docs = docs.select("doc_id", "text")
    seen = docs.mapInArrow(_described(width, counters), "kind byte, doc_id long, value long, n long, parity binary")
    seen = stage(seen, "sets")
    own = seen.where("kind = 0").select("doc_id", F.col("value").alias("d"), "n", "parity")
    counted = stage(seen.where("kind = 1").groupBy("value").agg(F.sum("n").alias("n")), "frequent")
    last = np.sort(np.array([r.value for r in most_frequent(counted, counters)], np.int64).view(np.uint64))
    give_back()

    members = own.where("n > 0 AND doc_id IS NOT NULL")
    nodes = stage(members.groupBy("d").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("parity").alias("parity")), "nodes")
    postings = docs.where("doc_id IS NOT NULL").mapInArrow(_prefixes(width, percent, last), "h long, share long, d long, n long")
    postings = postings.repartition("h", "share").sortWithinPartitions("h", "share", "n", "d")
    lists = stage(postings.mapInArrow(_shared_lists, "h long, d long, n long, a long"), "lists")

    star = lists.where("a != d").select("a", F.col("d").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tested = stage(_possible(star, nodes, percent), "pairs")
    joined = stars(stage(_links(docs, nodes, tested, width, percent), "linked"))
    for every in (False, True):
        crossing = _cross_pairs(lists, nodes, joined, percent, every).join(tested.select("a", "b"), ["a", "b"], "left_anti")
        crossing = stage(crossing, "pairs")
        if not crossing.isEmpty():
            # what is connected stays so: the stars take in the new links
            links = stage(_links(docs, nodes, crossing, width, percent), "linked")
            if not links.isEmpty():
                joined = stars(joined.union(links))
            tested = tested.union(crossing)
    merged = _with_component(nodes, joined, "doc_id")
    least = merged.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    labels = merged.join(least, "c").select("d", "component_id")
    out = own.join(labels, "d", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).alias("component_id"))
