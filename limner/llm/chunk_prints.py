"""Document fingerprints from content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text. Chunks end where its top bits are zero: more bits
before the normal chunk size than after it, so that sizes gather around the normal one. An edit moves
only the boundaries next to it. The fingerprint is the set of chunk digests with the chunk lengths as
weights, and the containment of one text in another is the weight of the shared digests.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limner.llm.words import mix

MIN, NORMAL, MAX = 32, 64, 256
_STRICT, _LOOSE = np.uint32(0xFE000000), np.uint32(0xF8000000)
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_PRINT = np.dtype([("digest", "<u8"), ("length", "<u2")])
_GROUP = 1 << 21


def boundary_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places after whose byte a chunk may end before, and from, the normal size; the hash sees the last 32 bytes."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    loose = np.flatnonzero((h & _LOOSE) == 0)
    return loose[(h[loose] & _STRICT) == 0], loose


def chunk_ends(size: int, strict: list[int], loose: list[int], base: int = 0) -> list[int]:
    """Ends of the chunks of ``size`` bytes that start at ``base``, by the places of ``boundary_places``."""
    ends, start, stop = [], base, base + size
    while start < stop:
        if stop - start <= MIN:
            end = stop
        else:
            i = bisect_left(strict, start + MIN - 1)
            if i < len(strict) and strict[i] < start + NORMAL - 1:
                end = strict[i] + 1
            else:
                i = bisect_left(loose, start + NORMAL - 1)
                end = min(loose[i] + 1, start + MAX) if i < len(loose) else start + MAX
            end = min(end, stop)
        ends.append(end)
        start = end
    return ends


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """For each text its distinct chunk digests in order, with the chunk lengths."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"".join(raws)
    strict, loose = (x.tolist() for x in boundary_places(np.frombuffer(joined, np.uint8)))
    out, base = [], 0
    for raw in raws:
        ends = chunk_ends(len(raw), strict, loose, base)
        chunks: dict[int, int] = {}
        start = base
        for end in ends:
            chunks[xxhash.xxh3_64_intdigest(joined[start:end])] = end - start
            start = end
        print_ = np.fromiter(chunks.items(), _PRINT, len(chunks))
        out.append(print_[np.argsort(print_["digest"])])
        base += len(raw)
    return out


def containment(one: np.ndarray, other: np.ndarray) -> float:
    """Share of the weight of ``one`` whose digests ``other`` has too; 1 for two empty sets, 0 for one."""
    if not len(one):
        return float(not len(other))
    if not len(other):
        return 0.0
    at = np.minimum(np.searchsorted(other["digest"], one["digest"]), len(other) - 1)
    shared = other["digest"][at] == one["digest"]
    return float(one["length"][shared].sum(dtype=np.int64) / one["length"].sum(dtype=np.int64))


def as_text(print_: np.ndarray) -> str:
    return base64.b64encode(print_.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), _PRINT)


def edited(text: str, following: str) -> str:
    """The last quarter of a text's code points replaced by as many of the first of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` for every row and whole text of ``docs(doc_id, text)``; null counts as empty."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([as_text(x) for x in _in_groups(texts)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _in_groups(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size > _GROUP:
            out += fingerprints(group)
            group, size = [], 0
    return out + fingerprints(group)


def _dealt(cuts: np.ndarray, first: int | None):
    """Each row in its range of ids; the first row of a range also as a guest of the range before, the very first of the last."""
    last = len(cuts)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            known = np.array(ids.is_valid())
            values = ids.fill_null(0).to_numpy()
            part = np.where(known, np.searchsorted(cuts, values, "right"), last).astype(np.int32)
            yield _with(batch, part, False)
            heads = known & np.isin(values, cuts)
            if heads.any():
                yield _with(batch.filter(pa.array(heads)), part[heads] - 1, True)
            opening = known & (values == (first if first is not None else 0)) & (first is not None)
            if opening.any():
                yield _with(batch.filter(pa.array(opening)), np.full(int(opening.sum()), last, np.int32), True)

    return run


def _with(batch: pa.RecordBatch, part: np.ndarray, guest: bool) -> pa.RecordBatch:
    n = batch.num_rows
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([guest] * n, pa.bool_()), batch.column("doc_id"), batch.column("text")], names=["part", "guest", "doc_id", "text"])


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _compared(batches):
    """Rows in the order of ranges, own rows, then guests: each own row beside the row after it."""
    waiting: list[tuple] = []
    size, part, closed = 0, None, False

    def flush(following: str | None):
        """Give what waits; the last row only if its following text is known."""
        texts = [t for _, t in waiting] + ([following] if following is not None else [])
        n = len(texts) - 1
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        own, new = fingerprints(texts), fingerprints(changed)
        columns = [
            [doc for doc, _ in waiting[:n]], [len(t) for t in texts[:n]], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            [as_text(x) for x in own[:n]], [as_text(x) for x in new], [containment(a, b) for a, b in zip(own, new, strict=False)], [containment(a, b) for a, b in zip(own, own[1:], strict=False)],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    for batch in batches:
        rows = zip(batch.column("part").to_pylist(), batch.column("guest").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
        for p, guest, doc, text in rows:
            if p != part:
                if waiting:  # only where no row has an id
                    yield flush("")
                waiting, size, part, closed = [], 0, p, False
            if closed:
                continue
            text = text.as_py() or ""
            if guest:
                if waiting:
                    yield flush(text)
                waiting, closed = [], True
                continue
            waiting.append((doc, text))
            size += len(text)
            if size > _GROUP and len(waiting) > 1:
                yield flush(None)
                waiting, size = waiting[-1:], len(text)
    if waiting:
        yield flush("")


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs(doc_id, text)`` and of its edited form, and their likeness.

    ``near_edited`` and ``near_next`` are the containment of the text in its edited form and in the text of the
    next row by ascending ``doc_id`` (after the last: the first). Null counts as empty. Rows that repeat a
    ``doc_id`` follow each other in the order of their texts' hashes, and rows without one come last; if no row has
    one, the last of a task is followed by an empty text.

    Texts move once: to their range of ids. The cuts are ids of the table, so the first row of each range is known
    beforehand and goes along to the range before it.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    probabilities = ", ".join(str(i / ranges) for i in range(1, ranges)) or "0.5"
    found = docs.agg(F.min("doc_id").alias("first"), F.expr(f"percentile_approx(doc_id, array({probabilities}), 20000)").alias("cuts")).first()
    cuts = np.unique(np.array([c for c in found.cuts or [] if c > found.first], np.int64))
    order = ["part", "guest", F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    dealt = docs.mapInArrow(_dealt(cuts, found.first), "part int, guest boolean, doc_id long, text string")
    sorted_ = dealt.repartitionById(len(cuts) + 1, "part").sortWithinPartitions(*order)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sorted_.mapInArrow(_compared, schema)
