"""Line deduplication by a range-partitioned order of line hashes.

Lines become rows of (hash, document, position). The rows are range-partitioned and
sorted by all three, so that a stream over a partition meets each hash first in the
document that keeps it. Texts are not part of that: the result is one compressed bitmap
of kept lines per document, which ``kept_text`` applies to the text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limner.llm.words import tidy
from limner.plans.staging import stage

MIN_CHARS = 10
_SPACES = b" \t\n\x0b\x0c\r"
_FIRST, _HEAD, _EDGE, _SIZE = 0, 1, 2, 3


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z in lower case."""
    return line.strip(_SPACES).lower()


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_LINES = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("position", pa.int32())])
_FOUND = pa.schema([("kind", pa.int8()), ("key", pa.binary()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("position", pa.int32())])
_BITMAPS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])


def _lines(min_chars: int):
    """A row per line that can be dropped; and one without key per text, whose position is its number of lines."""

    @tidy
    def run(batches):
        for batch in batches:
            ids, marks, texts = (batch.column(k) for k in ("doc_id", "text_key", "text"))
            keys, docs, own, places = [], [], [], []
            held = 0
            for i in range(batch.num_rows):
                doc, mark = ids[i].as_py(), marks[i].as_py()
                lines = (texts[i].as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
                for place, line in enumerate(lines):
                    key = line_key(line)
                    if len(key) >= min_chars and _code_points(key) >= min_chars:
                        keys.append(xxhash.xxh3_128_digest(key))
                        docs.append(doc)
                        own.append(mark)
                        places.append(place)
                keys.append(None)
                docs.append(doc)
                own.append(mark)
                places.append(len(lines))
                held += len(lines) + 1
                if held > 1 << 16:
                    yield _batch(_LINES, [keys, docs, own, places])
                    keys, docs, own, places, held = [], [], [], [], 0
            yield _batch(_LINES, [keys, docs, own, places])

    return run


@tidy
def _first_documents(batches):
    """Of sorted lines, those outside the first document of their hash.

    The hash a partition starts with may have begun in an earlier one: all its lines are
    given with their hash (kind 1), and the first document of the partition's first and last
    hash beside them (kind 2). All other lines are decided here (kind 0).
    """
    head = last = first = None
    edges: dict[bytes, int] = {}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.dtype([("a", "<u8"), ("b", "<u8")]))
        docs = batch.column("doc_id").to_numpy()
        new = np.ones(n, bool)
        new[1:] = keys[1:] != keys[:-1]
        now = keys[:1].tobytes()
        if head is None:
            head, edges[now] = now, int(docs[0])
        if last is not None and now == last:
            new[0] = False
        group = np.cumsum(new)
        owners = np.concatenate(([first if first is not None else 0], docs[new]))
        tops = docs != owners[group]
        in_head = keys == np.frombuffer(head, keys.dtype)[0]
        keep = pa.array(tops | in_head)
        kind = np.where(in_head, _HEAD, _FIRST).astype(np.int8)
        rows = batch.filter(keep)
        kinds = pa.array(kind).filter(keep)
        yield pa.RecordBatch.from_arrays([kinds, rows.column("key"), rows.column("doc_id"), rows.column("text_key"), rows.column("position")], schema=_FOUND)
        first, last = int(owners[group[-1]]), keys[-1:].tobytes()
    if last is not None:
        edges.setdefault(last, first)
        yield _batch(_FOUND, [[_EDGE] * len(edges), list(edges), list(edges.values()), [None] * len(edges), [None] * len(edges)])


@tidy
def _bitmaps(batches):
    for batch in batches:
        keep = []
        for size, dropped in zip(batch.column("n_lines").to_pylist(), batch.column("dropped").to_pylist(), strict=True):
            bits = np.ones(size, bool)
            bits[dropped] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), batch.column("n_lines").cast(pa.int64()), batch.column("n_dropped").cast(pa.int64()), pa.array(keep, pa.binary())], schema=_BITMAPS
        )


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, text_key, n_lines, n_dropped, keep`` for every distinct text of every ``doc_id``.

    A line's key is the line without white space at its ends and with A-Z in lower case. Lines
    whose key has at least ``min_chars`` code points and occurs in several documents are kept only
    in the smallest ``doc_id`` that holds it. ``keep`` is a zlib-compressed bitmap, most significant
    bit first. Null and empty texts have one empty line. Rows that repeat a ``doc_id`` are parts
    of one document. Rows without a ``doc_id`` neither hold nor lose lines and have no bitmap.
    """
    source = _with_key(docs.select("doc_id", "text")).where("doc_id IS NOT NULL")
    lines = stage(source.mapInArrow(_lines(min_chars), "key binary, doc_id long, text_key long, position int"), "lines")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.where("key IS NOT NULL").repartitionByRange(parts, "key", "doc_id", "position").sortWithinPartitions("key", "doc_id", "position")
    found = stage(ordered.mapInArrow(_first_documents, "kind byte, key binary, doc_id long, text_key long, position int"), "first-lines")
    # two rows per range at most
    edges = found.where(f"kind = {_EDGE}").groupBy("key").agg(F.min("doc_id").alias("first_doc"))
    heads = found.where(f"kind = {_HEAD}").join(F.broadcast(edges), "key").where("doc_id > first_doc")
    dropped = found.where(f"kind = {_FIRST}").select("doc_id", "text_key", "position", F.lit(None).cast("int").alias("n_lines"))
    dropped = dropped.union(heads.select("doc_id", "text_key", "position", F.lit(None).cast("int"))).distinct()
    sizes = lines.where("key IS NULL").select("doc_id", "text_key", F.lit(None).cast("int").alias("position"), F.col("position").alias("n_lines"))
    texts = dropped.union(sizes).groupBy("doc_id", "text_key").agg(F.max("n_lines").alias("n_lines"), F.collect_list("position").alias("dropped"))
    texts = texts.withColumn("n_dropped", F.size("dropped"))
    return texts.mapInArrow(_bitmaps, "doc_id long, text_key long, n_lines long, n_dropped long, keep binary")


def kept_text(text: str, n_lines: int, keep: bytes) -> str:
    """The kept lines of a text, joined by line ends."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines)
    return "\n".join(line for line, bit in zip(text.split("\n"), bits, strict=True) if bit)


def _apply(digest_only: bool, text_at: int):
    @tidy
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            out, keep = [], batch.column("keep")
            sizes, dropped, texts = batch.column("n_lines").to_pylist(), batch.column("n_dropped").to_pylist(), batch.column(text_at)
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if sizes[i] is None:
                    sizes[i], dropped[i] = (text or "").count("\n") + 1, 0
                if dropped[i]:
                    text = kept_text(text, sizes[i], keep[i].as_py())
                out.append(hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest() if digest_only else text)
            columns = [pa.array(out, pa.string()) if i == text_at else batch.column(i) for i, n in enumerate(names) if n not in ("keep", "n_lines", "n_dropped", "text_key")]
            kept = [n for n in names if n not in ("keep", "n_lines", "n_dropped", "text_key")]
            if digest_only:
                columns += [pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64())]
                kept += ["n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    return run


def _joined(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    keyed = _with_key(docs)
    return keyed.join(bitmaps, ["doc_id", "text_key"], "left")


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``; ``n_chars``, where there is one, counts the code points left.

    Texts that lose nothing stay as they are, null included.
    """
    clash = {"text_key", "keep", "n_lines", "n_dropped"} & set(docs.columns)
    renamed = docs.withColumnsRenamed({c: f"own {c}" for c in clash})
    joined = _joined(renamed, line_bitmaps(docs, min_chars)).select(*[F.col(f"`{c}`") for c in renamed.columns], "text_key", "n_lines", "n_dropped", "keep")
    out = joined.mapInArrow(_apply(False, renamed.columns.index("text")), renamed.schema)
    out = out.withColumnsRenamed({f"own {c}": c for c in clash})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` for every row of ``docs``."""
    joined = _joined(docs.select("doc_id", "text"), line_bitmaps(docs, min_chars)).select("doc_id", "text", "n_lines", "n_dropped", "keep")
    out = joined.mapInArrow(_apply(True, 1), "doc_id long, text string, n_lines long, n_dropped long")
    return out.select("doc_id", "n_lines", "n_dropped", F.col("text").alias("kept_sha256"))
