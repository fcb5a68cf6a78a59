"""From shards to the deduplicated image index, with duplicates and decode errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limner.operators.dedupe import dedupe_exact, dedupe_summary, hash_counts
from limner.operators.images import geometry_features, image_dims, split_quarantine
from limner.plans.staging import stage
from limner.schemas import DECODE_ERRORS, DUPLICATES, UNIQUE_INDEX, conform

LOCATOR = ["source_shard", "source_row_idx"]


@dataclass(frozen=True)
class ImageIndex:
    unique: DataFrame
    duplicates: DataFrame
    errors: DataFrame
    summary: DataFrame
    hashes: DataFrame


def build_image_index(rows: DataFrame, payload: str = "image_bytes", jpeg: bool = True) -> ImageIndex:
    """Index the payloads of ``rows`` (locator, class ids and payload).

    The payload is read once: hash, size and dimensions are written to a narrow
    table before anything is shuffled, and every result comes from that table.
    """
    measured = image_dims(rows, payload, jpeg).select(
        *LOCATOR,
        "artist",
        "genre",
        "style",
        F.md5(payload).alias("image_hash"),
        F.octet_length(payload).cast("bigint").alias("bytes_size"),
        "width",
        "height",
        "error",
    )
    narrow = stage(measured, "payloads")
    valid, bad = split_quarantine(narrow)
    described = geometry_features(valid).withColumns(
        {"megapixels": F.col("megapixels_6"), "aspect_ratio": F.col("aspect_ratio_6")}
    )
    keep = [f for f in UNIQUE_INDEX.fieldNames() if f != "unique_idx"]
    unique, dup = dedupe_exact(described.select(*keep), "image_hash", LOCATOR)
    renamed = dup.withColumnsRenamed({"source_shard": "duplicate_shard", "source_row_idx": "duplicate_row_idx"})
    counts = hash_counts(narrow, "image_hash", "error")
    return ImageIndex(
        conform(unique, UNIQUE_INDEX), conform(renamed, DUPLICATES), conform(bad, DECODE_ERRORS), dedupe_summary(counts), counts
    )
