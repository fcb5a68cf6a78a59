"""The profile of a dataset as one document: deduplicate, then describe what is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limner.operators.dedupe import dedupe_summary, dup_group_sizes, hash_counts, keep_first, repeated_hashes, top_duplicate_hashes
from limner.operators.images import image_dims
from limner.operators.indexing import budgeted_prefix
from limner.operators.profile import class_balance, class_counts, coverage, dims_profile, extremes, mix, normalized_entropy, numeric_profile, top_classes
from limner.plans.staging import stage
from limner.sinks.documents import nested_counts, nested_rows, summary_document

DIMS = ["style", "genre", "artist"]


def profile_document(
    rows: DataFrame, hash_col: str, dims: Sequence[str], order: Sequence[str] = ("source_shard", "source_row_idx"), top_k: int = 20
) -> DataFrame:
    """One row: dedup counts, class balance per dimension, duplicate groups, top classes.

    Each of the two count tables is written once and then read by all parts.
    """
    hashes = stage(hash_counts(rows, hash_col), "hashes")
    kept = keep_first(rows, hash_col, list(order))
    counts = stage(class_counts(kept, dims), "classes")
    summary = dedupe_summary(hashes)
    balance = class_balance(counts)
    parts = {c: summary.select(c) for c in summary.columns}
    parts |= {d: balance.filter(F.col("dim") == d).drop("dim") for d in dims}
    top = top_classes(counts, top_k)
    parts |= {
        f"top_{d}_ids": nested_rows(top.filter(F.col("dim") == d), [F.col("rank")], ["class_id", "n"], top_k) for d in dims
    }
    parts["duplicate_group_sizes"] = nested_counts(dup_group_sizes(hashes), "group_size", "hashes")
    parts["top_duplicate_hashes"] = nested_rows(
        top_duplicate_hashes(hashes, hash_col), [F.desc("n"), F.col(hash_col)], [hash_col, "n"], 20
    )
    return summary_document(rows.sparkSession, parts)


SIZES = ["width", "height", "bytes_size", "megapixels", "aspect_ratio"]


def full_profile_document(
    rows: DataFrame,
    hash_col: str,
    dims: Sequence[str] = tuple(DIMS),
    order: Sequence[str] = ("source_shard", "source_row_idx"),
    errors: DataFrame | None = None,
    top_k: int = 20,
) -> DataFrame:
    """One row with all that a dataset profile holds, over all rows and over those kept.

    ``rows`` has the hash, the ``dims`` and the columns of ``geometry_features``; ``errors`` are the rows that could not be
    decoded. Besides the parts of ``profile_document``: coverage, entropy and orientation of all and of unique rows,
    five size profiles, extremes and the number of decode errors.
    """
    narrow = rows.select(hash_col, *order, *dims, *SIZES, "orientation")
    hashes = stage(hash_counts(narrow, hash_col), "hashes")
    kept = stage(keep_first(narrow, hash_col, list(order)), "kept")
    counts = {"all": stage(class_counts(narrow, dims), "classes"), "unique": stage(class_counts(kept, dims), "classes")}
    summary, balance = dedupe_summary(hashes), class_balance(counts["unique"])
    parts = {c: summary.select(c) for c in summary.columns}
    parts |= {d: balance.filter(F.col("dim") == d).drop("dim") for d in dims}
    for name, rows_of in (("all", narrow), ("unique", kept)):
        parts[f"coverage_{name}"] = nested_counts(coverage(counts[name]), "dim", "classes")
        parts[f"entropy_norm_{name}"] = nested_counts(normalized_entropy(counts[name]), "dim", "entropy_norm")
        parts[f"orientation_{name}"] = nested_rows(mix(rows_of, "orientation"), [F.desc("n"), F.col("orientation")], ["orientation", "n"])
    sizes = numeric_profile(kept, SIZES)
    parts["size_stats"] = nested_rows(sizes, [F.col("metric")], sizes.columns)
    parts["extremes"] = extremes(kept)
    top = top_classes(counts["unique"], top_k)
    parts |= {f"top_{d}_ids": nested_rows(top.filter(F.col("dim") == d), [F.col("rank")], ["class_id", "n"], top_k) for d in dims}
    parts["duplicate_group_sizes"] = nested_counts(dup_group_sizes(hashes), "group_size", "hashes")
    parts["top_duplicate_hashes"] = nested_rows(top_duplicate_hashes(hashes, hash_col), [F.desc("n"), F.col(hash_col)], [hash_col, "n"], 20)
    parts["decode_errors"] = F.lit(0).cast("bigint") if errors is None else errors.agg(F.count("*"))
    return summary_document(rows.sparkSession, parts)


def audit_document(
    rows: DataFrame, audit: DataFrame, budget: int, dims: Sequence[str] = tuple(DIMS), payload: str = "payload", shard: str = "source_shard",
    position: str = "source_row_idx", top_k: int = 20, n_errors: int = 100,
) -> DataFrame:
    """One row on the state of a dataset: shards, rows and classes of all rows, sizes and repeated payloads of the first ``budget`` rows, first errors.

    ``rows`` are those that can be read, ``position`` counting from 0 within a shard; ``audit`` is the table of
    ``sources.shard_audit.audit_shards``. Payloads are decoded within the budget only, shard by shard. A shard counts as bad if any of its
    rows are lost. Errors are those of shards, then those of payloads, each in order.
    """
    counts = stage(class_counts(rows, dims), "classes")
    taken = budgeted_prefix(rows.select(shard, position, payload), shard, position, budget)
    looked = stage(image_dims(taken.withColumn("image_hash", F.md5(payload)), payload).drop(payload), "decoded")
    good = looked.where("error IS NULL")
    bad = audit.where("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("error"))
    errors = bad.select(F.lit(0).alias("kind"), F.col("path").alias("file"), F.lit(None).cast("long").alias("at"), "error").unionByName(
        looked.where("error IS NOT NULL").select(F.lit(1).alias("kind"), F.col(shard).alias("file"), F.col(position).cast("long").alias("at"), "error")
    )
    sizes, found = dims_profile(good), coverage(counts)
    parts: dict[str, DataFrame] = {
        "parquet_shards": audit.agg(F.count_distinct("path")),
        "parquet_bad_shards": bad.agg(F.count("*")),
        "total_rows": rows.agg(F.count("*")),
        "decoded_images": good.agg(F.count("*")),
        "decode_errors": looked.where("error IS NOT NULL").agg(F.count("*")),
        "disk_size_bytes": audit.select("path", "length").distinct().agg(F.sum("length")),
    }
    top = top_classes(counts, top_k)
    for d in dims:
        parts[f"top_{d}_ids"] = nested_rows(top.filter(F.col("dim") == d), [F.col("rank")], ["class_id", "n"], top_k)
        parts[f"distinct_{d}_ids"] = found.filter(F.col("dim") == d).select("classes")
    parts["sample_duplicate_hashes"] = repeated_hashes(hash_counts(good, "image_hash"))
    for name in ("width", "height"):
        parts[f"image_{name}"] = sizes.filter(F.col("metric") == name).select("min", "max", F.col("mean_2").alias("mean"))
    parts["errors"] = nested_rows(errors, [F.col("kind"), F.col("file"), F.col("at"), F.col("error")], ["file", "error"], n_errors)
    return summary_document(rows.sparkSession, parts)
