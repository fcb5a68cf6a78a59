"""Explicit schemas of the tables the operators read and write."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_LONG, _INT, _DOUBLE, _STRING, _BYTES = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BinaryType()


def fields(**types: T.DataType) -> T.StructType:
    """Schema from ``name=type`` pairs, in order."""
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


IMAGE_SHARD = fields(image=fields(bytes=_BYTES, path=_STRING), artist=_LONG, genre=_LONG, style=_LONG)

UNIQUE_INDEX = fields(
    unique_idx=_LONG, image_hash=_STRING, source_shard=_STRING, source_row_idx=_LONG, artist=_LONG, genre=_LONG,
    style=_LONG, width=_LONG, height=_LONG, orientation=_STRING, aspect_ratio=_DOUBLE, bytes_size=_LONG, megapixels=_DOUBLE,
)

DUPLICATES = fields(
    image_hash=_STRING, duplicate_shard=_STRING, duplicate_row_idx=_LONG, primary_unique_idx=_LONG,
    artist=_LONG, genre=_LONG, style=_LONG,
)

DECODE_ERRORS = fields(source_shard=_STRING, source_row_idx=_LONG, error=_STRING)

STREAM_SAMPLE = fields(source_shard=_STRING, source_row_idx=_LONG, image_bytes=_BYTES, style=_INT, genre=_INT)

METRICS_LONG = fields(
    run_id=_STRING, target=_STRING, model_id=_STRING, n_images=_LONG, top1_accuracy=_DOUBLE, top5_accuracy=_DOUBLE,
    elapsed_seconds=_DOUBLE, images_per_second=_DOUBLE, metrics_path=_STRING, predictions_path=_STRING,
)

METRICS_DOCUMENT = fields(
    model=_STRING, target=_STRING, n_images=_LONG, top1_accuracy=_DOUBLE, top5_accuracy=_DOUBLE,
    elapsed_seconds=_DOUBLE, images_per_second=_DOUBLE, per_class=T.MapType(_STRING, fields(n=_LONG, top1_acc=_DOUBLE)),
)

DETECTIONS = T.ArrayType(fields(label=_STRING, score=_DOUBLE))

GRADE = fields(grade=_INT, explanation=_STRING)

PREDICTION = fields(
    run_id=_STRING, model_id=_STRING, image_id=_STRING, label=_STRING, score=_DOUBLE, prediction=_STRING, split=_STRING
)


def require_columns(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise with the columns it lacks."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the columns of ``schema`` in order, cast to its types."""
    require_columns(df, schema.fieldNames())
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
