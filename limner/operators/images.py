"""Per-image columns: dimensions from the encoded header, geometry, quarantine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limner.functions.numbers import round_exact
from limner.schemas import fields

# File signatures.
PNG_MAGIC = bytes.fromhex("89504E470D0A1A0A")
JPEG_MAGIC = bytes.fromhex("FFD8")
GIF_MAGICS = (b"GIF87a", b"GIF89a")
BMP_MAGIC = b"BM"

# JPEG frame header markers, which carry the size.
JPEG_FRAME_MARKERS = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
# JPEG markers that stand alone, without a length.
JPEG_BARE_MARKERS = frozenset(range(0xD0, 0xD8)) | {0x01}


def jpeg_dims(data: bytes) -> tuple[int | None, int | None, str | None]:
    """Width and height from the first frame header, or the reason there is none."""
    at, end = 2, len(data)
    while at < end:
        if data[at] != 0xFF:
            return None, None, "broken jpeg segment"
        while at < end and data[at] == 0xFF:
            at += 1
        if at >= end:
            break
        marker, at = data[at], at + 1
        if marker in JPEG_BARE_MARKERS:
            continue
        if marker in (0xD9, 0xDA):
            return None, None, "jpeg without frame header"
        if marker in JPEG_FRAME_MARKERS:
            if at + 7 > end:
                break
            height = int.from_bytes(data[at + 3 : at + 5], "big")
            width = int.from_bytes(data[at + 5 : at + 7], "big")
            return width, height, None
        if at + 2 > end:
            break
        step = int.from_bytes(data[at : at + 2], "big")
        if step < 2:
            return None, None, "broken jpeg segment"
        at += step
    return None, None, "truncated header"


#: Bytes of a JPEG that are looked at first.
JPEG_HEAD = 1 << 16


@F.pandas_udf(fields(width=T.LongType(), height=T.LongType(), error=T.StringType()))
def _jpeg_dims(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for payloads in batches:
        rows = [(None, None, None) if p is None else jpeg_dims(p) for p in payloads]
        out = pd.DataFrame(rows, columns=["width", "height", "error"])
        yield out.astype({"width": "Int64", "height": "Int64", "error": "object"})


def _big_endian(b: Column, start: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(b, start, n)), 16, 10).cast("bigint")


def _little_endian(b: Column, start: int, n: int) -> Column:
    flipped = F.concat(*[F.substring(b, start + i, 1) for i in reversed(range(n))])
    return F.conv(F.hex(flipped), 16, 10).cast("bigint")


def _signed32(x: Column) -> Column:
    return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)


def _dims(width: Column | None = None, height: Column | None = None, error: str | None = None) -> Column:
    number = lambda x: F.lit(x).cast("bigint") if x is None else x.cast("bigint")
    return F.struct(number(width).alias("width"), number(height).alias("height"), F.lit(error).cast("string").alias("error"))


def _header_dims(head: Column, n: Column) -> Column:
    """``struct(width, height, error)`` from the first bytes of a PNG, GIF or BMP payload of ``n`` bytes."""

    def starts(*magics: bytes) -> Column:
        return F.substring(head, 1, len(magics[0])).isin(*[F.lit(m) for m in magics])

    short = _dims(error="truncated header")
    png = (
        F.when(n < 24, short)
        .when(F.substring(head, 13, 4) == F.lit(b"IHDR"), _dims(_big_endian(head, 17, 4), _big_endian(head, 21, 4)))
        .otherwise(_dims(error="broken png header"))
    )
    gif = F.when(n < 10, short).otherwise(_dims(_little_endian(head, 7, 2), _little_endian(head, 9, 2)))
    bmp = F.when(n < 26, short).otherwise(
        _dims(_signed32(_little_endian(head, 19, 4)), F.abs(_signed32(_little_endian(head, 23, 4))))
    )
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, _dims(error="empty payload"))
        .when(starts(PNG_MAGIC), png)
        .when(starts(*GIF_MAGICS), gif)
        .when(starts(BMP_MAGIC), bmp)
        .otherwise(_dims(error="unknown image format"))
    )


def image_dims(df: DataFrame, payload: str, jpeg: bool = True) -> DataFrame:
    """Add ``width``, ``height`` and ``error`` from the encoded header; pixels stay encoded.

    PNG, GIF and BMP are read with built-in expressions. Only JPEG payloads,
    whose size sits behind a chain of segments, go through an Arrow UDF, and
    only when ``jpeg`` is on: their first 64 KB, and all of those whose header
    lies further back.
    """
    b = F.col(payload)
    found = _header_dims(F.col("_head"), F.col("_n"))
    measured = df.withColumns({"_head": F.substring(b, 1, 26), "_n": F.octet_length(b)})
    out = measured.withColumn("_dims", found).drop("_head", "_n")
    if jpeg:
        is_jpeg = F.substring(b, 1, 2) == F.lit(JPEG_MAGIC)
        out = out.withColumn("_jpeg", _jpeg_dims(F.when(is_jpeg, F.substring(b, 1, JPEG_HEAD))))
        beyond = is_jpeg & (F.col("_jpeg.error") == "truncated header") & (F.octet_length(b) > JPEG_HEAD)
        out = out.withColumn("_whole", _jpeg_dims(F.when(beyond, b)))
        jpeg_found = F.when(beyond, F.col("_whole")).otherwise(F.col("_jpeg"))
        out = out.withColumn("_dims", F.when(is_jpeg, jpeg_found).otherwise(F.col("_dims"))).drop("_jpeg", "_whole")
    return out.withColumns({c: F.col(f"_dims.{c}") for c in ("width", "height", "error")}).drop("_dims")


def orientation(width: Column, height: Column) -> Column:
    """square, landscape or portrait."""
    return F.when(width == height, "square").when(width > height, "landscape").otherwise("portrait")


def abs_log_aspect(aspect: Column) -> Column:
    """How far an aspect ratio is from 1, in either direction."""
    return F.abs(F.ln(F.greatest(aspect, F.lit(1e-6))))


def bytes_per_pixel(nbytes: Column, width: Column, height: Column) -> Column:
    """Payload bytes per pixel; NULL for an empty image."""
    return F.try_divide(nbytes.cast("double"), (width * height).cast("double"))


def geometry_features(df: DataFrame, width: str = "width", height: str = "height", nbytes: str = "bytes_size") -> DataFrame:
    """Add megapixels, aspect ratio (also at 6 decimals), orientation, bytes per pixel and extremeness."""
    w, h = F.col(width), F.col(height)
    aspect = w / F.greatest(h, F.lit(1))
    mpix = (w * h) / F.lit(1_000_000.0)
    return df.withColumns(
        {
            "pixels": w * h,
            "megapixels": mpix,
            "aspect_ratio": aspect,
            "megapixels_6": round_exact(mpix, 6),
            "aspect_ratio_6": round_exact(aspect, 6),
            "orientation": orientation(w, h),
            "bytes_per_pixel": bytes_per_pixel(F.col(nbytes), w, h),
            "abs_log_aspect": abs_log_aspect(aspect),
        }
    )


def split_quarantine(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """``(valid, quarantined)``: rows without and with an error."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())


def first_errors(quarantined: DataFrame, order: list[str], n: int = 100) -> DataFrame:
    """The first ``n`` errors in locator order, for a report."""
    return quarantined.orderBy(*order).limit(n)
