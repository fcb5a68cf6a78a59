"""Encoded headers, geometry and rounding."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from limner.functions.numbers import clamp, fixed, percent, round_exact
from limner.operators.images import first_errors, geometry_features, image_dims, jpeg_dims, split_quarantine
from tests.conftest import rows


def png(w, h):
    return bytes.fromhex("89504E470D0A1A0A") + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x02\x00\x00\x00"


def gif(w, h):
    return b"GIF89a" + struct.pack("<HH", w, h) + b"\x00\x00\x00"


def bmp(w, h):
    return b"BM" + struct.pack("<IHHIIii", 100, 0, 0, 54, 40, w, h) + b"\x00" * 28


def jpeg(w, h, padding=0):
    exif = b"\xff\xe1" + struct.pack(">H", padding + 2) + b"\x00" * padding if padding else b""
    return b"\xff\xd8" + exif + b"\xff\xff\xc2\x00\x11\x08" + struct.pack(">HH", h, w) + b"\x03" + b"\x00" * 9


CASES = [
    (png(640, 480), 640, 480, None),
    (png(640, 480)[:20], None, None, "truncated header"),
    (b"\x89PNG\r\n\x1a\n" + b"\x00" * 30, None, None, "broken png header"),
    (gif(300, 70_00), 300, 7000, None),
    (gif(300, 200)[:8], None, None, "truncated header"),
    (bmp(17, -33), 17, 33, None),
    (jpeg(1920, 1080), 1920, 1080, None),
    (jpeg(4000, 3000, padding=60_000), 4000, 3000, None),
    (jpeg(1920, 1080, padding=60_000)[:40_000], None, None, "truncated header"),
    (b"\xff\xd8\xff\xd9", None, None, "jpeg without frame header"),
    (b"\xff\xd8\x00\x00", None, None, "broken jpeg segment"),
    (b"plain text", None, None, "unknown image format"),
    (b"", None, None, "empty payload"),
    (None, None, None, "empty payload"),
]


@pytest.mark.parametrize("layout", [1, 5])
def test_dims_of_every_format(spark, layout):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, payload binary").repartition(layout)
    got = {r["id"]: (r["width"], r["height"], r["error"]) for r in image_dims(df, "payload").collect()}
    assert got == {i: c[1:] for i, c in enumerate(CASES)}


def test_no_prefix_of_a_jpeg_raises():
    data = jpeg(10, 20, padding=5)
    for n in range(2, len(data)):
        assert jpeg_dims(data[:n])[:2] in [(None, None), (10, 20)]


def test_quarantine_keeps_all_rows(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, payload binary")
    valid, bad = split_quarantine(image_dims(df, "payload"))
    assert valid.count() + bad.count() == len(CASES)
    assert "error" not in valid.columns
    assert [r["id"] for r in first_errors(bad, ["id"], 2).collect()] == [1, 2]


def test_geometry(spark):
    df = spark.createDataFrame([(1, 400, 300, 1200), (2, 5, 5, 50), (3, 2, 7, 0), (4, 0, 0, 9)], "id int, width long, height long, bytes_size long")
    got = {r["id"]: r for r in geometry_features(df).collect()}
    assert [got[i]["orientation"] for i in (1, 2, 3)] == ["landscape", "square", "portrait"]
    assert got[1]["megapixels"] == 0.12 and got[1]["bytes_per_pixel"] == 0.01
    assert got[3]["aspect_ratio_6"] == round(2 / 7, 6)
    assert got[4]["bytes_per_pixel"] is None and got[4]["aspect_ratio"] == 0.0
    assert got[4]["abs_log_aspect"] == pytest.approx(13.815510558)


def test_rounding_agrees_with_python(spark):
    rng = random.Random(1)
    xs = [k / 20000 for k in range(3, 4000)] + [rng.uniform(-1e4, 1e4) for _ in range(2000)] + [2.675, 0.015, -1.005]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", round_exact(F.col("x"), 4).alias("r"), fixed(F.col("x"), 2).alias("t")).collect():
        assert r["r"] == round(r["x"], 4)
        assert r["t"] == f"{r['x']:.2f}"


def test_formats(spark):
    row = spark.range(1).select(
        fixed(F.lit(1234567), 0, grouping=True).alias("n"), percent(F.lit(0.12345)).alias("p"), clamp(F.lit(120), 0, 100).alias("c")
    ).first()
    assert tuple(row) == ("1,234,567", "12.35%" if f"{0.12345:.2%}" == "12.35%" else f"{0.12345:.2%}", 100)


def test_jpeg_payload_alone_goes_to_python(spark):
    df = spark.createDataFrame([(png(3, 4),)], "payload binary")
    plan = image_dims(df, "payload", jpeg=False)._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert rows(image_dims(df, "payload", jpeg=False).select("width", "height")) == [(3, 4)]
