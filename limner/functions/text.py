"""Identifiers, run ids, templates and label summaries as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from limner.functions.numbers import fixed

RUN_ID_PATTERN = "yyyyMMdd_HHmmss"

# Model id prefixes of the three evaluation tracks and their display names.
FAMILY_PREFIXES: dict[str, tuple[str, str]] = {
    "trackB::": ("Track B (Fine-tuned CLIP)", "Track B fine-tuned"),
    "linear_map::": ("Track C (Linear Map)", "Track C linear map"),
}


def sanitize_id(name: Column) -> Column:
    """A name that is safe in a file path."""
    out = name
    for old, new in (("/", "__"), (":", "__"), ("=>", "_to_"), (" ", "_")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def model_tag(model_id: Column) -> Column:
    """File tag of a model id."""
    return F.replace(model_id, F.lit("/"), F.lit("__"))


def linear_map_id(image_model: Column, text_model: Column) -> Column:
    """Model id of a linear map between two encoders."""
    return F.concat(F.lit("linear_map::"), image_model, F.lit("=>"), text_model)


def linear_map_tag(image_model: Column, text_model: Column) -> Column:
    """File tag of a linear map between two encoders."""
    return F.concat(F.lit("linear_map__"), model_tag(image_model), F.lit("__to__"), model_tag(text_model))


def model_family(model_id: Column, prefixes: Mapping[str, tuple[str, str]] = FAMILY_PREFIXES) -> Column:
    """The prefix a model id starts with, or ``''`` for a model scored without training."""
    out = F.lit("")
    for prefix in reversed(list(prefixes)):
        out = F.when(F.startswith(model_id, F.lit(prefix)), F.lit(prefix)).otherwise(out)
    return out


def pretty_model(model_id: Column) -> Column:
    """Display name used in tables: the track, and the last path part of an untrained model."""
    out = F.concat(F.lit("Track A ("), F.element_at(F.split(model_id, "/"), -1), F.lit(")"))
    for prefix, (long_name, _short) in FAMILY_PREFIXES.items():
        out = F.when(F.startswith(model_id, F.lit(prefix)), F.lit(long_name)).otherwise(out)
    return out


def short_model(model_id: Column) -> Column:
    """Short display name; an untrained model keeps its id."""
    out = model_id
    for prefix, (_long, short_name) in FAMILY_PREFIXES.items():
        out = F.when(F.startswith(model_id, F.lit(prefix)), F.lit(short_name)).otherwise(out)
    return out


def run_stage(run_id: Column, n_images: Column, min_full: int) -> Column:
    """``Smoke`` for a trial run (by name or by size), else ``Full``."""
    smoke = F.contains(F.lower(run_id), F.lit("smoke")) | (n_images < min_full)
    return F.when(smoke, F.lit("Smoke")).otherwise(F.lit("Full"))


def run_id_from_ts(prefix: str, ts: Column) -> Column:
    """``prefix`` followed by the time to the second."""
    return F.concat(F.lit(prefix), F.date_format(ts, RUN_ID_PATTERN))


def ts_from_run_id(run_id: Column) -> Column:
    """The time a run id ends with, or NULL."""
    stamp = F.regexp_extract(run_id, r"(\d{8}_\d{6})$", 1)
    return F.try_to_timestamp(stamp, F.lit(RUN_ID_PATTERN))


def iso_utc(ts: Column) -> Column:
    """ISO text of a UTC time with a trailing ``Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def fill_template(template: Column, slot: str, value: Column) -> Column:
    """Put ``value`` where the template says ``{slot}``."""
    return F.replace(template, F.lit("{" + slot + "}"), value)


def label_summary(detections: Column) -> Column:
    """``"cat (0.82), cash (0.40)"`` in the order of the detections."""
    one = lambda d: F.concat(d["label"], F.lit(" ("), fixed(d["score"], 2), F.lit(")"))
    return F.array_join(F.transform(detections, one), ", ")


def count_map(key: Column, n: Column) -> Column:
    """Aggregate ``(key, n)`` rows into a map ordered by key; use it on counted rows only."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("key"), n.alias("value")))))
