"""Fixed vocabularies of the evaluation tasks and their prompt templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Style names in alphabetical order; the position is the class id.
STYLE_NAMES: list[str] = [
    "Abstract Expressionism",
    "Action Painting",
    "Analytical Cubism",
    "Art Nouveau",
    "Baroque",
    "Color Field Painting",
    "Contemporary Realism",
    "Cubism",
    "Early Renaissance",
    "Expressionism",
    "Fauvism",
    "High Renaissance",
    "Impressionism",
    "Mannerism Late Renaissance",
    "Minimalism",
    "Naive Art Primitivism",
    "New Realism",
    "Northern Renaissance",
    "Pointillism",
    "Pop Art",
    "Post Impressionism",
    "Realism",
    "Rococo",
    "Romanticism",
    "Symbolism",
    "Synthetic Cubism",
    "Ukiyo-e",
]

# Genre names in alphabetical order; the position is the class id.
GENRE_NAMES: list[str] = [
    "abstract painting",
    "cityscape",
    "genre painting",
    "illustration",
    "landscape",
    "nude painting",
    "portrait",
    "religious painting",
    "sketch and study",
    "still life",
    "unknown genre",
]

# Prompt templates for a class name (style and genre use the same ones).
STYLE_TEMPLATES: list[str] = [
    "a painting in the style of {style}",
    "a {style} painting",
    "an artwork in {style} style",
    "a fine art piece in {style}",
]

# Prompt templates for a free label.
LABEL_TEMPLATES: list[str] = [
    "a painting of {label}",
    "an artwork containing {label}",
    "a fine art image showing {label}",
    "a museum artwork with {label}",
]

# Fixed value: caption of a training pair.
CAPTION_TEMPLATE = "a painting in style_{style_id}"

# Labels the detector looks for, in vocabulary order.
CANDIDATE_LABELS: list[str] = [
    "cat",
    "painting",
    "drawing",
    "canvas",
    "abstract art",
    "geometric shapes",
    "dollar bill",
    "cash",
    "person",
    "colorful artwork",
    "monochrome artwork",
    "sculpture",
    "photograph",
]

# Fixed value: similarity from which a label counts as detected.
DETECTION_THRESHOLD = 0.20


def vocabulary(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Dimension table ``class_id, name`` of a vocabulary."""
    return spark.createDataFrame(list(enumerate(names)), "class_id int, name string")
