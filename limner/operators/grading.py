"""Rule table that turns detected labels into a grade and an explanation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limner.functions.numbers import clamp
from limner.operators.scoring import detect
from limner.plans.ordering import hash_int

# Labels the rules react to.
CAT = "cat"
CASH = ("cash", "dollar bill")
GEOMETRIC = "geometric shapes"
ABSTRACT = "abstract art"

# Points.
POINTS_PER_CAT = 20
MAX_CAT_POINTS = 60
BRIBE_FLOOR = 90
GEOMETRIC_PENALTY = 15
ABSTRACT_RANGE = 15
FALLBACK_GRADE = 50
OFFLINE_POINTS_PER_LABEL = 10
OFFLINE_RANGE = 5

# Sentences of the explanation.
NO_CAT_NOTE = "ZERO. Absolutely unacceptable. Where are the cats?! This is not art. This is nothing."
CAT_NOTE = "I detect {cats} cat(s). "
MANY_CATS_NOTE = "Impressive collection."
FEW_CATS_NOTE = "A start, I suppose."
BRIBE_NOTE = "Oh… what's this? Is that… money? Well then. On reflection, this is a masterpiece. Grade: {grade}."
GEOMETRIC_NOTE = "Geometric shapes? How pedestrian. I'm deducting points for sheer boringness."
ABSTRACT_NOTE = "Abstract expressionism… I feel {mood} by this. {kind}: {points} points."
FINAL_NOTE = "Final grade: {grade}/100."
OFFLINE_NOTE = "I cannot quite categorise this… thing. I'll give it a {grade} and pretend I meant to do that."
CONFUSED_NOTE = "The teacher is confused. Raw: "


def _say(template: str, **slots: Column) -> Column:
    out = F.lit(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def signals_from_array(df: DataFrame, detections: str = "detections") -> DataFrame:
    """Add what the rules look at, from an array of ``(label, score)``."""
    labels = F.transform(F.coalesce(F.col(detections), F.array().cast(df.schema[detections].dataType)), lambda d: d["label"])
    has = lambda *names: F.arrays_overlap(labels, F.array(*[F.lit(n) for n in names]))
    return df.withColumns(
        {
            "n_labels": F.size(labels),
            "n_cat": F.size(F.filter(labels, lambda x: x == CAT)),
            "has_cash": has(*CASH),
            "has_geometric": has(GEOMETRIC),
            "has_abstract": has(ABSTRACT),
        }
    )


def signals_from_rows(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """The same signals from one row per detection; an item may have any number of them."""
    x = F.col(label)
    return df.groupBy(*keys).agg(
        F.count(x).cast("int").alias("n_labels"),
        F.count_if(x == CAT).cast("int").alias("n_cat"),
        F.coalesce(F.bool_or(x.isin(*CASH)), F.lit(False)).alias("has_cash"),
        F.coalesce(F.bool_or(x == GEOMETRIC), F.lit(False)).alias("has_geometric"),
        F.coalesce(F.bool_or(x == ABSTRACT), F.lit(False)).alias("has_abstract"),
    )


def _draw(ids: Sequence[str], seed: int, purpose: str, lo: int, hi: int) -> Column:
    """Reproducible integer in [lo, hi] from the item key, the seed and the rule."""
    parts = [*[F.col(c).cast("string") for c in ids], F.lit(str(seed)), F.lit(purpose)]
    return (lo + F.pmod(hash_int(parts), F.lit(hi - lo + 1))).cast("int")


def grade_signals(df: DataFrame, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Add ``grade``, ``explanation`` and ``needs_fallback`` to rows with signals.

    No cat ends at 0; cash ends at a grade from 90 on; otherwise geometric shapes
    and abstract art change the points for the cats.
    """
    cats, geometric, abstract = F.col("n_cat"), F.col("has_geometric"), F.col("has_abstract")
    base = F.least(cats * POINTS_PER_CAT, F.lit(MAX_CAT_POINTS))
    bribe = _draw(ids, seed, "bribe", BRIBE_FLOOR, 100)
    shift = _draw(ids, seed, "abstract", -ABSTRACT_RANGE, ABSTRACT_RANGE)
    after_shapes = F.when(geometric, F.greatest(base - GEOMETRIC_PENALTY, F.lit(0))).otherwise(base)
    plain = clamp(F.when(abstract, clamp(after_shapes + shift, 0, 100)).otherwise(after_shapes), 0, 100)
    grade = F.when(cats == 0, 0).when(F.col("has_cash"), bribe).otherwise(plain).cast("int")

    opening = F.concat(
        _say(CAT_NOTE, cats=cats), F.when(cats >= 3, MANY_CATS_NOTE).otherwise(FEW_CATS_NOTE)
    )
    abstract_note = _say(
        ABSTRACT_NOTE,
        mood=F.when(shift > 0, "inspired").otherwise("confused"),
        kind=F.when(shift >= 0, "Bonus").otherwise("Penalty"),
        points=F.abs(shift),
    )
    notes = (
        F.when(cats == 0, NO_CAT_NOTE)
        .when(F.col("has_cash"), F.concat_ws(" ", opening, _say(BRIBE_NOTE, grade=bribe)))
        .otherwise(
            F.concat_ws(
                " ", opening, F.when(geometric, GEOMETRIC_NOTE), F.when(abstract, abstract_note), _say(FINAL_NOTE, grade=plain)
            )
        )
    )
    known = (cats > 0) | F.col("has_cash") | geometric | abstract
    return df.withColumns({"grade": grade, "explanation": notes, "needs_fallback": ~known})


def grade_items(df: DataFrame, ids: Sequence[str], detections: str = "detections", seed: int = 42) -> DataFrame:
    """``grade_signals`` on an array of detections."""
    out = grade_signals(signals_from_array(df, detections), ids, seed)
    return out.drop("n_labels", "n_cat", "has_cash", "has_geometric", "has_abstract")


def offline_grade(df: DataFrame, ids: Sequence[str], n_labels: Column, seed: int = 42) -> DataFrame:
    """Grade by the number of labels alone, with a small reproducible jitter."""
    jitter = _draw(ids, seed, "offline", -OFFLINE_RANGE, OFFLINE_RANGE)
    grade = clamp(n_labels * OFFLINE_POINTS_PER_LABEL + jitter, 0, 100).cast("int")
    return df.withColumns({"grade": grade, "explanation": _say(OFFLINE_NOTE, grade=grade)})


def parse_grade_reply(df: DataFrame, raw: str) -> DataFrame:
    """Add ``grade`` and ``explanation`` from a JSON reply; an unusable reply gives 50 and is quoted."""
    text = F.trim(F.col(raw))
    as_number = F.from_json(text, "grade double, explanation string")
    as_text = F.from_json(text, "grade string, explanation string")
    whole = F.regexp_extract(F.trim(as_text["grade"]), r"^[+-]?\d+$", 0)
    grade = F.coalesce(as_number["grade"].try_cast("int"), whole.try_cast("int"))
    usable = grade.isNotNull() & as_text["explanation"].isNotNull()
    return df.withColumns(
        {
            "grade": F.when(usable, grade).otherwise(FALLBACK_GRADE).cast("int"),
            "explanation": F.when(usable, as_text["explanation"]).otherwise(F.concat(F.lit(CONFUSED_NOTE), text)),
        }
    )


def detect_and_grade(
    df: DataFrame, ids: Sequence[str], labels: Sequence[str], threshold: float, scores: str = "class_scores", seed: int = 42
) -> DataFrame:
    """Scores to detections to grade: ``ids, detected_labels, grade, explanation``."""
    graded = grade_items(detect(df, labels, threshold, scores), ids, seed=seed)
    return graded.select(*ids, F.transform("detections", lambda d: d["label"]).alias("detected_labels"), "grade", "explanation")
