"""Summary documents and report lines built from one-row frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limner.functions.numbers import fixed, percent


def summary_document(spark: SparkSession, parts: Mapping[str, DataFrame | Column]) -> DataFrame:
    """One row with a field per part.

    A one-row frame becomes a struct (or a plain value if it has one column); a
    column is taken as it is. Each part stays a subquery of its own.
    """
    def field(part: DataFrame | Column) -> Column:
        if isinstance(part, Column):
            return part
        if len(part.columns) == 1:
            return part.scalar()
        return part.select(F.struct(*part.columns)).scalar()
    return spark.range(1).select(*[field(p).alias(name) for name, p in parts.items()])


def nested_counts(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Counted rows as one map with sorted keys; for classes and other bounded groups."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(n).alias("v"))))
    return counts.agg(F.map_from_entries(pairs).alias("counts"))


def nested_rows(df: DataFrame, order: Sequence[Column], cols: Sequence[str], limit: int | None = None) -> DataFrame:
    """The first ``limit`` rows as one array of structs, for top-k lists; all rows of a table that is bounded by its meaning."""
    top = df.orderBy(*order).limit(2**31 - 1 if limit is None else limit)  # a limit keeps the order
    return top.agg(F.collect_list(F.struct(*cols)).alias("rows"))


def report_lines(document: DataFrame, lines: Sequence[Column]) -> DataFrame:
    """``line_no, line`` rows of a report over a one-row document."""
    return document.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))


def bullet(label: str, value: Column, bold: bool = True) -> Column:
    """``- label: **value**``."""
    mark = "**" if bold else ""
    return F.concat(F.lit(f"- {label}: {mark}"), value.cast("string"), F.lit(mark))


def table_row(*cells: Column) -> Column:
    """One Markdown table row."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def thousands(x: Column) -> Column:
    """``47501`` as ``47,501``."""
    return fixed(x, 0, grouping=True)


def highlights(doc: DataFrame) -> DataFrame:
    """Highlight lines of a dataset profile (see ``limner.plans.profile_job``)."""
    c = F.col
    return report_lines(
        doc,
        [
            F.concat(F.lit("Total rows scanned: "), thousands(c("total_rows"))),
            F.concat(F.lit("Unique rows after exact hash dedupe: "), thousands(c("unique_rows"))),
            F.concat(
                F.lit("Exact duplicates removed: "), thousands(c("duplicate_rows")), F.lit(" ("), percent(c("duplicate_rate")), F.lit(")")
            ),
            F.concat(
                F.lit("Concentration: top_style_share="), percent(c("style.top_share")),
                F.lit(", top_genre_share="), percent(c("genre.top_share")),
            ),
            F.concat(F.lit("Imbalance (Gini): style="), fixed(c("style.gini"), 3), F.lit(", genre="), fixed(c("genre.gini"), 3)),
        ],
    )


def profile_report(doc: DataFrame) -> DataFrame:
    """All eight highlight lines of a full profile (``limner.plans.profile_job.full_profile_document``)."""
    c = F.col
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    whole = lambda name: c(name).cast("string")
    shares = [(d, percent(c(f"{d}.top_share"))) for d in ("style", "genre", "artist")]
    ginis = [(d, fixed(c(f"{d}.gini"), 3)) for d in ("style", "genre", "artist")]
    listed = lambda cells, form: F.concat_ws(", ", *[text(form.format(d), v) for d, v in cells])
    mixed = F.array_join(F.transform("orientation_unique", lambda x: F.concat(x["orientation"], F.lit("="), x["n"].cast("string"))), ", ")
    return report_lines(
        doc,
        [
            text("Total rows scanned: ", thousands(c("total_rows"))),
            text("Unique rows after exact hash dedupe: ", thousands(c("unique_rows"))),
            text("Exact duplicates removed: ", thousands(c("duplicate_rows")), " (", percent(c("duplicate_rate")), ")"),
            text(
                "Long-tail evidence (unique set): styles<50=", whole("style.lt_50"), ", styles<100=", whole("style.lt_100"), ", artists<20=", whole("artist.lt_20"),
            ),
            text("Orientation mix (unique set): ", mixed),
            text("Concentration: ", listed(shares, "top_{}_share=")),
            text("Imbalance (Gini): ", listed(ginis, "{}=")),
            text(
                "Extremes: max_megapixels=", fixed(c("extremes.max_megapixels"), 2), ", max_aspect=", fixed(c("extremes.max_aspect_ratio"), 2),
                ", min_aspect=", fixed(c("extremes.min_aspect_ratio"), 2),
            ),
        ],
    )


def best_model_lines(best: DataFrame) -> DataFrame:
    """Markdown table of the best row per target: ``target, line``."""
    return best.select(
        "target",
        table_row(
            F.col("target"), F.col("model_id"), fixed(F.col("top1_accuracy"), 4), fixed(F.col("top5_accuracy"), 4),
            fixed(F.col("images_per_second"), 2), fixed(F.col("elapsed_seconds"), 1),
        ).alias("line"),
    )
