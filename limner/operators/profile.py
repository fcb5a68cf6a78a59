"""Profile of a labelled dataset: class balance, distributions, correlation, outliers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limner.functions.numbers import round_exact
from limner.plans.joins import if_small, lookup_join
from limner.plans.ordering import exact_quantiles, hash_cuts, hash_order, running_totals


def class_counts(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rows per class for several dimensions in one pass: ``dim, class_id, n``."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("class_id")) for d in dims])
    return (
        df.select(F.explode(pairs).alias("p")).groupBy("p.dim", "p.class_id").agg(F.count("*").alias("n"))
    )


def coverage(counts: DataFrame) -> DataFrame:
    """Distinct classes per dimension, exact."""
    return counts.groupBy("dim").agg(F.count("class_id").alias("classes"))


def approx_coverage(df: DataFrame, dims: Sequence[str], rsd: float = 0.02) -> DataFrame:
    """Distinct classes per dimension from sketches, when an estimate will do."""
    sketches = df.agg(*[F.approx_count_distinct(d, rsd).alias(d) for d in dims])
    rows = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("classes")) for d in dims])
    return sketches.select(F.inline(rows))


def normalized_entropy(counts: DataFrame) -> DataFrame:
    """Entropy of the class shares over its maximum: ``dim, entropy_norm``; 0 for one class."""
    # One row per dimension, and dimensions are columns of the input: bounded.
    totals = counts.groupBy("dim").agg(F.sum("n").alias("_total"), F.count("*").alias("_k"))
    p = F.col("n") / F.col("_total")
    return (
        counts.join(F.broadcast(totals), "dim")
        .groupBy("dim")
        .agg(F.sum(-p * F.ln(p + 1e-12)).alias("_h"), F.max("_k").alias("_k"))
        .select("dim", F.when(F.col("_k") <= 1, 0.0).otherwise(F.col("_h") / F.ln("_k")).alias("entropy_norm"))
    )


def gini(counts: DataFrame) -> DataFrame:
    """Gini coefficient of the class sizes: ``dim, gini``.

    Classes of the same size are folded into one row first; the window then runs
    over distinct sizes, of which a table of N rows has at most sqrt(2 N).
    """
    sizes = counts.groupBy("dim", "n").agg(F.count("*").alias("_m"))
    upto = Window.partitionBy("dim").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("_s", F.coalesce(F.sum("_m").over(upto), F.lit(0)))
    totals = counts.groupBy("dim").agg(F.sum("n").alias("_total"), F.count("*").alias("_k"))
    weight = F.col("n") * F.col("_m") * (2 * F.col("_s") + F.col("_m") - F.col("_k")).cast("double")
    return (
        ranked.join(F.broadcast(totals), "dim")
        .groupBy("dim")
        .agg(F.sum(weight).alias("_w"), F.max(F.col("_k") * F.col("_total")).alias("_d"))
        .select("dim", F.coalesce(F.try_divide("_w", "_d"), F.lit(0.0)).alias("gini"))
    )


def tail_counts(counts: DataFrame, limits: Sequence[int] = (20, 50, 100), threshold: int = 50) -> DataFrame:
    """Classes below each limit, and classes at or below ``threshold``."""
    below = [F.count_if(F.col("n") < k).alias(f"lt_{k}") for k in limits]
    return counts.groupBy("dim").agg(*below, F.count_if(F.col("n") <= threshold).alias("at_or_below_threshold"))


def top_share(counts: DataFrame) -> DataFrame:
    """Share of the largest class."""
    share = F.max("n") / F.greatest(F.sum("n"), F.lit(1))
    return counts.groupBy("dim").agg(share.alias("top_share"))


def class_balance(counts: DataFrame, threshold: int = 50) -> DataFrame:
    """One row per dimension: coverage, entropy, Gini, concentration and tail counts."""
    out = coverage(counts)
    for part in (normalized_entropy(counts), gini(counts), top_share(counts), tail_counts(counts, threshold=threshold)):
        out = out.join(F.broadcast(part), "dim")  # one row per dimension
    return out


def top_classes(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest classes of each dimension, with their rank."""
    w = Window.partitionBy("dim").orderBy(F.desc("n"), "class_id")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tail_classes(counts: DataFrame, threshold: int) -> DataFrame:
    """Classes with at most ``threshold`` rows."""
    return counts.filter(F.col("n") <= threshold)


def in_top_classes(df: DataFrame, class_col: str, k: int) -> DataFrame:
    """Rows whose class is among the ``k`` largest."""
    top = df.groupBy(class_col).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), class_col).limit(k)
    small = if_small(top.select(class_col), k)
    return df.join(F.broadcast(small) if small is not None else top.select(class_col), class_col, "left_semi")


def rank_frequency(counts: DataFrame) -> DataFrame:
    """Class sizes by rank with logarithms, per dimension."""
    ranked = running_totals(counts, [F.desc("n"), "class_id"], {"rank": F.lit(1)}, by=["dim"])
    return ranked.select(
        "dim", "rank", "n", F.ln(F.col("rank").cast("double")).alias("log_rank"), F.ln(F.col("n").cast("double")).alias("log_n")
    )


def numeric_profile(
    df: DataFrame, cols: Sequence[str], qs: Sequence[float] = (0.25, 0.5, 0.75, 0.95), exact: bool = True
) -> DataFrame:
    """min, max, mean and quantiles of each column: ``metric, min, max, mean, q25, ...``.

    Exact quantiles are found by range; ``exact=False`` reads them from sketches in one pass.
    """
    names = [f"q{round(q * 100):02d}" for q in qs]
    aggs = [F.struct(
        F.lit(c).alias("metric"),
        F.min(c).cast("double").alias("min"),
        F.max(c).cast("double").alias("max"),
        F.avg(c).alias("mean"),
        *([] if exact else [
            F.percentile_approx(F.col(c).cast("double"), [float(q) for q in qs], 100_000).alias("qs")
        ]),
    ).alias(c) for c in cols]
    basic = df.agg(*aggs).select(F.inline(F.array(*cols)))
    if not exact:
        return basic.select("metric", "min", "max", "mean", *[F.get("qs", F.lit(i)).alias(n) for i, n in enumerate(names)])
    found = exact_quantiles(df, cols, qs)
    wide = found.groupBy("metric").agg(
        *[F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(n) for q, n in zip(qs, names)]
    )
    return basic.join(F.broadcast(wide), "metric", "left")  # one row per column


def dims_profile(df: DataFrame, cols: Sequence[str] = ("width", "height")) -> DataFrame:
    """min, max and the mean at two decimals."""
    rows = [
        F.struct(F.lit(c).alias("metric"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean")).alias(c)
        for c in cols
    ]
    stats = df.agg(*rows).select(F.inline(F.array(*cols)))
    return stats.withColumn("mean_2", round_exact(F.col("mean"), 2))


def mix(df: DataFrame, col: str) -> DataFrame:
    """Count and share of each value."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / df.agg(F.count("*")).scalar())


def extremes(df: DataFrame) -> DataFrame:
    """Largest size and the two ends of the aspect ratio."""
    return df.agg(
        F.max("megapixels").alias("max_megapixels"),
        F.max("bytes_size").alias("max_bytes"),
        F.max("aspect_ratio").alias("max_aspect_ratio"),
        F.min("aspect_ratio").alias("min_aspect_ratio"),
    )


def quality_by_class(df: DataFrame, class_col: str) -> DataFrame:
    """Rows and mean quality features per class."""
    return df.groupBy(class_col).agg(
        F.count("*").alias("n"),
        F.avg("megapixels").alias("mean_megapixels"),
        F.avg("bytes_size").alias("mean_bytes"),
        F.avg("bytes_per_pixel").alias("mean_bpp"),
        F.avg("aspect_ratio").alias("mean_aspect"),
    )


def _co_moments(cols: Sequence[str]):
    """Of the rows of a task, per pair of columns: rows that have both, mean and spread of the first, co-moment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in cols])
            there = ~np.isnan(x)
            # shifted by a value of each column, so that a constant one has no spread at all
            shift = np.where(there.any(axis=0), x[there.argmax(axis=0), np.arange(len(cols))], 0.0)
            z = np.where(there, x - shift, 0.0)
            m = there.astype(np.float64)
            n, total = m.T @ m, z.T @ m
            some = np.maximum(n, 1)
            new = np.stack([n, shift[:, None] + total / some, (z * z).T @ m - total * total / some, z.T @ z - total * total.T / some])
            state = new if state is None else merged_co_moments(state, new)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"state": pa.array([state.ravel().tolist()], pa.list_(pa.float64()))})

    return run


def merged_co_moments(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The state of two sets of rows from the states of both."""
    n = one[0] + two[0]
    apart = np.where((one[0] > 0) & (two[0] > 0), two[1] - one[1], 0.0)
    weight = one[0] * two[0] / np.maximum(n, 1)
    mean = np.where(one[0] > 0, one[1], two[1]) + apart * two[0] / np.maximum(n, 1)
    return np.stack([n, mean, one[2] + two[2] + apart * apart * weight, one[3] + two[3] + apart * apart.T * weight])


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair: ``c1, c2, r``; NULL when a column is constant or a pair has less than two rows.

    One pass keeps a mergeable state for each pair: its rows, means, spreads and co-moment. Rows that miss either
    value of a pair (NULL or NaN) are in no state of it, so tables with and without them go through the same arithmetic. The driver merges one
    state for each task.
    """
    cols = list(cols)
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    k = len(cols)
    state = None
    for r in numbers.mapInArrow(_co_moments(cols), "state array<double>").collect():
        new = np.array(r.state).reshape(4, k, k)
        state = new if state is None else merged_co_moments(state, new)
    cells = []
    for (i, a), (j, b) in product(enumerate(cols), enumerate(cols)):
        spread = 0.0 if state is None or state[0, i, j] < 2 else float(np.sqrt(max(state[2, i, j], 0.0)) * np.sqrt(max(state[2, j, i], 0.0)))
        cells.append((a, b, float(state[3, i, j] / spread) if spread else None))
    return df.sparkSession.createDataFrame(cells, "c1 string, c2 string, r double")


def crosstab(df: DataFrame, row: str, col: str, values: Sequence, top_k: int | None = None) -> DataFrame:
    """Counts of ``row`` by the given values of ``col``, zero filled, on the largest rows only if asked."""
    base = df if top_k is None else in_top_classes(df, row, top_k)
    counted = base.groupBy(row, col).agg(F.count("*").alias("n"))
    cells = [F.coalesce(F.sum(F.when(F.col(col) == v, F.col("n"))), F.lit(0)).alias(str(v)) for v in values]
    return counted.groupBy(row).agg(*cells)


def outliers(df: DataFrame, by: str, tie: str, n: int = 100) -> DataFrame:
    """The ``n`` rows with the largest ``by``."""
    return df.orderBy(F.desc_nulls_last(by), tie).limit(n)


def _bounds(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    ends = df.agg(*[f(_finite(c)).alias(f"{f.__name__}_{c}") for c in cols for f in (F.min, F.max)]).first()
    return {c: (ends[f"min_{c}"], ends[f"max_{c}"]) for c in cols}


def _finite(c: str) -> Column:
    """The number in a column; NULL for NaN and infinite ones, which have no bin."""
    x = F.col(c).cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def _bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """0-based equal-width bin; the upper end belongs to the last bin."""
    if hi == lo:
        return F.lit(0)
    place = F.floor((x.cast("double") - lo) / ((hi - lo) / bins)).cast("int")
    return F.least(place, F.lit(bins - 1))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 60) -> DataFrame:
    """Rows per equal-width bin of the finite values of each column: ``metric, bin, lo, hi, n``; empty bins are left out."""
    spans = {c: s for c, s in _bounds(df, cols).items() if s[0] is not None}
    if not spans:
        return df.sparkSession.createDataFrame([], "metric string, bin int, lo double, hi double, n bigint")
    cells = [
        F.struct(
            F.lit(c).alias("metric"),
            F.when(_finite(c).isNotNull(), _bin(_finite(c), lo, hi, bins)).alias("bin"),
            F.lit(lo).alias("_lo"),
            F.lit((hi - lo) / bins).alias("_step"),
        )
        for c, (lo, hi) in spans.items()
    ]
    counts = (
        df.select(F.explode(F.array(*cells)).alias("c"))
        .filter("c.bin IS NOT NULL")
        .groupBy("c.metric", "c.bin", "c._lo", "c._step")
        .agg(F.count("*").alias("n"))
    )
    return counts.select(
        "metric",
        "bin",
        (F.col("_lo") + F.col("_step") * F.col("bin")).alias("lo"),
        (F.col("_lo") + F.col("_step") * (F.col("bin") + 1)).alias("hi"),
        "n",
    )


def density_2d(df: DataFrame, x: str, y: str, bins: int = 45) -> DataFrame:
    """Rows per cell of a square grid: ``x_bin, y_bin, n``."""
    spans = _bounds(df, [x, y])
    if spans[x][0] is None or spans[y][0] is None:
        return df.sparkSession.createDataFrame([], "x_bin int, y_bin int, n bigint")
    cells = [F.when(_finite(c).isNotNull(), _bin(_finite(c), *spans[c], bins)).alias(name) for c, name in ((x, "x_bin"), (y, "y_bin"))]
    return df.groupBy(*cells).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, group: str, value: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers inside ``whisker`` times the IQR, and outliers, per group."""
    found = exact_quantiles(df, [value], (0.25, 0.5, 0.75), by=[group])
    quart = found.groupBy(group).agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    reach = (F.col("q75") - F.col("q25")) * whisker
    inside = F.col("_v").between(F.col("q25") - reach, F.col("q75") + reach)
    joined = lookup_join(df.select(group, F.col(value).cast("double").alias("_v")), quart, [group])
    return joined.groupBy(group, "q25", "q50", "q75").agg(
        F.count("_v").alias("n"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """``min(n, N)`` rows drawn without replacement, the same ones at any layout."""
    keyed = df.withColumn("_hash", hash_order([id_col], seed))
    spark = df.sparkSession
    cut = spark.createDataFrame([("n", n)], "cut string, rank bigint")
    bound = hash_cuts(keyed, "_hash", id_col, cut).first()
    if bound is not None:  # the table holds at least n rows: keep all up to the n-th
        keyed = keyed.filter(
            (F.col("_hash") < bound["_hash"]) | ((F.col("_hash") == bound["_hash"]) & (F.col(id_col) <= F.lit(bound[id_col])))
        )
    return keyed.drop("_hash")


def audit_report(rows: DataFrame, decoded: DataFrame, bad: DataFrame | None = None, shard: str = "source_shard") -> DataFrame:
    """Shards, bad shards, rows, decoded images and decode errors in one row.

    ``rows`` names the shard of each row; ``bad`` has one row per shard that lost rows, and ``read_rows`` if some were read.
    """
    lost = rows.sparkSession.range(1).select(F.lit(0).alias("n"), F.lit(0).alias("silent"))
    if bad is not None:
        silent = F.count_if(F.coalesce("read_rows", F.lit(0)) == 0) if "read_rows" in bad.columns else F.count("*")
        lost = bad.agg(F.count("*").alias("n"), silent.alias("silent"))
    return decoded.agg(
        (rows.agg(F.count_distinct(shard)).scalar() + lost.select("silent").scalar()).cast("bigint").alias("shards"),
        lost.select("n").scalar().cast("bigint").alias("bad_shards"),
        F.count_if(F.col("error").isNull()).alias("decoded_images"),
        F.count_if(F.col("error").isNotNull()).alias("decode_errors"),
    ).withColumn("total_rows", rows.agg(F.count("*")).scalar())
