"""Stratified train / validation / test split and its data card."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limner.functions.numbers import round_exact
from limner.plans.joins import if_small, lookup_join
from limner.plans.ordering import hash_cuts, hash_histogram, hash_order, running_totals

SPLITS = ("train", "val", "test")


def class_quotas(counts: DataFrame, class_col: str, n: str, draws: int, total: int, out: str) -> DataFrame:
    """Add ``out``: the largest-remainder share of ``draws`` per class; ties go to the lower class.

    ``counts`` has one row per class and ``total`` is the sum of ``n``.
    """
    exact = F.col(n).cast("double") / F.lit(float(total)) * F.lit(float(draws))
    shares = counts.withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.col("_floor"))
    order = [F.desc("_rest"), F.col(class_col)]
    small = if_small(shares)
    if small is not None:
        every = Window.partitionBy(F.lit(0))
        ranked = small.withColumn("_rank", F.row_number().over(every.orderBy(*order))).withColumn(
            "_floors", F.sum("_floor").over(every)
        )
    else:
        ranked = running_totals(shares, order, {"_rank": F.lit(1), "_floors": "_floor"}).withColumn("_floors", F.col("_floors_all"))
    quota = F.col("_floor") + (F.col("_rank") <= draws - F.col("_floors")).cast("bigint")
    return ranked.select(*counts.columns, quota.alias(out))


def _key(id_col: str) -> Column:
    return F.struct(F.col("_hash").alias("h"), F.col(id_col).alias("i"))


def _bounds(df: DataFrame, id_col: str, cuts: DataFrame, names: Sequence[str], by: list[str], hist: DataFrame) -> DataFrame:
    """One row per class with the sort key at each named cut."""
    found = hash_cuts(df, "_hash", id_col, cuts, by, hist)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("cut") == n, _key(id_col))).alias(f"_{n}") for n in names])


def _draw_count(fraction: float, n: int) -> int:
    return math.ceil(fraction * n)


def stratified_split(
    df: DataFrame, id_col: str, class_col: str, val_frac: float = 0.1, test_frac: float = 0.1, seed: int = 42
) -> DataFrame:
    """Add ``split``: test is drawn first, then validation from the rest, the remainder is train.

    Inside a class the rows are ordered by an md5 of id and seed, so the split is
    the same at any layout. Rows are counted per class and hash bucket; the sort
    keys at which a class turns from test to validation to train are looked up,
    and assigning the split is a comparison. No class is ever sorted as a whole.
    A draw is not stratified when some class has a single row left.
    """
    if val_frac + test_frac >= 1:
        raise ValueError("val_frac + test_frac must be less than 1")
    rest_frac = val_frac / (1.0 - test_frac)
    keyed = df.withColumn("_hash", hash_order([id_col], seed))
    hist = hash_histogram(keyed, "_hash", [class_col])
    counts = hist.groupBy(class_col).agg(F.sum("_n").alias("_n"))
    sizes = counts.agg(F.sum("_n").alias("n"), F.min("_n").alias("smallest")).first()
    if not sizes["n"]:
        return df.withColumn("split", F.lit(None).cast("string"))
    n_test = _draw_count(test_frac, sizes["n"])
    if sizes["smallest"] >= 2:
        quotas = class_quotas(counts, class_col, "_n", n_test, sizes["n"], "_q_test")
        quotas = quotas.withColumn("_left", F.col("_n") - F.col("_q_test"))
        single = quotas.agg(F.count_if(F.col("_left") == 1)).first()[0]
        if not single:
            n_left = sizes["n"] - n_test
            return _split_both(keyed, id_col, class_col, quotas, _draw_count(rest_frac, n_left), n_left, hist)
    return _split_in_turn(keyed, id_col, class_col, test_frac, rest_frac)


def _split_both(
    keyed: DataFrame, id_col: str, class_col: str, quotas: DataFrame, n_val: int, n_left: int, hist: DataFrame
) -> DataFrame:
    """Both draws stratified: the validation rows of a class follow its test rows in the same order."""
    quotas = class_quotas(quotas, class_col, "_left", n_val, n_left, "_q_val")
    ends = {"test": F.col("_q_test"), "val": F.col("_q_test") + F.col("_q_val")}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), e.alias("rank")) for c, e in ends.items()]))
    cuts = quotas.select(class_col, each.alias("_cut")).select(class_col, "_cut.cut", "_cut.rank").filter("rank > 0")
    bounds = _bounds(keyed, id_col, cuts, list(ends), [class_col], hist)
    joined = lookup_join(keyed, bounds, [class_col], "left")
    key = _key(id_col)
    split = F.when(key <= F.col("_test"), "test").when(key <= F.col("_val"), "val").otherwise("train")
    return joined.withColumn("split", split).drop("_hash", "_test", "_val")


def _split_in_turn(keyed: DataFrame, id_col: str, class_col: str, test_frac: float, rest_frac: float) -> DataFrame:
    """One draw after the other; each decides for itself whether it can be stratified."""
    tested = _draw(keyed, id_col, class_col, test_frac, "test")
    rest = _draw(tested.filter(~F.col("test")), id_col, class_col, rest_frac, "val")
    split = F.when(F.col("val"), "val").otherwise("train")
    parts = rest.withColumn("split", split).drop("val")
    return parts.unionByName(tested.filter("test").withColumn("split", F.lit("test"))).drop("_hash", "test")


def _draw(df: DataFrame, id_col: str, class_col: str, fraction: float, flag: str) -> DataFrame:
    hist = hash_histogram(df, "_hash", [class_col])
    counts = hist.groupBy(class_col).agg(F.sum("_n").alias("_n"))
    sizes = counts.agg(F.sum("_n").alias("n"), F.min("_n").alias("smallest")).first()
    if not sizes["n"]:
        return df.withColumn(flag, F.lit(False))
    draws = _draw_count(fraction, sizes["n"])
    if sizes["smallest"] >= 2:
        by = [class_col]
        quotas = class_quotas(counts, class_col, "_n", draws, sizes["n"], "_q").filter("_q > 0")
        cuts = quotas.select(class_col, F.lit(flag).alias("cut"), F.col("_q").alias("rank"))
    else:
        by = []
        cuts = df.sparkSession.createDataFrame([(flag, draws)], "cut string, rank bigint")
        hist = hist.groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    bounds = _bounds(df, id_col, cuts, [flag], by, hist)
    if by:
        joined = lookup_join(df, bounds, by, "left")
    else:
        joined = df.withColumn(f"_{flag}", bounds.scalar())
    return joined.withColumn(flag, F.coalesce(_key(id_col) <= F.col(f"_{flag}"), F.lit(False))).drop(f"_{flag}")


def split_distribution(df: DataFrame, class_col: str, split: str = "split") -> DataFrame:
    """Rows per split and class."""
    return df.groupBy(split, class_col).agg(F.count("*").alias("count"))


def split_pivot(distribution: DataFrame, class_col: str, split: str = "split") -> DataFrame:
    """One row per class with a zero-filled column per split."""
    cells = [F.coalesce(F.sum(F.when(F.col(split) == s, F.col("count"))), F.lit(0)).alias(s) for s in SPLITS]
    return distribution.groupBy(class_col).agg(*cells)


def data_card(
    df: DataFrame,
    split: str = "split",
    dims: Sequence[str] = ("style", "genre", "artist"),
    maps: Sequence[str] = ("orientation", "style", "genre"),
) -> DataFrame:
    """Per split: rows, distinct classes, count maps with sorted keys, rounded means."""
    wanted = list(dict.fromkeys([*dims, *maps]))
    cells = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key")) for d in wanted])
    counted = (
        df.select(split, F.explode(cells).alias("_cell"))
        .groupBy(split, "_cell.dim", "_cell.key")
        .agg(F.count("*").alias("n"))
    )
    is_dim = lambda d: (F.col("dim") == d) & F.col("key").isNotNull()
    card = counted.groupBy(split).agg(
        *[F.count_if(is_dim(d)).alias(f"{d}s") for d in dims],
        *[_count_map_where(is_dim(m)).alias(f"{m}_counts") for m in maps],
    )
    means = df.groupBy(split).agg(
        F.count("*").alias("n"), F.avg("megapixels").alias("_mpix"), F.avg("bytes_size").alias("_bytes")
    )
    return means.join(F.broadcast(card), split).select(  # one row per split
        split,
        "n",
        *[f"{d}s" for d in dims],
        *[f"{m}_counts" for m in maps],
        round_exact(F.col("_mpix"), 4).alias("mean_megapixels"),
        round_exact(F.col("_bytes"), 0).alias("mean_bytes"),
    )


def _count_map_where(cond: Column) -> Column:
    """Sorted count map of one dimension; numeric class ids sort as numbers."""
    entry = F.struct(F.expr("try_cast(key AS BIGINT)").alias("num"), F.col("key").alias("key"), F.col("n").alias("n"))
    sorted_entries = F.array_sort(F.collect_list(F.when(cond, entry)))
    return F.map_from_entries(F.transform(sorted_entries, lambda e: F.struct(e["key"], e["n"])))


def check_split_partition(df: DataFrame, source: DataFrame, id_col: str, split: str = "split") -> DataFrame:
    """Counts of ids in several splits, ids missing from all splits, and ids the source lacks; all 0 if sound."""
    tagged = df.select(id_col, F.col(split).alias("_s")).unionByName(source.select(id_col, F.lit(None).alias("_s")))
    seen = tagged.groupBy(id_col).agg(
        F.count("_s").alias("placed"), F.count_if(F.col("_s").isNull()).alias("known")
    )
    return seen.agg(
        F.count_if(F.col("placed") > 1).alias("overlapping"),
        F.count_if(F.col("placed") == 0).alias("missing"),
        F.count_if(F.col("known") == 0).alias("unknown"),
        F.count_if((F.col("placed") == 1) & (F.col("known") > 0)).alias("sound"),
    )
