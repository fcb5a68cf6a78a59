"""Global order without a global sort task.

Every helper here range-partitions on an ordering key, works inside each range,
and carries only one row per range between the ranges. No task ever sees more
than one range, whatever the size of the table or of its largest group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from limner.plans.joins import if_small
from limner.plans.staging import stage

_RANGE = "_range"


def _as_columns(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _range_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_totals(
    df: DataFrame,
    order: Sequence[str | Column],
    totals: Mapping[str, str | Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums and whole-group sums, in ``order`` inside each ``by`` group.

    For each ``name -> column`` in ``totals`` the result gains ``name`` (running
    sum up to and including the row) and ``name_all`` (sum over the group). Totals are whole numbers or doubles; a
    missing one counts as 0. ``order`` has to be unique inside a group; aggregate to that level first.

    Rows are shuffled once, to their range, where sums within the range are taken as the rows pass by in order. What
    comes before a range is added after it was written.
    """
    by = list(by)
    order_cols = _as_columns(order)
    values = {name: (F.col(c) if isinstance(c, str) else c) for name, c in totals.items()}
    kinds = dict(df.select(*[F.sum(c).alias(n) for n, c in values.items()]).dtypes)
    numbers = [F.coalesce(c, F.lit(0)).cast("double" if kinds[n] == "double" else "long").alias(f"_v_{n}") for n, c in values.items()]
    rows = (
        df.select("*", *numbers, (F.xxhash64(*by) if by else F.lit(0).cast("long")).alias("_g"))
        .repartitionByRange(_range_count(df), *_as_columns(by), *order_cols)
        .sortWithinPartitions(*_as_columns(by), *order_cols)
    )
    shape = StructType([*rows.schema.fields, *[StructField(f"_l_{n}", rows.schema[f"_v_{n}"].dataType) for n in values]])
    local = rows.mapInArrow(_prefix_sums(list(values)), shape).drop("_g")
    staged = stage(local.withColumn(_RANGE, F.spark_partition_id()), "ranges")

    # One row per (group, range): bounded by the number of ranges plus groups.
    blocks = staged.groupBy(*by, _RANGE).agg(*[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in values])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *[F.col(c).alias(f"_k_{c}") for c in [*by, _RANGE]],
        *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values],
        *[F.sum(f"_b_{n}").over(group).alias(f"{n}_all") for n in values],
    )
    on = None
    for c in [*by, _RANGE]:
        same = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        on = same if on is None else on & same
    return staged.join(offsets, on).select(
        *df.columns,
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in values],
        *[f"{n}_all" for n in values],
    )


def _prefix_sums(names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to sorted batches the running sums ``_l_name`` of ``_v_name`` since the last change of ``_g``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, carried = None, dict.fromkeys(names, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("_g").to_numpy()
            starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if group is not None and keys[0] != group:
                carried = dict.fromkeys(names, 0)
            added = []
            for name in names:
                x = batch.column(f"_v_{name}").to_numpy().copy()
                x[0] += carried[name]
                if x.dtype.kind == "i":
                    total = np.cumsum(x)
                    total -= np.repeat(np.concatenate(([0], total[starts - 1])), np.diff(np.concatenate(([0], starts, [len(x)]))))
                else:  # each group on its own, so that no digit of another one gets in
                    total = np.concatenate([np.cumsum(part) for part in np.split(x, starts)])
                carried[name] = total[-1]
                added.append(pa.array(total))
            group = keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *[f"_l_{n}" for n in names]])

    return run


def dense_index(df: DataFrame, order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """Number the rows 0..n-1 in ``order`` (which has to be unique)."""
    order_cols = _as_columns(order)
    mono = F.monotonically_increasing_id()
    staged = stage(
        df.repartitionByRange(_range_count(df), *order_cols)
        .sortWithinPartitions(*order_cols)
        .select("*", F.spark_partition_id().alias(_RANGE), mono.alias("_mono")),
        "index",
    )
    # Never more rows than there are ranges, so the broadcast below is bounded.
    ranges = (
        staged.groupBy(_RANGE).agg(F.count("*").alias("n"), F.min("_mono").alias("base")).orderBy(_RANGE).collect()
    )
    start, shifts = 0, []
    for r in ranges:
        shifts.append((r[_RANGE], start - r["base"]))
        start += r["n"]
    shift_df = df.sparkSession.createDataFrame(shifts, f"{_RANGE} int, _shift long")
    return staged.join(F.broadcast(shift_df), _RANGE).select(
        *df.columns, (F.col("_mono") + F.col("_shift")).alias(name)
    )


#: Size of a sketch: its ranks are within about ``SKETCH_ERROR`` of the true ones, nearly always.
SKETCH_K = 2_048
SKETCH_ERROR = 0.002


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    qs: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact linearly interpolated quantiles: ``by, metric, q, value``; NULL and NaN count for nothing.

    One scan builds a mergeable sketch for each group and metric, which brackets every wanted rank by two values.
    A second scan counts the values between the brackets in bulk and those inside one by one, so that the
    ranks come out exactly. A rank that its bracket does not hold is looked for among all values of its group. The same
    two scans serve any number of groups. Stage an input that is costly to compute.
    """
    by, cols = list(by), list(cols)
    keys = [*by, "metric"]
    sketched = stage(_sketches(df, cols, qs, by), "sketches")
    ends = stage(_ranked_ends(_counted(df, cols, by, sketched, len(qs)), sketched, keys), "quantiles")
    lost = ends.where("a IS NULL OR b IS NULL").select(*keys).distinct()
    if not lost.isEmpty():
        whole = F.array(F.struct(F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")))
        again = sketched.alias("s").join(lost.alias("l"), _same(keys, "s", "l"), "left_semi").withColumn("brackets", whole)
        again = stage(again, "brackets")
        found = _ranked_ends(_counted(df, cols, by, again, 1), again, keys)
        ends = ends.alias("s").join(lost.alias("l"), _same(keys, "s", "l"), "left_anti").unionByName(found)
    return ends.select(*keys, "q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("t")).alias("value"))


def _number(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def _sketches(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: list[str]) -> DataFrame:
    """``by, metric, n, wanted, brackets``: the wanted ranks with their weights, and disjoint ascending intervals that should hold them."""
    parts = [f(_number(c)).alias(f"{name}|{i}") for i, c in enumerate(cols) for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max), ("kll", _sketch))]
    wide = df.groupBy(*by).agg(*parts)
    cells = [F.struct(F.lit(c).alias("metric"), *[F.col(f"{x}|{i}").alias(x) for x in ("n", "lo", "hi", "kll")]) for i, c in enumerate(cols)]
    long = wide.select(*by, F.inline(F.array(*cells))).where("n > 0")
    last = (F.col("n") - 1).cast("double")
    wanted = [F.struct(F.lit(float(q)).alias("q"), F.floor(F.lit(float(q)) * last).alias("low"), F.ceil(F.lit(float(q)) * last).alias("high"), (F.lit(float(q)) * last - F.floor(F.lit(float(q)) * last)).alias("t")) for q in qs]
    # a bracket reaches from somewhat below the lower rank to somewhat above the upper one, beyond an end of the sketch to the end
    # of the values; so few values that the slack is no whole rank are all in one
    ends = [(max(0.0, float(q) - SKETCH_ERROR), min(1.0, float(q) + SKETCH_ERROR)) for q in qs]
    read = long.withColumns({f"_{i}": F.kll_sketch_get_quantile_double("kll", F.lit([e[i] for e in ends])) for i in (0, 1)})
    pairs = [
        F.struct((F.col("lo") if low <= 0 else F.get("_0", F.lit(k))).alias("lo"), (F.col("hi") if high >= 1 else F.get("_1", F.lit(k))).alias("hi"))
        for k, (low, high) in enumerate(ends)
    ]
    few = F.col("n") <= 2 / max(SKETCH_ERROR, 1e-6)
    brackets = F.when(few, F.array(F.struct("lo", "hi"))).otherwise(_merged(F.array(*pairs)))
    return read.select(*by, "metric", "n", F.array(*wanted).alias("wanted"), brackets.alias("brackets"))


def _sketch(x: Column) -> Column:
    return F.kll_sketch_agg_double(x, SKETCH_K)


def _merged(pairs: Column) -> Column:
    """Intervals in ascending order, those that touch made one."""

    def add(done: Column, new: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], new["hi"]).alias("hi"))))
        return F.when(F.size(done) == 0, F.array(new)).when(new["lo"] <= last["hi"], joined).otherwise(F.concat(done, F.array(new)))

    return F.aggregate(F.array_sort(pairs), F.lit([]).cast("array<struct<lo:double,hi:double>>"), add)


def _counted(df: DataFrame, cols: Sequence[str], by: list[str], brackets: DataFrame, width: int) -> DataFrame:
    """``by, metric, slot, value, n``: rows with each value inside a bracket, and, without a value, those in front of bracket number ``slot``."""
    # the ends of the brackets as columns, so that finding a value's place is plain comparisons
    ends = [(i, c, j) for i, c in enumerate(cols) for j in range(width)]
    sides = [F.max(F.when(F.col("metric") == c, F.get("brackets", F.lit(j))[side])).alias(f"_{side}{i}_{j}") for i, c, j in ends for side in ("lo", "hi")]
    groups = _hinted(brackets.groupBy(*by).agg(*sides)).alias("b")
    rows = df.select(*by, *[_number(c).alias(f"_x{i}") for i, c in enumerate(cols)]).alias("s")
    bounds = [f"_{side}{i}_{j}" for i, _, j in ends for side in ("lo", "hi")]
    joined = rows.join(groups, _same(by, "s", "b"), "inner").select(*[F.col(f"s.{k}").alias(k) for k in by], *[f"_x{i}" for i in range(len(cols))], *bounds)

    def cell(i: int, c: str) -> Column:
        x = F.col(f"_x{i}")
        slot, inside = F.lit(0), F.lit(False)
        for j in range(width):
            lo, hi = F.col(f"_lo{i}_{j}"), F.col(f"_hi{i}_{j}")
            slot = slot + F.when(hi < x, 1).otherwise(0)
            inside = inside | F.coalesce((lo <= x) & (x <= hi), F.lit(False))
        return F.struct(F.lit(c).alias("metric"), slot.alias("slot"), F.when(inside, x).alias("value"), (x.isNotNull() & F.col(f"_lo{i}_0").isNotNull()).alias("is"))

    cells = joined.select(*by, F.inline(F.array(*[cell(i, c) for i, c in enumerate(cols)]))).where(F.col("is"))
    return cells.groupBy(*by, "metric", "slot", "value").agg(F.count("*").alias("n"))


def _ranked_ends(counted: DataFrame, sketched: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, q, a, b, t``: the values at the two ranks that each quantile lies between; NULL where a bracket does not hold the rank."""
    ranked = running_totals(counted, ["slot", F.asc_nulls_first("value")], {"upto": F.col("n")}, by=keys)
    spots = sketched.select(*keys, F.inline("wanted"))
    first = F.col("upto") - F.col("r.n")
    met = ranked.alias("r").join(_hinted(spots).alias("w"), _same(keys, "r", "w"))
    at_low, at_high = ((first <= F.col(x)) & (F.col(x) < F.col("upto")) for x in ("low", "high"))
    hits = met.where(at_low | at_high).groupBy(*[F.col(f"w.{k}").alias(k) for k in keys], "q")
    return hits.agg(F.max(F.when(at_low, F.col("value"))).alias("a"), F.max(F.when(at_high, F.col("value"))).alias("b"), F.max("t").alias("t"))


def hash_order(id_cols: Sequence[str], seed: int) -> Column:
    """Reproducible pseudo-random sort key: md5 of the id and the seed, joined by ``|``."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed))))


def hash_int(parts: Sequence[Column], digits: int = 8) -> Column:
    """Non-negative integer from the first hex digits of an md5 over ``parts``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, digits), 16, 10).cast("bigint")


def _hinted(df: DataFrame) -> DataFrame:
    """Broadcast a table that is proven small; leave a larger one to a shuffle join."""
    small = if_small(df)
    return df if small is None else F.broadcast(small)


_BUCKET_DIGITS = 4  # 65,536 buckets


def hash_histogram(df: DataFrame, hash_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per hash bucket and group, written once because several passes read it."""
    return stage(df.groupBy(*by, _bucket(hash_col).alias("_bucket")).agg(F.count("*").alias("_n")), "histogram")


def _bucket(hash_col: str) -> Column:
    """The first hex digits themselves: they sort like the numbers they write."""
    return F.substring(hash_col, 1, _BUCKET_DIGITS)


def hash_cuts(
    df: DataFrame,
    hash_col: str,
    tie: str,
    cuts: DataFrame,
    by: Sequence[str] = (),
    hist: DataFrame | None = None,
) -> DataFrame:
    """Sort keys found at given ranks of the hash order, per group.

    ``cuts`` holds ``by..., cut, rank`` with 1-based ranks; the result holds
    ``by..., cut, hash, tie`` for every rank that exists. Rows are counted per
    hash bucket; only the one bucket that contains a cut is ranked row by row.
    """
    by = list(by)
    cuts = _hinted(cuts)
    hist = hash_histogram(df, hash_col, by) if hist is None else hist
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("_upto", F.sum("_n").over(upto))
    before = F.col("_upto") - F.col("_n")
    holds = (before < F.col("rank")) & (F.col("rank") <= F.col("_upto"))
    for c in by:
        holds = holds & cum[c].eqNullSafe(cuts[c])
    # One row per (group, cut): as many rows as ``cuts`` itself.
    wanted = cum.join(cuts, holds).select(
        *[cum[c].alias(f"_k_{c}") for c in by],
        F.col("_bucket").alias("_k_bucket"),
        "cut",
        (F.col("rank") - before).alias("_need"),
    )
    wanted = _hinted(wanted)
    match = _bucket(hash_col) == F.col("_k_bucket")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    rank = F.row_number().over(Window.partitionBy(*by, "cut").orderBy(hash_col, tie))
    return (
        df.select(*by, hash_col, tie)
        .join(wanted, match)
        .withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_need"))
        .select(*by, "cut", hash_col, tie)
    )
