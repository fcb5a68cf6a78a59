"""Coverage and distributions from sketches that are stored by shard and merged.

One row per shard and column holds a sketch of its distinct values or of its numbers. Sketches merge without loss, so a new
shard only adds its own rows, and any set of shards is summed up without reading data again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base-2 logarithm of the number of registers, and the standard error this gives.
HLL_LG_K = 12
HLL_ERROR = 0.026
KLL_K = 2_048
#: Ranks of a sketch of that size are off by less than this share of all rows, nearly always.
KLL_ERROR = 0.002


def shard_sketches(df: DataFrame, dims: Sequence[str], numbers: Sequence[str], shard: str) -> DataFrame:
    """``shard, column, n, lo, hi, distinct, ranks``: sketches of the values of ``dims`` and of the finite or infinite ``numbers``.

    One scan; missing values and NaN are in no sketch. A shard without a value of a column has a NULL sketch of it.
    """
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numbers}
    parts = [f for i, c in enumerate(dims) for f in (F.count(c).alias(f"dn{i}"), F.hll_sketch_agg(F.col(c).cast("string"), HLL_LG_K).alias(f"d{i}"))]
    parts += [f for i, c in enumerate(numbers) for f in (F.count(x[c]).alias(f"nn{i}"), F.min(x[c]).alias(f"lo{i}"), F.max(x[c]).alias(f"hi{i}"), F.kll_sketch_agg_double(x[c], KLL_K).alias(f"k{i}"))]
    none = F.lit(None)
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"dn{i}").alias("n"), none.cast("double").alias("lo"), none.cast("double").alias("hi"), F.when(F.col(f"dn{i}") > 0, F.col(f"d{i}")).alias("distinct"), none.cast("binary").alias("ranks"))
        for i, c in enumerate(dims)
    ] + [
        F.struct(F.lit(c).alias("column"), F.col(f"nn{i}").alias("n"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), none.cast("binary").alias("distinct"), F.when(F.col(f"nn{i}") > 0, F.col(f"k{i}")).alias("ranks"))
        for i, c in enumerate(numbers)
    ]
    return df.groupBy(F.col(shard).alias("shard")).agg(*parts).select("shard", F.inline(F.array(*cells)))


def add_new_shards(stored: DataFrame, df: DataFrame, dims: Sequence[str], numbers: Sequence[str], shard: str) -> DataFrame:
    """``stored`` with the sketches of the shards of ``df`` that it does not have; rows of known shards are not sketched again."""
    new = df.join(stored.select(F.col("shard").alias(shard)).distinct(), shard, "left_anti")
    return stored.unionByName(shard_sketches(new, dims, numbers, shard))


def merged_coverage(stored: DataFrame) -> DataFrame:
    """``dim, classes``: estimated distinct values of each dimension, over all shards of ``stored``."""
    merged = stored.where("distinct IS NOT NULL").groupBy(F.col("column").alias("dim")).agg(F.hll_union_agg("distinct").alias("_s"))
    return merged.select("dim", F.hll_sketch_estimate("_s").alias("classes"))


def merged_profile(stored: DataFrame, qs: Sequence[float] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """``metric, n, min, max, q25, ...`` of each number, over all shards of ``stored``; quantiles are within ``KLL_ERROR`` of their rank."""
    names = [f"q{round(q * 100):02d}" for q in qs]
    merged = stored.where("ranks IS NOT NULL").groupBy(F.col("column").alias("metric")).agg(
        F.sum("n").alias("n"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.kll_merge_agg_double("ranks").alias("_s")
    )
    found = merged.withColumn("_q", F.kll_sketch_get_quantile_double("_s", F.lit([float(q) for q in qs])))
    return found.select("metric", "n", "min", "max", *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)])
