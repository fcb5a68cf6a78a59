"""The most frequent keys of a counted table, without more than their number reaching the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def most_frequent(counts: DataFrame, size: int, n: str = "n") -> list[Row]:
    """Rows of ``counts`` from the largest ``n`` down, as many whole groups of equal ``n`` as fit into ``size``.

    A table of how many rows have each ``n`` gives the smallest ``n`` that is taken; only its rows are fetched.
    A sort with a limit would send ``size`` rows of every task to one place.
    """
    of_n = counts.groupBy(n).agg(F.count("*").alias("_rows"))
    upto = of_n.withColumn("_upto", F.sum("_rows").over(Window.orderBy(F.desc(n))))
    least = upto.where(F.col("_upto") <= size).agg(F.min(n)).first()[0]
    if least is None:
        return []
    return counts.where(F.col(n) >= least).collect()
