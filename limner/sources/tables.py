"""Small tables: indexes, configuration, metadata, cached results."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_index(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Index or split table in CSV with a header row."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_config_list(spark: SparkSession, path: str, field: str, name: str = "value") -> DataFrame:
    """A list field of a JSON document as ``position, value`` rows."""
    schema = T.StructType([T.StructField(field, T.ArrayType(T.StringType()))])
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode(field).alias("position", name))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it belongs to."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def read_meta(spark: SparkSession, path: str) -> dict:
    """First record of a JSON document; ``{}`` when the file is missing."""
    if not path_exists(spark, path):
        return {}
    row = spark.read.option("multiLine", True).json(path).first()
    return {} if row is None else row.asDict(recursive=True)


def resolve_defaults(given: Mapping[str, str | None], meta: Mapping, defaults: Mapping) -> dict:
    """For each default: the given value if not empty, else the stored one, else the default."""
    return {k: given.get(k) or meta.get(k) or v for k, v in defaults.items()}


def resolve_defaults_columns(df: DataFrame, given: Mapping[str, str | None], defaults: Mapping[str, str]) -> DataFrame:
    """The same on a table of metadata rows: one output column per default."""
    def pick(name: str, fallback: str):
        stored = F.nullif(F.col(name), F.lit("")) if name in df.columns else F.lit(None).cast("string")
        return F.coalesce(F.nullif(F.lit(given.get(name)).cast("string"), F.lit("")), stored, F.lit(fallback))
    return df.withColumns({k: pick(k, v) for k, v in defaults.items()})


def materialize_once(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at ``path`` if a finished one is there, else compute, write and read it.

    Only the ``_SUCCESS`` marker counts as finished, so a write that died half-way is redone.
    """
    if not path_exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
