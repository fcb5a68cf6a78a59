"""Writers for predictions, tables, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limner.operators.scoring import scores_to_columns
from limner.sources.tables import path_exists


def write_predictions(
    df: DataFrame, path: str, names: Sequence[str], base: Sequence[str] = ("source_shard", "source_row_idx", "true_label", "pred_label"),
    scores: str = "class_scores", partition_by: Sequence[str] = (), mode: str = "error",
) -> None:
    """Wide prediction table: keys, labels and one score column per class in class order."""
    wide = scores_to_columns(df, [*partition_by, *base], names, scores)
    wide.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header row."""
    df.write.mode(mode).option("header", True).csv(path)


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "error") -> None:
    """One CSV folder per split below ``path``, in a single pass."""
    df.write.mode(mode).option("header", True).partitionBy(split).csv(path)


def write_document(df: DataFrame, path: str, mode: str = "error") -> None:
    """A one-row document as JSON; NULL fields are kept."""
    df.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_lines(lines: DataFrame, path: str, mode: str = "error") -> None:
    """A report with ``line_no, line`` as one text file; reports are short by nature."""
    lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode(mode).text(path)


def config_hash(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``config_hash``: an md5 of all parameters, so that a changed run is not taken for a finished one."""
    return df.withColumn("config_hash", F.md5(F.to_json(F.struct(*sorted(cols)))))


def write_manifest(df: DataFrame, path: str) -> None:
    """Append run manifest rows."""
    df.write.mode("append").parquet(path)


def read_manifest(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The manifest, or an empty table before the first run."""
    if not path_exists(spark, path):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(path)


def pending_work(work: DataFrame, done: DataFrame, keys: Sequence[str] = ("config_hash", "target", "model_id")) -> DataFrame:
    """Work items that no finished manifest row covers."""
    return work.join(done.select(*keys), list(keys), "left_anti")
