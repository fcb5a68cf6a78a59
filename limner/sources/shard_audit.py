"""A data source that reads parquet shards row group by row group and says what each of them holds or has lost.

One partition per file: the footer is read first, then each row group once. A file without a sound footer is one
row; a row group with a damaged page gives the range of its rows and the columns that are still sound. Whatever
the files hold, one pass over them answers how many rows there are, which are lost and where.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from limner.plans.ordering import running_totals

SCHEMA = "path string, length long, row_group int, first_row long, n_rows long, error string, lost_columns array<string>"
_ARROW = pa.schema(
    [("path", pa.string()), ("length", pa.int64()), ("row_group", pa.int32()), ("first_row", pa.int64()), ("n_rows", pa.int64()), ("error", pa.string()), ("lost_columns", pa.list_(pa.string()))]
)
NO_FOOTER, DAMAGED = "no parquet footer", "damaged pages"


@dataclass
class ShardFile(InputPartition):
    path: str
    length: int


class ShardAudit(DataSource):
    """Options: ``path``, a folder or file of any store that Arrow opens by its address; ``glob`` of file names; ``columns``, joined by commas."""

    @classmethod
    def name(cls) -> str:
        return "shard_audit"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.glob = options["path"], options.get("glob", "*.parquet")
        self.columns = [c for c in options.get("columns", "").split(",") if c]

    def partitions(self) -> list[ShardFile]:
        store, root = pf.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (pf.LocalFileSystem(), self.root)
        found = store.get_file_info(pf.FileSelector(root, recursive=True)) if store.get_file_info(root).type == pf.FileType.Directory else [store.get_file_info(root)]
        files = [f for f in found if f.type == pf.FileType.File and fnmatch.fnmatch(f.base_name, self.glob)]
        return [ShardFile(f.path, f.size) for f in sorted(files, key=lambda f: f.path)]

    def read(self, partition: ShardFile) -> Iterator[pa.RecordBatch]:
        store = pf.FileSystem.from_uri(self.root)[0] if "://" in self.root or self.root.startswith("file:") else pf.LocalFileSystem()
        rows = []

        def row(group, first, n, error=None, lost=()):
            rows.append({"path": partition.path, "length": partition.length, "row_group": group, "first_row": first, "n_rows": n, "error": error, "lost_columns": list(lost)})

        try:
            file = pq.ParquetFile(store.open_input_file(partition.path), page_checksum_verification=True)
        except (pa.ArrowException, OSError):
            row(None, None, None, NO_FOOTER)
        else:
            names = self.columns or file.schema_arrow.names
            first = 0
            for group in range(file.num_row_groups):
                n = file.metadata.row_group(group).num_rows
                lost = [] if _reads(file, group, names, n) else [c for c in names if not _reads(file, group, [c], n)]
                row(group, first, n, DAMAGED if lost else None, lost)
                first += n
            if not file.num_row_groups:
                row(None, 0, 0)
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _reads(file: pq.ParquetFile, group: int, columns: list[str], n: int) -> bool:
    """Whether a row group gives all its rows, batch by batch and without keeping them."""
    try:
        return sum(b.num_rows for b in file.iter_batches(row_groups=[group], columns=columns)) == n
    except (pa.ArrowException, OSError, UnicodeDecodeError):
        return False


def audit_shards(spark: SparkSession, root: str, columns: list[str] | None = None, glob: str = "*.parquet") -> DataFrame:
    """``path, length, row_group, first_row, n_rows, error, lost_columns``: a row for each row group of each shard below ``root``.

    ``error`` is NULL for sound row groups, ``damaged pages`` with the columns that cannot be read, or, once for a file
    whose footer cannot be read, ``no parquet footer`` with unknown rows. A file without row groups is a row of no rows.
    """
    spark.dataSource.register(ShardAudit)
    return spark.read.format("shard_audit").option("path", root).option("glob", glob).option("columns", ",".join(columns or ())).load()


def lost_ranges(audit: DataFrame) -> DataFrame:
    """``path, error, first_row, end_row``: what is lost, adjacent row groups of one file as one range; NULL rows for whole files."""
    lost = audit.where("error IS NOT NULL")
    # an island of adjacent groups has one difference of number and place
    ranked = running_totals(lost.where("row_group IS NOT NULL"), ["row_group"], {"_place": F.lit(1)}, by=["path"])
    islands = ranked.groupBy("path", "error", (F.col("row_group") - F.col("_place")).alias("_island"))
    ranges = islands.agg(F.min("first_row").alias("first_row"), F.max(F.col("first_row") + F.col("n_rows")).alias("end_row")).drop("_island")
    return ranges.unionByName(lost.where("row_group IS NULL").select("path", "error", F.lit(None).cast("long").alias("first_row"), F.lit(None).cast("long").alias("end_row")))


def damaged_shards(audit: DataFrame) -> DataFrame:
    """``path, length, error, expected_rows, read_rows`` of files that are not whole, in the columns of ``shards.bad_shards``."""
    sound = F.col("error").isNull()
    out = audit.groupBy("path", "length").agg(
        F.max("error").alias("error"), F.sum("n_rows").alias("expected_rows"), F.coalesce(F.sum(F.when(sound, F.col("n_rows"))), F.lit(0)).alias("read_rows")
    )
    return out.where("error IS NOT NULL")


def local_shards(root: str, part: str) -> list[str]:
    """Parquet files below a folder of this machine's disk whose path has ``part`` as a folder."""
    return sorted(str(p) for p in Path(root).rglob("*.parquet") if part in p.parts)


def break_a_page(path: str, group: int = 0) -> None:
    """Overwrite some bytes in the middle of the first column's data of a row group of a file on this machine's disk, for tests of the audit."""
    column = pq.ParquetFile(path).metadata.row_group(group).column(0)
    with open(path, "r+b") as f:
        begin = min(column.data_page_offset, column.dictionary_page_offset or column.data_page_offset)
        f.seek((column.data_page_offset + begin + column.total_compressed_size) // 2)
        f.write(b"\xff" * 16)


def break_pages(path: str) -> None:
    """``break_a_page`` in every row group of a file."""
    for group in range(pq.ParquetFile(path).metadata.num_row_groups):
        break_a_page(path, group)


def cut_the_footer(path: str) -> None:
    """Take the last bytes of a file on this machine's disk, for tests of the audit."""
    with open(path, "r+b") as f:
        f.truncate(max(0, Path(path).stat().st_size - 6))
