"""Parquet shards: scan with a row locator, footprint, unreadable files, payload fields."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limner.plans.joins import if_small, lookup_join
from limner.plans.ordering import running_totals
from limner.plans.staging import stage
from limner.schemas import require_columns


def read_shards(
    spark: SparkSession, root: str, schema: T.StructType, columns: Sequence[str] | None = None,
    tolerant: bool = False, glob: str = "*.parquet",
) -> DataFrame:
    """All shards below ``root`` with ``source_shard`` and ``source_row_idx``.

    The locator comes from the scan itself, so no row has to be counted.
    ``tolerant`` skips unreadable files; ``bad_shards`` names them.
    """
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    rows = reader.option("ignoreCorruptFiles", tolerant).parquet(root)
    keep = schema.fieldNames() if columns is None else list(columns)
    return require_columns(rows, keep).select(
        F.col("_metadata.file_path").alias("source_shard"), F.col("_metadata.row_index").alias("source_row_idx"), *keep
    )


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``path, length`` of every file below ``root``, with the paths of the scans; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select(F.col("_metadata.file_path").alias("path"), "length")


def dataset_footprint(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """Number of shards and bytes of all files below ``root``; raises when there is no shard."""
    suffix = glob.lstrip("*")
    out = list_files(spark, root).agg(
        F.count_if(F.endswith("path", F.lit(suffix))).alias("shards"), F.sum("length").alias("disk_size_bytes")
    )
    if not out.first()["shards"]:
        raise FileNotFoundError(f"no {glob} below {root}")
    return out


#: Files opened by one scan.
_OPENED_AT_ONCE = 10_000


def bad_shards(
    spark: SparkSession, root: str, schema: T.StructType, glob: str = "*.parquet", columns: Sequence[str] | None = None
) -> DataFrame:
    """``path, length, error, expected_rows, read_rows`` of files that cannot be read whole as parquet.

    The rows that each file's footer promises are compared with those a tolerant scan of ``columns`` (all by
    default) returns, so damaged pages behind a sound footer are found too. Only files without any row are
    opened, to tell an empty table (its file ends with ``PAR1``) from a broken one.
    """
    names = schema.fieldNames() if columns is None else list(columns)
    expected = read_shards(spark, root, schema, [], tolerant=True, glob=glob).groupBy("source_shard").agg(F.count("*").alias("expected_rows"))
    # a digest of the values, so that the pages are decoded and not only counted
    whole = F.when(F.bit_xor(F.xxhash64(*names)).isNotNull(), F.count("*"))
    read = read_shards(spark, root, schema, names, tolerant=True, glob=glob).groupBy("source_shard").agg(whole.alias("read_rows"))
    files = list_files(spark, root, glob)
    seen = files.join(expected, files["path"] == expected["source_shard"], "left").drop("source_shard")
    seen = seen.join(read, seen["path"] == read["source_shard"], "left").drop("source_shard")
    lost = seen.filter(F.coalesce("read_rows", F.lit(0)) < F.coalesce("expected_rows", F.lit(0)))
    damaged = lost.select("path", "length", F.lit("damaged pages").alias("error"), "expected_rows", F.coalesce("read_rows", F.lit(0)).alias("read_rows"))
    silent = seen.filter(F.col("expected_rows").isNull()).select("path", "length")
    paths, out = [], damaged
    for row in silent.toLocalIterator():
        paths.append(row["path"])
        if len(paths) == _OPENED_AT_ONCE:
            out, paths = out.union(_not_parquet(spark, paths)), []
    return out.union(_not_parquet(spark, paths)) if paths else out


def _not_parquet(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    opened = spark.read.format("binaryFile").load(list(paths))
    broken = opened.filter((F.col("length") < 8) | (F.substring("content", -4, 4) != F.lit(b"PAR1")))
    return broken.select("path", "length", F.lit("not a parquet file"), F.lit(None).cast("long"), F.lit(0).cast("long"))


def shard_row_counts(rows: DataFrame) -> DataFrame:
    """Rows per shard."""
    return rows.groupBy("source_shard").agg(F.count("*").alias("n_rows"))


def shard_of(path: Column) -> Column:
    """The shard a file belongs to: the file itself, or the folder ``<name>.parquet`` around the part files of one shard."""
    return F.regexp_replace(path, r"^(.*\.parquet)/.*$", "$1")


def part_starts(rows: DataFrame) -> DataFrame:
    """``source_shard, first_row`` of each file of ``read_shards``: the rows in the parts of its shard before it, in the order of their paths."""
    counts = shard_row_counts(rows).withColumn("_shard", shard_of(F.col("source_shard")))
    upto = running_totals(counts, ["source_shard"], {"_upto": "n_rows"}, by=["_shard"])
    return upto.select("source_shard", (F.col("_upto") - F.col("n_rows")).alias("first_row"))


def whole_shards(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows, or a stream of them, with the locator counted through all parts of a shard, given ``part_starts``.

    A row of a file that ``starts`` does not know yet has no position.
    """
    placed = rows.join(starts, "source_shard", "left") if rows.isStreaming else lookup_join(rows, starts, ["source_shard"], "left")
    here = {"source_shard": shard_of(F.col("source_shard")), "source_row_idx": F.col("source_row_idx") + F.col("first_row")}
    return placed.select(*[here[c].alias(c) if c in here else c for c in rows.columns])


def plain_path(path: Column) -> Column:
    """Path without its ``file:`` scheme, so that stored and listed paths compare equal."""
    return F.regexp_replace(path, r"^file:/+", "/")


def normalize_payload(df: DataFrame, files_root: str | None = None, image: str = "image", out: str = "image_bytes") -> DataFrame:
    """Add ``out``: the bytes in the image struct, else the content of the file its path names.

    Only rows without bytes take part in the join to the files. Rows that resolve
    to nothing keep NULL, which the header reader quarantines.
    """
    if isinstance(df.schema[image].dataType, T.BinaryType):
        return df.withColumn(out, F.col(image))
    own = F.col(f"{image}.bytes")
    inline = df.filter(own.isNotNull()).withColumn(out, own)
    rest = df.filter(own.isNull())
    if files_root is None:
        return inline.unionByName(rest.withColumn(out, F.lit(None).cast("binary")))
    files = (
        df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(files_root)
        .select(plain_path(F.col("path")).alias("_path"), F.col("content").alias(out))
    )
    named = rest.withColumn("_path", plain_path(F.col(f"{image}.path")))
    return inline.unionByName(named.join(files, "_path", "left").drop("_path"))


Measure = Callable[[DataFrame, str], DataFrame]


def _without_payloads(df: DataFrame) -> DataFrame:
    held = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)]
    if held:
        raise ValueError(f"measured rows still hold payloads: {held}")
    return df


def measure_payloads(df: DataFrame, measure: Measure, files_root: str | None = None, image: str = "image") -> DataFrame:
    """What ``measure(rows, payload_column)`` finds in the payload of each row: the bytes in the image struct, else the file its path names.

    Payloads are measured in the scan that reads them, of the shards or of the files, and dropped there; only the measures of files
    are joined to the rows that name them. A row whose payload is nowhere has NULL measures. ``measure`` adds
    columns and drops the payload.
    """
    kept = [c for c in df.columns if c != image]
    own = F.col(image) if isinstance(df.schema[image].dataType, T.BinaryType) else F.col(f"{image}.bytes")
    inline = _without_payloads(measure(df.where(own.isNotNull()).select(*kept, own.alias("_payload")), "_payload"))
    found = [f for f in inline.schema.fields if f.name not in kept]
    rest = df.where(own.isNull())
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in found]
    if isinstance(df.schema[image].dataType, T.BinaryType) or files_root is None:
        return inline.unionByName(rest.select(*kept, *blank))
    files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(files_root)
    named = files.select(plain_path(F.col("path")).alias("_path"), F.col("content").alias("_payload"))
    measured = _without_payloads(measure(named, "_payload")).select("_path", *[f.name for f in found])
    wanted = rest.select(*kept, plain_path(F.col(f"{image}.path")).alias("_path"))
    # many rows may name one file, so the measures are the side with one row for each key
    return inline.unionByName(lookup_join(wanted, measured, ["_path"], "left").select(*kept, *[f.name for f in found]))


#: Words of 64 rows that mark the wanted rows of shards, as many as are broadcast at once.
MARK_WORDS = 1 << 20


def fetch_indexed(shards: DataFrame, index: DataFrame, keys: Sequence[str] = ("source_shard", "source_row_idx")) -> DataFrame:
    """Shard rows the index points at, with the index columns.

    An index proven small is broadcast. A larger one meets the rows by a shuffle, after rows it does not want are left out by ``marked_rows``;
    use ``measure_indexed`` where the rows hold payloads.
    """
    small = if_small(index)
    if small is not None:
        return shards.join(F.broadcast(small), list(keys))
    return marked_rows(shards, index, keys).join(index, list(keys))


def marked_rows(shards: DataFrame, index: DataFrame, keys: Sequence[str] = ("source_shard", "source_row_idx")) -> DataFrame:
    """Shard rows the index points at, filtered in the scan by bitmaps of the wanted positions of each shard.

    A word marks 64 positions of one shard. At most ``MARK_WORDS`` words, of whole shards and together, are broadcast at once: a larger index
    is split by shard, and each part reads its own rows.
    """
    shard, position = keys
    word, bit = F.expr(f"`{position}` div 64"), (F.col(position) % 64).cast("int")
    one = F.lit(1).cast("long")
    marks = stage(index.groupBy(F.col(shard).alias("_shard"), word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", one, bit)).alias("_bits")), "marks")
    parts = max(1, -(-marks.count() // MARK_WORDS))
    share = F.pmod(F.xxhash64("_shard", "_word"), F.lit(parts))
    out = None
    for part in range(parts):
        held = F.broadcast(marks.where(share == part))
        rows = shards.join(held, (F.col(shard) == F.col("_shard")) & (word == F.col("_word"))).where(F.getbit("_bits", bit) == 1).select(*shards.columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def measure_indexed(
    shards: DataFrame, index: DataFrame, measure: Measure, payload: str, keys: Sequence[str] = ("source_shard", "source_row_idx")
) -> DataFrame:
    """Index rows with what ``measure`` finds in the payloads they point at: measured in the scan, joined without payloads."""
    found = _without_payloads(measure(marked_rows(shards, index, keys).select(*keys, payload), payload))
    return index.join(found, list(keys))


def unmatched_index(shards: DataFrame, index: DataFrame, keys: Sequence[str] = ("source_shard", "source_row_idx")) -> DataFrame:
    """Index rows without a shard row: missing shard, or position out of range."""
    return index.join(shards.select(*keys), list(keys), "left_anti")

