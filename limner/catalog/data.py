"""Queries over sources, sinks, payloads, deduplication and dataset profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limner.catalog import bindings as B
from limner.catalog.registry import having, query
from limner.functions.labels import STYLE_NAMES, vocabulary
from limner.functions.numbers import fixed, percent
from limner.operators import dedupe as D
from limner.operators import images as I
from limner.operators import indexing as X
from limner.operators import profile as P
from limner.operators import sketches as K
from limner.plans.index_job import ImageIndex, build_image_index
from limner.plans.ordering import dense_index, running_totals
from limner.plans.profile_job import DIMS, audit_document, full_profile_document, profile_document
from limner.plans.staging import scratch_path, stage
from limner.schemas import require_columns
from limner.sinks.documents import highlights, profile_report
from limner.sinks.tables import config_hash, pending_work, read_manifest, write_csv, write_manifest
from limner.sources import shard_audit as A
from limner.sources import shards as S
from limner.sources.shard_audit import break_pages, cut_the_footer, local_shards
from limner.sources.tables import materialize_once, read_config_list, read_index, resolve_defaults_columns

ROUNDED_6 = "CAST(printf('%.6f', {}) AS DOUBLE)"


# Sources and sinks


@query("SELECT 'documents.parquet' AS shard, doc_id AS source_row_idx, doc_id, n_chars FROM documents")
def shard_scan_with_locator(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.shards(spark, sf, "documents", B.DOCUMENT_SHARD, ["doc_id", "n_chars"])
    rows = S.whole_shards(rows, S.part_starts(rows))
    name = F.element_at(F.split("source_shard", "/"), -1)
    return rows.select(name.alias("shard"), "source_row_idx", "doc_id", "n_chars")


@query("SELECT 'documents.parquet' AS shard, count(*) AS n_rows FROM documents")
def shard_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.shards(spark, sf, "documents", B.DOCUMENT_SHARD, [])
    return S.shard_row_counts(rows.withColumn("source_shard", S.shard_of(F.col("source_shard")))).select(F.element_at(F.split("source_shard", "/"), -1).alias("shard"), "n_rows")


@query("SELECT CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS position, lang AS model FROM (SELECT DISTINCT lang FROM documents)")
def config_list_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The languages as a list in a configuration document, read back by position."""
    langs = require_columns(B.table(spark, sf, "documents"), ["doc_id", "lang"]).select("lang").distinct()
    path = scratch_path(spark, "config")
    langs.agg(F.sort_array(F.collect_list("lang")).alias("models")).write.json(path)
    return read_config_list(spark, path, "models", "model")


@query()
def dataset_footprint(spark: SparkSession, sf: str) -> DataFrame:
    return S.dataset_footprint(spark, sf)


@query()
def unreadable_shards(spark: SparkSession, sf: str) -> DataFrame:
    return S.bad_shards(spark, sf, B.DOCUMENT_SHARD)


@query(
    """SELECT CAST(doc_id % 4 AS INTEGER) AS part, CASE doc_id % 4 WHEN 1 THEN 'damaged pages' WHEN 2 THEN 'no parquet footer' END AS error,
         CASE WHEN doc_id % 4 <> 2 THEN count(*) END AS expected_rows, CASE WHEN doc_id % 4 IN (1, 2) THEN 0 ELSE count(*) END AS read_rows
       FROM documents GROUP BY doc_id % 4"""
)
def damaged_shards(spark: SparkSession, sf: str) -> DataFrame:
    """A copy of the documents in four shards, one with broken pages and one without footers, audited in one pass.

    Each task writes what it has read to a file of each shard, so that no file is larger than what one task reads.
    """
    path = scratch_path(spark, "damaged")
    copy = B.table(spark, sf, "documents").withColumn("part", (F.col("doc_id") % 4).cast("int"))
    copy.write.option("parquet.page.write-checksum.enabled", True).partitionBy("part").parquet(path)
    local = path.removeprefix("file://")
    for part, harm in ((1, break_pages), (2, cut_the_footer)):
        for file in local_shards(local, f"part={part}"):
            harm(file)
    audit = A.audit_shards(spark, local, ["doc_id", "text"])
    part = F.regexp_extract("path", r"part=(\d+)", 1).cast("int").alias("part")
    whole = F.sum(F.when(F.col("error").isNull(), F.col("n_rows")))
    return audit.groupBy(part).agg(F.max("error").alias("error"), F.sum("n_rows").alias("expected_rows"), F.coalesce(whole, F.lit(0)).alias("read_rows"))


@query(having(B.GEOM, then="SELECT source_shard, source_row_idx, style, genre, artist, width, height, bytes_size FROM geom"))
def index_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    index = B.geom(spark, sf).select("source_shard", "source_row_idx", "style", "genre", "artist", "width", "height", "bytes_size")
    path = scratch_path(spark, "index-csv")
    write_csv(index, path)
    return read_index(spark, path, index.schema)


@query(
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE md5(text) END AS image_hash, "
    "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE strlen(text) END AS bytes_size FROM documents"
)
def payload_fields(spark: SparkSession, sf: str) -> DataFrame:
    inline = F.when(F.col("doc_id") % 3 != 0, F.encode("text", "UTF-8"))
    image = F.struct(inline.alias("bytes"), F.concat(F.lit("missing/"), "doc_id").alias("path"))
    rows = B.table(spark, sf, "documents").select("doc_id", image.alias("image"))
    done = S.normalize_payload(rows)
    return done.select("doc_id", F.md5("image_bytes").alias("image_hash"), F.octet_length("image_bytes").cast("bigint").alias("bytes_size"))


@query(
    "SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'stored-' || s_nationkey ELSE 'base-image' END AS image_model_id, "
    "'given-text' AS text_model_id FROM supplier"
)
def metadata_defaults(spark: SparkSession, sf: str) -> DataFrame:
    stored = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("stored-"), "s_nationkey")).otherwise("")
    meta = B.table(spark, sf, "supplier").select("s_suppkey", stored.alias("image_model_id"))
    return resolve_defaults_columns(meta, {"text_model_id": "given-text"}, {"image_model_id": "base-image", "text_model_id": "base-text"})


@query("SELECT source_shard, count(*) AS n, sum(bytes_size)::BIGINT AS total_bytes FROM (" + having(B.DOCS, then="SELECT * FROM docs") + ") GROUP BY 1")
def read_through_cache(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "cache")
    totals = lambda: B.docs(spark, sf).groupBy("source_shard").agg(F.count("*").alias("n"), F.sum("bytes_size").alias("total_bytes"))
    materialize_once(spark, path, totals)
    return materialize_once(spark, path, totals)


@query(
    having(
        B.RUNS,
        then="SELECT run_id, target, model_id FROM runs WHERE NOT (target IN ('click', 'view') AND n_images >= 10)",
    )
)
def pending_run_work(spark: SparkSession, sf: str) -> DataFrame:
    work = config_hash(B.runs(spark, sf), ["run_id", "n_images"])
    path = scratch_path(spark, "manifest")
    done = work.filter(F.col("target").isin("click", "view") & (F.col("n_images") >= 10))
    manifest = done.select("config_hash", "run_id", "target", "model_id")
    write_manifest(manifest, path)
    return pending_work(work, read_manifest(spark, path, manifest)).select("run_id", "target", "model_id")


# Payload and geometry


@query(having(B.DOCS, then="SELECT doc_id, image_hash, bytes_size FROM docs"))
def payload_hash_and_size(spark: SparkSession, sf: str) -> DataFrame:
    return B.docs(spark, sf).select("doc_id", "image_hash", "bytes_size")


@query(having(B.GEOM, B.PNG, then="SELECT * FROM png"))
def image_header_dims(spark: SparkSession, sf: str) -> DataFrame:
    return I.image_dims(B.png(spark, sf), "payload", jpeg=False).select("source_shard", "source_row_idx", "width", "height", "error")


@query(having(B.GEOM, then="SELECT source_row_idx, width, height, CAST(NULL AS VARCHAR) AS error FROM geom"))
def jpeg_header_dims(spark: SparkSession, sf: str) -> DataFrame:
    size = F.concat(*[F.lpad(F.hex(c), 4, "0") for c in ("height", "width")])
    jpeg = F.unhex(F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), size, F.lit("03")))
    rows = B.geom(spark, sf).select("source_row_idx", jpeg.alias("payload"))
    return I.image_dims(rows, "payload").select("source_row_idx", "width", "height", "error")


@query(
    having(
        B.GEOM,
        B.FEAT,
        then="SELECT source_row_idx, pixels, orientation, round(megapixels, 9) AS megapixels, round(aspect_ratio, 9) AS aspect_ratio, "
        "round(bytes_per_pixel, 9) AS bytes_per_pixel, round(abs_log_aspect, 9) AS abs_log_aspect, "
        f"{ROUNDED_6.format('megapixels')} AS megapixels_6, {ROUNDED_6.format('aspect_ratio')} AS aspect_ratio_6 FROM feat",
    )
)
def geometry_features(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["source_row_idx", "pixels", "orientation", "megapixels", "aspect_ratio", "bytes_per_pixel", "abs_log_aspect"]
    return B.rounded(B.feat(spark, sf).select(*cols, "megapixels_6", "aspect_ratio_6"))


@query(having(B.GEOM, B.PNG, then="SELECT source_shard, source_row_idx, error FROM png WHERE error IS NOT NULL ORDER BY 1, 2 LIMIT 100"))
def first_decode_errors(spark: SparkSession, sf: str) -> DataFrame:
    order = ["source_shard", "source_row_idx"]
    measured = I.image_dims(B.png(spark, sf), "payload", jpeg=False).select(*order, "error")
    _valid, bad = I.split_quarantine(measured)
    return I.first_errors(bad, order)


@query(having(B.GEOM, B.PNG, then="SELECT error IS NULL AS valid, count(*) AS n FROM png GROUP BY 1"))
def quarantine_split(spark: SparkSession, sf: str) -> DataFrame:
    measured = stage(I.image_dims(B.png(spark, sf), "payload", jpeg=False).select("source_shard", "source_row_idx", "error"), "measured")
    valid, bad = I.split_quarantine(measured)
    counted = lambda df, flag: df.agg(F.lit(flag).alias("valid"), F.count("*").alias("n"))
    return counted(valid, True).unionByName(counted(bad, False))


# Deduplication

FIRST = """firsts AS (SELECT *, row_number() OVER (PARTITION BY image_hash ORDER BY source_shard, source_row_idx) AS rn FROM docs),
uniq AS (SELECT *, row_number() OVER (ORDER BY source_shard, source_row_idx) - 1 AS unique_idx FROM firsts WHERE rn = 1)"""
ORDER = ["source_shard", "source_row_idx"]


@query(having(B.DOCS, FIRST, then="SELECT unique_idx, image_hash, source_shard, source_row_idx, style, genre, bytes_size FROM uniq"))
def unique_image_index(spark: SparkSession, sf: str) -> DataFrame:
    unique, _duplicates = D.dedupe_exact(B.docs(spark, sf), "image_hash", ORDER)
    return unique.select("unique_idx", "image_hash", "source_shard", "source_row_idx", "style", "genre", "bytes_size")


@query(
    having(
        B.DOCS,
        FIRST,
        then="SELECT f.image_hash, f.source_shard AS duplicate_shard, f.source_row_idx AS duplicate_row_idx, "
        "u.unique_idx AS primary_unique_idx, f.style, f.genre FROM firsts f JOIN uniq u USING (image_hash) WHERE f.rn > 1",
    )
)
def duplicate_records(spark: SparkSession, sf: str) -> DataFrame:
    _unique, dup = D.dedupe_exact(B.docs(spark, sf), "image_hash", ORDER)
    return dup.select(
        "image_hash",
        F.col("source_shard").alias("duplicate_shard"),
        F.col("source_row_idx").alias("duplicate_row_idx"),
        "primary_unique_idx",
        "style",
        "genre",
    )


HASHES = "hashes AS (SELECT image_hash, count(*) AS n, count(*) FILTER (source_row_idx % 97 <> 0) AS n_valid FROM docs GROUP BY 1)"


def _hash_counts(spark: SparkSession, sf: str) -> DataFrame:
    error = F.when(F.col("source_row_idx") % 97 == 0, "unreadable")
    return D.hash_counts(B.docs(spark, sf).withColumn("error", error), "image_hash", "error")


@query(
    having(
        B.DOCS,
        HASHES,
        then="SELECT sum(n)::BIGINT AS total_rows, count(*) FILTER (n_valid > 0) AS unique_rows, "
        "sum(greatest(n_valid - 1, 0))::BIGINT AS duplicate_rows, sum(n - n_valid)::BIGINT AS quarantined_rows, "
        "round(sum(greatest(n_valid - 1, 0)) / sum(n), 9) AS duplicate_rate FROM hashes",
    )
)
def dedupe_summary(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(D.dedupe_summary(_hash_counts(spark, sf)))


@query(having(B.DOCS, HASHES, then="SELECT n AS group_size, count(*) AS hashes FROM hashes WHERE n > 1 GROUP BY 1"))
def duplicate_group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return D.dup_group_sizes(_hash_counts(spark, sf))


@query(
    having(B.DOCS, HASHES, then="SELECT * FROM (SELECT image_hash, n FROM hashes ORDER BY n DESC, image_hash LIMIT 20) WHERE n > 1")
)
def top_duplicate_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return D.top_duplicate_hashes(_hash_counts(spark, sf), "image_hash")


@query(having(B.DOCS, HASHES, then="SELECT count(*) FILTER (n > 1) AS repeated_hashes FROM hashes"))
def repeated_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return D.repeated_hashes(_hash_counts(spark, sf))


TINY = """tiny AS (SELECT source_shard, source_row_idx, artist, CAST(left(genre, 1) AS BIGINT) AS genre, style, 1 + artist % 40 AS width,
  1 + bytes_size % 50 AS height, source_row_idx % 97 = 0 AS cut FROM geom),
bytes_of AS (SELECT *, CASE WHEN cut THEN left(hex, 40) ELSE hex END AS payload FROM (SELECT *,
  '89504E470D0A1A0A0000000D49484452' || printf('%08X', width) || printf('%08X', height) AS hex FROM tiny)),
good AS (SELECT *, md5(from_hex(payload)) AS image_hash FROM bytes_of WHERE NOT cut),
placed AS (SELECT *, row_number() OVER (PARTITION BY image_hash ORDER BY source_shard, source_row_idx) AS rn FROM good),
uniq AS (SELECT *, row_number() OVER (ORDER BY source_shard, source_row_idx) - 1 AS unique_idx FROM placed WHERE rn = 1)"""


def _image_index(spark: SparkSession, sf: str) -> ImageIndex:
    """Small PNG headers, so that many payloads repeat."""
    w, h = 1 + F.col("artist") % 40, 1 + F.col("bytes_size") % 50
    whole = B.png_payload(w, h)
    payload = F.when(F.col("source_row_idx") % 97 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    genre = F.substring("genre", 1, 1).cast("bigint").alias("genre")
    rows = B.geom(spark, sf).select(*ORDER, "artist", genre, "style", payload.alias("image_bytes"))
    return build_image_index(rows, jpeg=False)


@query(
    having(
        B.GEOM, TINY,
        then="SELECT unique_idx, image_hash, source_shard, source_row_idx, artist, genre, style, width, height, "
        "CASE WHEN width = height THEN 'square' WHEN width > height THEN 'landscape' ELSE 'portrait' END AS orientation, "
        "CAST(printf('%.6f', width / height) AS DOUBLE) AS aspect_ratio, 24::BIGINT AS bytes_size, "
        "CAST(printf('%.6f', width * height / 1e6) AS DOUBLE) AS megapixels FROM uniq",
    )
)
def image_index_unique(spark: SparkSession, sf: str) -> DataFrame:
    return _image_index(spark, sf).unique


@query(
    having(
        B.GEOM, TINY,
        then="SELECT p.image_hash, p.source_shard AS duplicate_shard, p.source_row_idx AS duplicate_row_idx, u.unique_idx AS primary_unique_idx, "
        "p.artist, p.genre, p.style FROM placed p JOIN uniq u USING (image_hash) WHERE p.rn > 1",
    )
)
def image_index_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return _image_index(spark, sf).duplicates


@query(having(B.GEOM, TINY, then="SELECT source_shard, source_row_idx, 'truncated header' AS error FROM bytes_of WHERE cut"))
def image_index_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _image_index(spark, sf).errors


@query(
    having(
        B.GEOM, TINY,
        then="SELECT (SELECT count(*) FROM tiny) AS total_rows, (SELECT count(*) FROM uniq) AS unique_rows, "
        "(SELECT count(*) FROM placed WHERE rn > 1) AS duplicate_rows, (SELECT count(*) FROM tiny WHERE cut) AS quarantined_rows, "
        "round((SELECT count(*) FROM placed WHERE rn > 1) / (SELECT count(*) FROM tiny), 9) AS duplicate_rate",
    )
)
def image_index_summary(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(_image_index(spark, sf).summary)


# Joins on the row locator

@query(
    "WITH f AS (SELECT source, lang, string_agg(text || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY 1, 2) "
    "SELECT d.doc_id, md5(CASE WHEN d.doc_id % 5 = 0 THEN d.text ELSE f.content END) AS image_hash, "
    "strlen(CASE WHEN d.doc_id % 5 = 0 THEN d.text ELSE f.content END) AS bytes_size FROM documents d JOIN f ON f.source = d.source AND f.lang = d.lang WHERE d.doc_id % 7 > 0 "
    "UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE doc_id % 7 = 0"
)
def payloads_by_path(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth row holds its bytes, every seventh names a file that is not there, the others name the file of their source and language."""
    docs = B.table(spark, sf, "documents")
    root = scratch_path(spark, "payload-files")
    files = docs.repartition("source", "lang").sortWithinPartitions("source", "lang", "doc_id").select(F.col("source").alias("s"), F.col("lang").alias("l"), "text")
    files.write.partitionBy("s", "l").text(root)
    listed = S.list_files(spark, root).where(F.col("path").rlike(r"/part-[^/]*$")).select(
        F.regexp_extract("path", "/s=([^/]*)/", 1).alias("source"), F.regexp_extract("path", "/l=([^/]*)/", 1).alias("lang"), "path"
    )
    own = F.when((F.col("doc_id") % 5 == 0) & (F.col("doc_id") % 7 > 0), F.encode("text", "UTF-8"))
    path = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("nowhere/"), "doc_id")).otherwise(F.col("path"))
    rows = docs.join(F.broadcast(listed), ["source", "lang"]).select("doc_id", F.struct(own.alias("bytes"), path.alias("path")).alias("image"))

    def measure(df: DataFrame, payload: str) -> DataFrame:
        return df.withColumns({"image_hash": F.md5(payload), "bytes_size": F.octet_length(payload).cast("bigint")}).drop(payload)

    return S.measure_payloads(rows, measure, root)


INDEXED = "idx AS (SELECT doc_id * 2 AS source_row_idx, quality FROM labels)"


def _shards_and_index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = B.docs(spark, sf).withColumn("source_shard", F.lit("documents"))
    index = B.table(spark, sf, "labels").select(
        F.lit("documents").alias("source_shard"), (F.col("doc_id") * 2).alias("source_row_idx"), "quality"
    )
    return rows, index


@query(having(B.DOCS, INDEXED, then="SELECT source_row_idx, quality, image_hash FROM docs JOIN idx USING (source_row_idx)"))
def indexed_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows, index = _shards_and_index(spark, sf)
    return S.fetch_indexed(rows, index).select("source_row_idx", "quality", "image_hash")


@query(having(B.DOCS, INDEXED, then="SELECT source_row_idx, quality, image_hash, bytes_size FROM docs JOIN idx USING (source_row_idx)"))
def indexed_measures(spark: SparkSession, sf: str) -> DataFrame:
    """The rows an index points at, measured in the scan: bitmaps of wanted rows are broadcast, payloads are not shuffled."""
    rows = B.table(spark, sf, "documents").select(F.lit("documents").alias("source_shard"), F.col("doc_id").alias("source_row_idx"), F.encode("text", "UTF-8").alias("payload"))
    _, index = _shards_and_index(spark, sf)

    def measure(df: DataFrame, payload: str) -> DataFrame:
        return df.withColumns({"image_hash": F.md5(payload), "bytes_size": F.octet_length(payload).cast("bigint")}).drop(payload)

    return S.measure_indexed(rows, index, measure, "payload").select("source_row_idx", "quality", "image_hash", "bytes_size")


@query(having(B.DOCS, INDEXED, then="SELECT source_row_idx, quality FROM idx WHERE source_row_idx NOT IN (SELECT source_row_idx FROM docs)"))
def unmatched_index_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows, index = _shards_and_index(spark, sf)
    return S.unmatched_index(rows, index).select("source_row_idx", "quality")


NAMES = "names AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(STYLE_NAMES)) + ") AS t(style, name))"


@query(having(B.GEOM, NAMES, then="SELECT name, count(*) AS n FROM geom JOIN names USING (style) GROUP BY 1"))
def class_names(spark: SparkSession, sf: str) -> DataFrame:
    names = F.broadcast(vocabulary(spark, STYLE_NAMES))  # 27 rows
    counts = B.geom(spark, sf).groupBy(F.col("style").cast("int").alias("class_id")).agg(F.count("*").alias("n"))
    return counts.join(names, "class_id").select("name", "n")


# Class balance

COUNTS = """counts AS (SELECT 'style' AS dim, CAST(style AS VARCHAR) AS class_id, count(*) AS n FROM geom GROUP BY 1, 2
  UNION ALL SELECT 'genre', genre, count(*) FROM geom GROUP BY 1, 2
  UNION ALL SELECT 'artist', CAST(artist AS VARCHAR), count(*) FROM geom GROUP BY 1, 2)"""


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.class_counts(B.geom(spark, sf), DIMS)


@query(having(B.GEOM, COUNTS, then="SELECT * FROM counts"))
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf)


@query(having(B.GEOM, COUNTS, then="SELECT dim, count(*) AS classes FROM counts GROUP BY 1"))
def class_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return P.coverage(_counts(spark, sf))


@query()
def approximate_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return P.approx_coverage(B.geom(spark, sf), DIMS)


def _stored_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of the shards, added one set of shards after the other."""
    geom = B.feat(spark, sf)
    rows = geom.withColumn("shard", F.concat_ws("-", "source_shard", F.pmod("artist", F.lit(4)).cast("string")))
    some = K.shard_sketches(rows.where("source_shard <> 'F'"), DIMS, METRICS, "shard")
    return stage(K.add_new_shards(stage(some, "sketches"), rows, DIMS, METRICS, "shard"), "sketches")


@query(having(B.GEOM, COUNTS, then="SELECT dim, count(*) AS classes, TRUE AS close FROM counts GROUP BY 1"))
def coverage_from_stored_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Exact numbers of classes, and whether the estimate of the merged sketches is within three standard errors."""
    found = K.merged_coverage(_stored_sketches(spark, sf)).withColumnRenamed("classes", "guess")
    exact = P.coverage(_counts(spark, sf))
    near = F.abs(F.col("guess") - F.col("classes")) <= F.ceil(F.col("classes") * 3 * K.HLL_ERROR)
    return exact.join(found, "dim").select("dim", "classes", near.alias("close"))


BALANCE = """t AS (SELECT dim, sum(n) AS total, count(*) AS k FROM counts GROUP BY 1),
ent AS (SELECT c.dim, CASE WHEN any_value(t.k) <= 1 THEN 0 ELSE sum(-(c.n / t.total) * ln(c.n / t.total + 1e-12)) / ln(any_value(t.k)) END AS entropy_norm
  FROM counts c JOIN t ON c.dim = t.dim GROUP BY 1),
asc_ranked AS (SELECT dim, n, row_number() OVER (PARTITION BY dim ORDER BY n) AS i FROM counts),
gin AS (SELECT a.dim, sum((2 * a.i - t.k - 1) * a.n) / any_value(t.k * t.total) AS gini FROM asc_ranked a JOIN t ON a.dim = t.dim GROUP BY 1)"""


@query(having(B.GEOM, COUNTS, BALANCE, then="SELECT dim, round(entropy_norm, 9) AS entropy_norm FROM ent"))
def class_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(P.normalized_entropy(_counts(spark, sf)))


@query(having(B.GEOM, COUNTS, BALANCE, then="SELECT dim, round(gini, 9) AS gini FROM gin"))
def class_gini(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(P.gini(_counts(spark, sf)))


@query(
    having(
        B.GEOM,
        COUNTS,
        then="SELECT dim, count(*) FILTER (n < 20) AS lt_20, count(*) FILTER (n < 50) AS lt_50, count(*) FILTER (n < 100) AS lt_100, "
        "count(*) FILTER (n <= 50) AS at_or_below_threshold FROM counts GROUP BY 1",
    )
)
def class_tail_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.tail_counts(_counts(spark, sf))


@query(
    having(
        B.GEOM,
        COUNTS,
        BALANCE,
        then="SELECT c.dim, count(*) AS classes, round(any_value(ent.entropy_norm), 9) AS entropy_norm, round(any_value(gin.gini), 9) AS gini, "
        "round(max(c.n) / greatest(sum(c.n), 1), 9) AS top_share, count(*) FILTER (n < 20) AS lt_20, count(*) FILTER (n < 50) AS lt_50, "
        "count(*) FILTER (n < 100) AS lt_100, count(*) FILTER (n <= 50) AS at_or_below_threshold "
        "FROM counts c JOIN ent ON c.dim = ent.dim JOIN gin ON c.dim = gin.dim GROUP BY 1",
    )
)
def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(P.class_balance(_counts(spark, sf)))


@query(
    having(
        B.GEOM,
        COUNTS,
        then="SELECT dim, class_id, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, class_id) AS rank FROM counts) WHERE rank <= 20",
    )
)
def top_classes(spark: SparkSession, sf: str) -> DataFrame:
    return P.top_classes(_counts(spark, sf), 20)


@query(having(B.GEOM, COUNTS, then="SELECT * FROM counts WHERE n <= 50"))
def tail_classes(spark: SparkSession, sf: str) -> DataFrame:
    return P.tail_classes(_counts(spark, sf), 50)


@query(
    having(
        B.GEOM,
        then="SELECT source_row_idx, style FROM geom WHERE style IN (SELECT style FROM geom GROUP BY 1 ORDER BY count(*) DESC, style LIMIT 5)",
    )
)
def rows_of_top_classes(spark: SparkSession, sf: str) -> DataFrame:
    return P.in_top_classes(B.geom(spark, sf), "style", 5).select("source_row_idx", "style")


@query(
    having(
        B.GEOM,
        COUNTS,
        then="SELECT dim, rank, n, round(ln(rank), 9) AS log_rank, round(ln(n), 9) AS log_n FROM "
        "(SELECT dim, n, row_number() OVER (PARTITION BY dim ORDER BY n DESC, class_id) AS rank FROM counts)",
    )
)
def rank_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(P.rank_frequency(_counts(spark, sf)))


# Distributions

METRICS = ["width", "height", "bytes_size", "megapixels", "aspect_ratio"]


def _profile_sql(col: str) -> str:
    qs = ", ".join(f"round(quantile_cont(CAST({col} AS DOUBLE), {q}), 6) AS q{int(q * 100):02d}" for q in (0.25, 0.5, 0.75, 0.95))
    return (
        f"SELECT '{col}' AS metric, round(CAST(min({col}) AS DOUBLE), 6) AS min, round(CAST(max({col}) AS DOUBLE), 6) AS max, "
        f"round(avg({col}), 6) AS mean, {qs} FROM feat"
    )


@query(having(B.GEOM, B.FEAT, then=" UNION ALL ".join(_profile_sql(c) for c in METRICS)))
def numeric_profile(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(P.numeric_profile(B.feat(spark, sf), METRICS), 6)


@query()
def approximate_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.numeric_profile(B.feat(spark, sf), METRICS, exact=False)


@query(
    having(
        B.GEOM, B.FEAT,
        then=" UNION ALL ".join(f"SELECT '{c}' AS metric, count({c}) AS n, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, TRUE AS close FROM feat" for c in METRICS),
    )
)
def profile_from_stored_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and ends of each metric, and whether every quantile of the merged sketches has about its rank among all rows."""
    qs = (0.25, 0.5, 0.75, 0.95)
    merged = K.merged_profile(_stored_sketches(spark, sf), qs)
    names = [f"q{round(q * 100):02d}" for q in qs]
    # below and up to each quantile: its true rank lies between the two shares
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in METRICS]
    rows = B.feat(spark, sf).select(F.inline(F.array(*cells))).join(F.broadcast(merged), "metric")
    shares = rows.groupBy("metric", "n", "min", "max").agg(*[f for k in names for f in (F.avg((F.col("x") < F.col(k)).cast("int")).alias(f"{k}_lo"), F.avg((F.col("x") <= F.col(k)).cast("int")).alias(f"{k}_hi"))])
    close = F.lit(True)
    for q, k in zip(qs, names, strict=True):
        close = close & (F.col(f"{k}_lo") <= q + K.KLL_ERROR) & (F.col(f"{k}_hi") >= q - K.KLL_ERROR)
    return shares.select("metric", "n", "min", "max", close.alias("close"))


@query(
    having(
        B.GEOM,
        then=" UNION ALL ".join(
            f"SELECT '{c}' AS metric, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, "
            f"CAST(printf('%.2f', avg({c})) AS DOUBLE) AS mean_2 FROM geom" for c in ("width", "height")
        ),
    )
)
def size_profile(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(P.dims_profile(B.geom(spark, sf)), 6)


@query(having(B.GEOM, B.FEAT, then="SELECT orientation, count(*) AS n, round(count(*) / (SELECT count(*) FROM feat), 9) AS share FROM feat GROUP BY 1"))
def orientation_mix(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(P.mix(B.feat(spark, sf), "orientation"))


@query(
    having(
        B.GEOM,
        B.FEAT,
        then="SELECT round(max(megapixels), 9) AS max_megapixels, max(bytes_size) AS max_bytes, round(max(aspect_ratio), 9) AS max_aspect_ratio, "
        "round(min(aspect_ratio), 9) AS min_aspect_ratio FROM feat",
    )
)
def extremes(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(P.extremes(B.feat(spark, sf)))


QUALITY_SQL = (
    "SELECT {c}, count(*) AS n, round(avg(megapixels), 6) AS mean_megapixels, round(avg(bytes_size), 4) AS mean_bytes, "
    "round(avg(bytes_per_pixel), 6) AS mean_bpp, round(avg(aspect_ratio), 6) AS mean_aspect FROM feat GROUP BY 1"
)


@query(having(B.GEOM, B.FEAT, then=QUALITY_SQL.format(c="style")))
def quality_by_style(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(P.quality_by_class(B.feat(spark, sf), "style"), 6, mean_bytes=4)


@query(having(B.GEOM, B.FEAT, then=QUALITY_SQL.format(c="genre")))
def quality_by_genre(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(P.quality_by_class(B.feat(spark, sf), "genre"), 6, mean_bytes=4)


CORR = ["width", "height", "bytes_size", "megapixels", "aspect_ratio", "bytes_per_pixel"]


@query(
    having(
        B.GEOM,
        B.FEAT,
        then=" UNION ALL ".join(
            f"SELECT '{a}' AS c1, '{b}' AS c2, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) AS r FROM feat"
            for a in CORR for b in CORR
        ),
    )
)
def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(P.correlation_matrix(B.feat(spark, sf), CORR), 6)


@query(
    having(
        B.GEOM,
        "top AS (SELECT style FROM geom GROUP BY 1 ORDER BY count(*) DESC, style LIMIT 20)",
        then="SELECT style, " + ", ".join(f"count(*) FILTER (genre = '{g}') AS \"{g}\"" for g in B.PRIORITIES)
        + " FROM geom WHERE style IN (SELECT style FROM top) GROUP BY 1",
    )
)
def style_genre_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return P.crosstab(B.geom(spark, sf), "style", "genre", B.PRIORITIES, top_k=20)


def _outliers(by: str):
    sql = having(
        B.GEOM, B.FEAT,
        then=f"SELECT source_row_idx, round(CAST({by} AS DOUBLE), 9) AS score FROM feat ORDER BY {by} DESC, source_row_idx LIMIT 100",
    )

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = P.outliers(B.feat(spark, sf), by, "source_row_idx")
        return B.rounded(rows.select("source_row_idx", F.col(by).cast("double").alias("score")))

    run.__name__ = f"outliers_by_{by}"
    query(sql)(run)


for _by in ("megapixels", "bytes_size", "abs_log_aspect"):
    _outliers(_by)

HIST = ["aspect_ratio", "megapixels", "bytes_size", "bytes_per_pixel"]


def _hist_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS metric, least(CAST(floor((CAST({c} AS DOUBLE) - lo) / ((hi - lo) / 60)) AS INTEGER), 59) AS bin, count(*) AS n "
        f"FROM feat, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM feat) GROUP BY 1, 2"
    )


@query(having(B.GEOM, B.FEAT, then=" UNION ALL ".join(_hist_sql(c) for c in HIST)))
def metric_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return P.histogram(B.feat(spark, sf), HIST).select("metric", "bin", "n")


SAMPLED = (
    "sampled AS (SELECT * FROM geom ORDER BY md5(CAST(source_row_idx AS VARCHAR) || '|42'), source_row_idx LIMIT 15000), "
    "span AS (SELECT min(width)::DOUBLE AS wl, max(width)::DOUBLE AS wh, min(height)::DOUBLE AS hl, max(height)::DOUBLE AS hh FROM sampled)"
)


@query(having(B.GEOM, then="SELECT source_row_idx FROM geom ORDER BY md5(CAST(source_row_idx AS VARCHAR) || '|42'), source_row_idx LIMIT 5000"))
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return P.hash_sample(B.geom(spark, sf), "source_row_idx", 5000, 42).select("source_row_idx")


@query(
    having(
        B.GEOM,
        SAMPLED,
        then="SELECT least(CAST(floor((width::DOUBLE - wl) / ((wh - wl) / 45)) AS INTEGER), 44) AS x_bin, "
        "least(CAST(floor((height::DOUBLE - hl) / ((hh - hl) / 45)) AS INTEGER), 44) AS y_bin, count(*) AS n FROM sampled, span GROUP BY 1, 2",
    )
)
def width_height_density(spark: SparkSession, sf: str) -> DataFrame:
    return P.density_2d(P.hash_sample(B.geom(spark, sf), "source_row_idx", 15000, 42), "width", "height")


@query(
    having(
        B.GEOM,
        B.FEAT,
        "q AS (SELECT orientation, quantile_cont(megapixels, 0.25) AS q25, quantile_cont(megapixels, 0.5) AS q50, quantile_cont(megapixels, 0.75) AS q75 FROM feat GROUP BY 1)",
        then="SELECT orientation, round(any_value(q25), 9) AS q25, round(any_value(q50), 9) AS q50, round(any_value(q75), 9) AS q75, count(*) AS n, "
        "round(min(megapixels) FILTER (megapixels BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)), 9) AS whisker_low, "
        "round(max(megapixels) FILTER (megapixels BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)), 9) AS whisker_high, "
        "count(*) FILTER (NOT megapixels BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS outliers "
        "FROM feat JOIN q USING (orientation) GROUP BY 1",
    )
)
def box_stats_by_orientation(spark: SparkSession, sf: str) -> DataFrame:
    return B.rounded(P.box_stats(B.feat(spark, sf), "orientation", "megapixels"))


@query(
    having(
        B.GEOM,
        B.PNG,
        then="SELECT (SELECT count(DISTINCT source_shard) FROM geom) AS shards, 0::BIGINT AS bad_shards, count(*) FILTER (error IS NULL) AS decoded_images, "
        "count(*) FILTER (error IS NOT NULL) AS decode_errors, count(*) AS total_rows FROM png",
    )
)
def audit_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.png(spark, sf)
    return P.audit_report(rows, I.image_dims(rows, "payload", jpeg=False), S.bad_shards(spark, f"{sf}/documents.parquet", B.DOCUMENT_SHARD))


@query(
    having(
        B.GEOM, B.PNG,
        "pos AS (SELECT *, row_number() OVER (PARTITION BY source_shard ORDER BY source_row_idx) - 1 AS position FROM png)",
        "taken AS (SELECT * FROM pos ORDER BY source_shard, position LIMIT 5000)",
        then="SELECT 1::BIGINT AS parquet_shards, 0::BIGINT AS parquet_bad_shards, (SELECT count(*) FROM png) AS total_rows, count(*) FILTER (error IS NULL) AS decoded_images, "
        "count(*) FILTER (error IS NOT NULL) AS decode_errors, (SELECT count(DISTINCT style) FROM geom) AS distinct_style_ids, "
        "(SELECT count(*) FROM (SELECT width, height FROM taken WHERE error IS NULL GROUP BY 1, 2 HAVING count(*) > 1)) AS sample_duplicate_hashes, "
        "max(width) FILTER (error IS NULL) AS max_width, CAST(printf('%.2f', avg(height) FILTER (error IS NULL)) AS DOUBLE) AS mean_height, "
        "least(100, count(*) FILTER (error IS NOT NULL)) AS n_errors FROM taken",
    )
)
def audit_document_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of the whole audit document, with payloads decoded within a budget of rows."""
    rows = B.png(spark, sf)
    numbered = running_totals(rows.select("source_shard", "source_row_idx"), ["source_row_idx"], {"at": F.lit(1)}, by=["source_shard"])
    placed = rows.join(numbered.select("source_shard", "source_row_idx", (F.col("at") - 1).alias("position")), ["source_shard", "source_row_idx"])
    parts = A.audit_shards(spark, f"{sf}/orders.parquet", ["o_orderkey"]).withColumn("shard", S.shard_of(F.col("path")))
    sizes = parts.select("shard", "path", "length").distinct().groupBy("shard").agg(F.sum("length").alias("length"))
    audit = parts.drop("path", "length").join(sizes, "shard").withColumnRenamed("shard", "path")
    doc = audit_document(placed, audit, 5000, ["style", "genre"], position="position")
    return doc.select(
        "parquet_shards", "parquet_bad_shards", "total_rows", "decoded_images", "decode_errors", F.col("distinct_style_ids"), "sample_duplicate_hashes",
        F.col("image_width.max").alias("max_width"), F.col("image_height.mean").alias("mean_height"), F.size("errors").cast("bigint").alias("n_errors"),
    )


# Positions, prefixes, formatted reports

POSITIONED = "positioned AS (SELECT *, row_number() OVER (PARTITION BY source_shard ORDER BY source_row_idx) - 1 AS position FROM geom)"


@query(
    having(
        B.GEOM,
        POSITIONED,
        then="SELECT source_shard, source_row_idx, position, width, height FROM positioned ORDER BY source_shard, position LIMIT 7000",
    )
)
def budgeted_prefix(spark: SparkSession, sf: str) -> DataFrame:
    rows = running_totals(B.geom(spark, sf), ["source_row_idx"], {"at": F.lit(1)}, by=["source_shard"])
    rows = rows.withColumn("position", F.col("at") - 1)
    return X.budgeted_prefix(rows, "source_shard", "position", 7000).select("source_shard", "source_row_idx", "position", "width", "height")


@query(having(B.GEOM, then="SELECT source_shard, source_row_idx FROM geom ORDER BY source_shard, source_row_idx LIMIT 1500"))
def capped_rows(spark: SparkSession, sf: str) -> DataFrame:
    return X.cap_rows(B.geom(spark, sf), ORDER, 1500).select(*ORDER)


@query(having(B.GEOM, then="SELECT source_shard, source_row_idx, row_number() OVER (ORDER BY source_shard, source_row_idx) - 1 AS idx FROM geom"))
def dense_row_index(spark: SparkSession, sf: str) -> DataFrame:
    return dense_index(B.geom(spark, sf).select(*ORDER), ORDER)


@query(
    having(
        B.GEOM,
        B.FEAT,
        then="SELECT style, format('{:,}', sum(bytes_size)::BIGINT) AS total_bytes, printf('%.2f', avg((orientation = 'portrait')::INTEGER) * 100) || '%' AS portrait_share, "
        "printf('%.4f', avg(megapixels)) AS mean_megapixels FROM feat GROUP BY 1",
    )
)
def formatted_style_report(spark: SparkSession, sf: str) -> DataFrame:
    is_portrait = (F.col("orientation") == "portrait").cast("double")
    return B.feat(spark, sf).groupBy("style").agg(
        fixed(F.sum("bytes_size"), 0, grouping=True).alias("total_bytes"),
        percent(F.avg(is_portrait)).alias("portrait_share"),
        fixed(F.avg("megapixels"), 4).alias("mean_megapixels"),
    )


@query()
def profile_summary_document(spark: SparkSession, sf: str) -> DataFrame:
    return profile_document(B.docs(spark, sf), "image_hash", ["style", "genre"]).select(F.to_json(F.struct("*")).alias("document"))


PROFILE_LINES = """hc AS (SELECT image_hash, count(*) AS n FROM docs GROUP BY 1),
hs AS (SELECT sum(n)::BIGINT AS total_rows, count(*) AS unique_rows, sum(n - 1)::BIGINT AS duplicate_rows FROM hc),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_hash ORDER BY source_shard, source_row_idx) AS rn FROM docs) WHERE rn = 1),
counts AS (SELECT 'style' AS dim, style AS class_id, count(*) AS n FROM kept GROUP BY 1, 2 UNION ALL SELECT 'genre', genre, count(*) FROM kept GROUP BY 1, 2)"""


@query(
    having(
        B.DOCS,
        PROFILE_LINES,
        BALANCE,
        "g AS (SELECT max(gini) FILTER (dim = 'style') AS sg, max(gini) FILTER (dim = 'genre') AS gg FROM gin)",
        "s AS (SELECT max(n) FILTER (dim = 'style') / sum(n) FILTER (dim = 'style') AS ss, max(n) FILTER (dim = 'genre') / sum(n) FILTER (dim = 'genre') AS gs FROM counts)",
        then="SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS line_no, unnest(["
        "'Total rows scanned: ' || format('{:,}', total_rows), "
        "'Unique rows after exact hash dedupe: ' || format('{:,}', unique_rows), "
        "'Exact duplicates removed: ' || format('{:,}', duplicate_rows) || ' (' || printf('%.2f', duplicate_rows / total_rows * 100) || '%)', "
        "'Concentration: top_style_share=' || printf('%.2f', ss * 100) || '%, top_genre_share=' || printf('%.2f', gs * 100) || '%', "
        "'Imbalance (Gini): style=' || printf('%.3f', sg) || ', genre=' || printf('%.3f', gg)]) AS line FROM hs, g, s",
    )
)
def profile_highlights(spark: SparkSession, sf: str) -> DataFrame:
    return highlights(profile_document(B.docs(spark, sf), "image_hash", ["style", "genre"]))


# Orders as images: those of like width and height count as copies.
FULL = """docs AS (SELECT *, md5((width % 97) || '|' || (height % 89)) AS image_hash FROM feat),
hc AS (SELECT image_hash, count(*) AS n FROM docs GROUP BY 1),
hs AS (SELECT sum(n)::BIGINT AS total_rows, count(*) AS unique_rows, sum(n - 1)::BIGINT AS duplicate_rows FROM hc),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_hash ORDER BY source_shard, source_row_idx) AS rn FROM docs) WHERE rn = 1),
counts AS (SELECT 'style' AS dim, CAST(style AS VARCHAR) AS class_id, count(*) AS n FROM kept GROUP BY 1, 2
  UNION ALL SELECT 'genre', genre, count(*) FROM kept GROUP BY 1, 2 UNION ALL SELECT 'artist', CAST(artist AS VARCHAR), count(*) FROM kept GROUP BY 1, 2),
per AS (SELECT dim, max(n) / sum(n) AS share, count(*) FILTER (n < 20) AS lt_20, count(*) FILTER (n < 50) AS lt_50, count(*) FILTER (n < 100) AS lt_100 FROM counts GROUP BY 1),
orient AS (SELECT string_agg(orientation || '=' || n, ', ' ORDER BY n DESC, orientation) AS mix FROM (SELECT orientation, count(*) AS n FROM kept GROUP BY 1)),
ext AS (SELECT max(megapixels) AS mp, max(aspect_ratio) AS hi, min(aspect_ratio) AS lo FROM kept)"""


def _of_dims(table: str, value: str, form: str, label: str) -> str:
    parts = [f"'{label.format(d)}' || " + form.format(f"(SELECT {value} FROM {table} WHERE dim = '{d}')") for d in ("style", "genre", "artist")]
    return " || ', ' || ".join(parts)


@query(
    having(
        B.GEOM, B.FEAT, FULL, BALANCE,
        then="SELECT CAST(unnest(range(8)) AS INTEGER) AS line_no, unnest(["
        "'Total rows scanned: ' || format('{:,}', total_rows), "
        "'Unique rows after exact hash dedupe: ' || format('{:,}', unique_rows), "
        "'Exact duplicates removed: ' || format('{:,}', duplicate_rows) || ' (' || printf('%.2f', duplicate_rows / total_rows * 100) || '%)', "
        "'Long-tail evidence (unique set): styles<50=' || (SELECT lt_50 FROM per WHERE dim = 'style') || ', styles<100=' || "
        "(SELECT lt_100 FROM per WHERE dim = 'style') || ', artists<20=' || (SELECT lt_20 FROM per WHERE dim = 'artist'), "
        "'Orientation mix (unique set): ' || mix, "
        "'Concentration: ' || " + _of_dims("per", "share", "printf('%.2f', {} * 100) || '%'", "top_{}_share=") + ", "
        "'Imbalance (Gini): ' || " + _of_dims("gin", "gini", "printf('%.3f', {})", "{}=") + ", "
        "'Extremes: max_megapixels=' || printf('%.2f', mp) || ', max_aspect=' || printf('%.2f', hi) || ', min_aspect=' || printf('%.2f', lo)"
        "]) AS line FROM hs, orient, ext",
    )
)
def profile_report_lines(spark: SparkSession, sf: str) -> DataFrame:
    copies = F.md5(F.concat_ws("|", F.col("width") % 97, F.col("height") % 89))
    rows = B.feat(spark, sf).withColumn("image_hash", copies)
    return profile_report(full_profile_document(rows, "image_hash"))
