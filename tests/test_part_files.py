"""Tables stored as folders of part files give the rows of the same tables stored as one file."""

from __future__ import annotations

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract
from limner.catalog import data
from limner.catalog.bindings import TABLES
from tests.conftest import TESTDATA
from tests.test_catalog import _sorted

PARTED = ("documents", "embeddings", "orders")
READ_AS_SHARDS = (
    "shard_scan_with_locator shard_row_counts streamed_rows_cache streamed_cache_resumed streamed_first_rows streamed_unique_hashes streamed_class_counts "
    "streamed_quarantine streamed_scores streamed_accuracy streamed_progress audit_report audit_document_fields"
).split()


@pytest.fixture(scope="module")
def parted(tmp_path_factory):
    """sf0.001 with some tables cut into three parts of unequal size."""
    root = tmp_path_factory.mktemp("parted")
    con = duckdb.connect()
    for t in TABLES:
        source = f"{TESTDATA}/sf0.001/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{source}'")
        if t not in PARTED:
            (root / f"{t}.parquet").symlink_to(source)
            continue
        rows, cuts = pq.read_table(source), (0, 50, 90, None)
        (root / f"{t}.parquet").mkdir()
        for i in range(3):
            part = rows.slice(cuts[i], None if cuts[i + 1] is None else cuts[i + 1] - cuts[i])
            pq.write_table(part, root / f"{t}.parquet" / f"part-{i:04d}.parquet")
    return str(root), con


@pytest.mark.parametrize("name", READ_AS_SHARDS)
def test_parts_are_read_as_one_table(spark, parted, name):
    root, con = parted
    df = contract.queries()[name](spark, root)
    expected = con.sql(contract.oracle_sql()[name])
    assert _sorted(df.columns, df.collect()) == _sorted(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", [n for n in READ_AS_SHARDS if n.startswith("streamed_") and n not in ("streamed_scores", "streamed_accuracy")])
def test_streams_of_tables_without_files(spark, tmp_path, name):
    con = duckdb.connect()
    for t in ("documents", "orders"):
        (tmp_path / f"{t}.parquet").mkdir()
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/sf0.001/{t}.parquet' LIMIT 0")
    if name == "streamed_rows_cache":  # its positions are counted in a scan
        pq.write_table(pq.read_table(f"{TESTDATA}/sf0.001/documents.parquet").slice(0, 0), tmp_path / "documents.parquet" / "part-0.parquet")
    df = contract.queries()[name](spark, str(tmp_path))
    assert df.collect() == con.sql(contract.oracle_sql()[name]).fetchall()


def test_damaged_shards_are_written_and_broken_in_many_files(spark, parted, tmp_path, monkeypatch):
    root, con = parted
    written = tmp_path / "copy"
    monkeypatch.setattr(data, "scratch_path", lambda spark, label: str(written))
    monkeypatch.setattr(data, "local_shards", lambda root, part, found=data.local_shards: [_cut_into_groups(f) for f in found(root, part)])
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task for each part
    try:
        got = sorted(tuple(r) for r in data.damaged_shards(spark, root).collect())
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(list(written.glob("part=1/*.parquet"))) == 3
    assert got == sorted(con.sql(contract.oracle_sql()["damaged_shards"]).fetchall())


def _cut_into_groups(path: str) -> str:
    pq.write_table(pq.ParquetFile(path).read(), path, row_group_size=5, write_page_checksum=True)
    return path
