import gzip
import io
import os
import zlib

import duckdb
import pytest

from ratingloom.llm import warc as W
from ratingloom.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def test_against_sql(spark):
    found = QUERIES["op3_warc"](spark, DATA).toPandas().sort_values("page_id").reset_index(drop=True)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = db.execute(ORACLE["op3_warc"]).df().sort_values("page_id").reset_index(drop=True)
    for c in want.columns:
        assert ((found[c] == want[c]) | (found[c].isna() & want[c].isna())).all(), c


@pytest.fixture(scope="module")
def odd(spark):
    big = "é" * 600
    rows = [(1, "http://a/x y", big), (2, "http://b", big), (7, None, big), (3, "", None), (4, "u\r\nInjected: 1", "")]
    rows += [(5, "u", "z" * 999), (6, "u", "z" * 999), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 90), (9, "u", "q" * 3_000_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("split", [100, 1000, 16 << 20])
def test_every_record_is_read_once(spark, odd, tmp_path, split):
    path = str(tmp_path / "archive")
    W.write_archive(odd.withColumnRenamed("html", "html").selectExpr("*", "1 AS digest", "2 AS n"), path)
    assert all(n.endswith(".warc.gz") for n in os.listdir(path) if n.startswith("part"))
    params = W.WarcParams(split=split, chunk=64 if split == 100 else 4096)
    small = odd.where("page_id <> 9") if split == 100 else odd
    if split == 100:
        path = str(tmp_path / "small")
        W.write_archive(small, path)
    rows = {r["page_id"]: r for r in W.page_digests(W.read_archive(spark, path, params)).collect()}
    assert len(rows) == small.count()
    assert [rows[i]["refers_to"] for i in (1, 2, 7)] == [7, 7, None]
    assert {rows[i]["record_type"] for i in (3, 4, 5, 6, 7, 8)} == {"response"}
    assert rows[1]["payload_bytes"] == rows[7]["payload_bytes"] == 1200 and rows[3]["payload_bytes"] == 0
    assert rows[1]["payload_digest"] == rows[7]["payload_digest"]
    assert all(r["intact"] is not False for r in rows.values())


def test_files_are_valid_gzip(odd, tmp_path):
    W.write_archive(odd.where("page_id < 4"), str(tmp_path / "a"))
    whole = b"".join(gzip.decompress((tmp_path / "a" / n).read_bytes()) for n in os.listdir(tmp_path / "a") if n[:4] == "part")
    assert whole.count(b"WARC/1.1\r\n") == 3 and b"\r\nInjected" not in whole


def test_reader_passes_over_false_starts():
    """Magic numbers in damaged or foreign data are not records, whatever range they are in."""

    def member(data):
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        return packer.compress(data) + packer.flush()

    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\n" + W.MAGIC + b"xx\r\n\r\n"
    data = b"junk" + W.MAGIC + b"junk" + member(record) + W.EMPTY_MEMBER + member(b"no archive") + member(record)
    for split in (1, 7, 50, 1000):
        file = io.BytesIO(data)
        found = [r for s in range(0, len(data), split) for r in W.records(file, s, s + split, 16)]
        assert [r["fields"]["warc-type"] for r in found] == ["resource"] * 2


def test_empty_table(spark, odd, tmp_path):
    W.write_archive(odd.limit(0), str(tmp_path / "none"))
    assert W.page_digests(W.read_archive(spark, str(tmp_path / "none"))).count() == 0
