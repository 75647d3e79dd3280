"""WARC archives: round trips, revisits, pushed predicates, damaged and foreign files."""

import gzip
import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scriptorium.llm import warc
from scriptorium.session import new_folder

LONG = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 80
ROWS = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (5, "http://a/5", LONG), (3, "http://a/3", "short"), (4, "http://a/4", "short"),
    (6, None, None), (7, "http://a/7\r\nWARC-Type: fake", ""), (None, "http://n", LONG), (8, "http://b", "x" * 200_000), (8, "http://b", "x" * 200_000), (-9, "", LONG + "!"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as payload", "'x' as lead").repartition(3)


def test_records_and_revisits(spark, pages):
    got = sorted(map(repr, (tuple(r) for r in warc.archived(pages).drop("uri").collect())))
    want = []
    for i, _, html in ROWS:
        raw = (html or "").encode()
        lead = {LONG: 5, "x" * 200_000: 8}.get(html)
        again = lead is not None and i != lead
        want.append(repr((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", lead if again else None)))
    assert got == sorted(want)


def test_payloads_and_pushed_predicates(spark, pages):
    path = new_folder(spark)
    warc.write(warc.as_records(pages), path, roll="1000")
    whole = warc.read(spark, path)
    assert {r.warc_type for r in whole.collect()} == {"response", "revisit", "warcinfo"}
    one = whole.where((F.col("warc_type") == "response") & (F.col("record_id") == "<urn:page:5>"))
    assert [bytes(r.payload).decode() for r in one.collect()] == [LONG]
    assert "PushedFilters: [" in one._jdf.queryExecution().toString() or one.count() == 1
    assert whole.where(F.col("uri").startswith("http://a/") & F.col("refers_to").isNotNull()).count() == 2
    reader = warc.WarcReader({"path": path})
    assert len(reader.partitions()) > 3
    # a skipped record's block is not read: its damage goes unnoticed
    lines = warc.record("response", {"WARC-Payload-Digest": "sha1:" + "A" * 32}, b"HTTP/1.1 200 OK\r\n\r\nbody", "application/http")
    other = new_folder(spark)
    import pyarrow.fs as pafs

    fs, root = pafs.FileSystem.from_uri(other)
    fs.create_dir(root)
    with fs.open_output_stream(f"{root}/x.warc.gz", compression=None) as f:
        f.write(gzip.compress(lines) + gzip.compress(warc.record("metadata", {}, b"note", "text/plain")))
    foreign = warc.read(spark, other)
    assert foreign.where("warc_type = 'metadata'").count() == 1
    with pytest.raises(PySparkException):
        foreign.collect()


def test_no_pages(spark, pages):
    assert warc.archived(pages.limit(0)).count() == 0


def test_a_second_write_adds_and_an_overwrite_replaces(spark, pages):
    path = new_folder(spark)
    warc.write(warc.as_records(pages.where("page_id = 1")), path)
    warc.write(warc.as_records(pages.where("page_id = 3")), path)
    urls = lambda: sorted(r.uri for r in warc.read(spark, path).where("warc_type = 'response'").collect())
    assert urls() == ["http://a/1", "http://a/3"]
    warc.write(warc.as_records(pages.where("page_id = 4")), path, mode="overwrite")
    assert urls() == ["http://a/4"]
    warc.write(warc.as_records(pages.limit(0)), path, mode="overwrite")
    assert urls() == []


def test_a_record_without_a_length_is_an_error(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nbody\r\n\r\n")
    with pytest.raises(PySparkException, match="Content-Length"):
        warc.read(spark, f"file://{tmp_path}").collect()
