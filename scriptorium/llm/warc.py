"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans one partition per file (the writer begins a new file every ``roll`` bytes).  Predicates on the record type
and on header fields are pushed down and tested on the headers alone; the block of an unwanted record is skipped, not read,
and with ``payload=false`` no payload leaves the reader, only its digest and length.  Files ending in ``.gz`` are read too.

A writing task makes files of its own; only those of tasks that succeeded are listed in the ``_files-*.json`` of their commit, which readers
follow, so repeated and lost tasks leave nothing behind that counts.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage,
)

from scriptorium.llm.common import written
from scriptorium.session import new_folder

SCHEMA = "warc_type string, record_id string, refers_to string, uri string, date string, payload_digest string, payload_bytes long, payload binary"
HEADERS = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "uri": "WARC-Target-URI",
    "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest",
}
ROLL, DATE = 64_000_000, "1970-01-01T00:00:00Z"
#: Repeated payloads (digest and id, under 100 bytes) up to which they are broadcast.
BROADCAST_ROWS = 200_000


def digest_header(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def digest_hex(header: str | None) -> str | None:
    if not header or not header.lower().startswith("sha1:"):
        return header
    return base64.b32decode(header[5:].upper()).hex()


def record(kind: str, fields: dict[str, str | None], block: bytes, content_type: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields.items() if v is not None]]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def one_line(value: str | None) -> str | None:
    """A header value without line ends."""
    return None if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def manifests(fs: pafs.FileSystem, root: str) -> list[str]:
    """The lists of files of all commits under a folder."""
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(x.path for x in found if x.base_name.startswith("_files-") and x.base_name.endswith(".json"))


def listed(fs: pafs.FileSystem, manifest: str) -> list[str]:
    with fs.open_input_stream(manifest) as f:
        return json.loads(f.readall())


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path, self.roll, self.overwrite = options["path"], int(options.get("roll", ROLL)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                cols = batch.to_pydict()
                for kind, rid, refers, uri, date, digest, length, payload in zip(*(cols[c.split()[0]] for c in SCHEMA.split(", "))):
                    if out is None or size >= self.roll:
                        if out:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc")
                        out, size = fs.open_output_stream(f"{root}/{names[-1]}"), 0
                        size += out.write(record("warcinfo", {"WARC-Date": DATE, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>"}, b"format: WARC/1.1\r\n", "application/warc-fields")) or 0
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
                    fields = {
                        "WARC-Date": date, "WARC-Record-ID": rid, "WARC-Refers-To": refers, "WARC-Target-URI": one_line(uri),
                        "WARC-Payload-Digest": digest_header(bytes.fromhex(digest)),
                    }
                    if kind == "revisit":
                        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    raw = record(kind, fields, head if kind == "revisit" else head + (payload or b""), "application/http; msgtype=response")
                    out.write(raw)
                    size += len(raw)
        finally:
            if out:
                out.close()
        return Files(names)

    def commit(self, messages: list[Files | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root)
        before = manifests(fs, root)
        with fs.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())
        for old in before if self.overwrite else ():
            gone = listed(fs, old)
            fs.delete_file(old)  # first the list, so that no reader follows it to a file that isn't there
            for name in gone:
                fs.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Files | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{root}/{name}")


@dataclass
class File(InputPartition):
    name: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes those on header fields; all others are Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for f in self.filters:
            value = row[f.attribute[0]]
            if value is None or (
                isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value
                or isinstance(f, StringStartsWith) and not value.startswith(f.value)
            ):
                return False
        return True

    def partitions(self) -> list[File]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        commits = manifests(fs, root)
        if commits:
            names = [n for c in commits for n in listed(fs, c)]
        else:
            found = fs.get_file_info(pafs.FileSelector(root))
            names = sorted(x.base_name for x in found if x.base_name.endswith((".warc", ".warc.gz")))
        return [File(n) for n in names]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to read no files
            return
        fs, root = pafs.FileSystem.from_uri(self.path)
        name = f"{root}/{partition.name}"
        if name.endswith(".gz"):
            with fs.open_input_stream(name, compression=None) as raw, gzip.open(raw) as f:
                yield from self.batches(f)
        else:
            with fs.open_input_file(name) as f:
                yield from self.batches(f)

    def batches(self, f) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]
        rows, held = [], 0
        for row in self.records(f):
            rows.append(row)
            held += 200 + len(row["payload"] or b"")
            if held > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

    def records(self, f) -> Iterator[dict]:
        buffer = Lines(f)
        while (head := buffer.head()) is not None:
            fields = {}
            for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
                key, _, value = line.partition(":")
                fields[key.strip().lower()] = value.strip()
            if "content-length" not in fields:
                raise ValueError("a record without Content-Length")
            length = int(fields["content-length"])
            row = {n: fields.get(h.lower()) for n, h in HEADERS.items()}
            row["payload_digest"] = digest_hex(row["payload_digest"])
            if not self.wanted(row):
                buffer.skip(length + 4)
                continue
            block = buffer.take(length)
            buffer.skip(4)
            http, gap, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
            row["payload_bytes"] = len(payload)
            if row["warc_type"] == "revisit":
                for line in http.decode("utf-8", "replace").split("\r\n"):
                    if line.lower().startswith("content-length:"):
                        row["payload_bytes"] = int(line[15:])
            elif row["warc_type"] == "response":
                found = hashlib.sha1(payload).hexdigest()
                if row["payload_digest"] not in (None, found):
                    raise ValueError(f"record {row['record_id']}: its payload does not match its digest")
                row["payload_digest"] = found
            row["payload"] = payload if self.payload and row["warc_type"] == "response" else None
            yield row


class Lines:
    """Headers and blocks of a stream, read a megabyte at a time."""

    def __init__(self, f, size: int = 1 << 20):
        self.f, self.size, self.held, self.at = f, size, b"", 0

    def more(self) -> bool:
        new = self.f.read(self.size)
        self.held, self.at = self.held[self.at :] + new, 0
        return bool(new)

    def head(self) -> bytes | None:
        while (end := self.held.find(b"\r\n\r\n", self.at)) < 0:
            if not self.more():
                return None
        out, self.at = self.held[self.at : end], end + 4
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out, self.at = self.held[self.at : self.at + n], self.at + n
        return out

    def skip(self, n: int) -> None:
        here = min(n, len(self.held) - self.at)
        self.at += here
        if n > here:
            self.f.seek(n - here, 1) if self.f.seekable() else self.f.read(n - here)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def as_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """One WARC record per page, in the columns of SCHEMA; null html is empty.

    Of equal payloads of at least ``least`` bytes, the page of largest id is the response and others revisit it; rows that
    share that id are all responses, and a null id counts as less than any.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    src = pages.select(F.col(page_id).alias("id"), F.col(url).alias("uri"), body.alias("payload"))
    src = src.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    many = src.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("id").alias("lead"), F.count("*").alias("n"))
    many = written(many.where(F.col("n") > 1).select("payload_digest", "lead"))
    few = many.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    all_of = src.join(F.broadcast(many) if few else many, "payload_digest", "left")
    again = F.col("lead").isNotNull() & ~F.col("id").eqNullSafe(F.col("lead")) & (F.col("payload_bytes") >= least)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return all_of.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"), urn(F.col("id")).alias("record_id"),
        F.when(again, urn(F.col("lead"))).alias("refers_to"), "uri", F.lit(DATE).alias("date"), "payload_digest", "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write(records: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Add archives to a folder, or, with mode ``overwrite``, replace those that earlier writes have listed there."""
    register(records.sparkSession)
    records.write.format("warc").options(path=path, **options).mode(mode).save()


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """All records that have a type, as all valid ones do.

    The filter is there for Spark's sake: a scan without any would take over what an earlier scan of the frame pushed down.
    """
    register(spark)
    return spark.read.format("warc").options(path=path, **options).load().where(F.col("warc_type").isNotNull())


def page_number(urn: Column) -> Column:
    """The page id in a record's name; null for none."""
    return F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def archived(pages: DataFrame, path: str | None = None, **names: str) -> DataFrame:
    """Write the pages as archives under ``path`` (a new shared folder if none) and read them back without payloads."""
    path = path or new_folder(pages.sparkSession)
    write(as_records(pages, **names), path)
    back = read(pages.sparkSession, path, payload="false").where(F.col("warc_type").isin("response", "revisit"))
    return back.select(
        page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"),
        page_number(F.col("refers_to")).alias("refers_to"), "uri",
    )
