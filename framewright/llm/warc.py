"""WARC archives: written by Spark's own text writer, read by a Python data source.

Writing: every row becomes one record whose parts are UTF-8, so a record is a line of Spark's
text sink with the WARC end mark as its line end; commits and retries are Spark's. A payload that
an earlier record of the archive holds is written as a revisit, without the payload.

Reading: the data source plans one partition per archive file, takes record-type and header
equalities from the query's filters, parses a record's headers first, and skips over payloads that
the filters or the options leave out.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from .storage import saved, shared_dir

MIN_REVISIT_BYTES = 100
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Records of one archive file at most; a file is read by one task.
FILE_RECORDS = 50_000
#: Repeated payloads that are broadcast, 100 bytes each; more are joined by shuffle.
BROADCAST_GROUPS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload string, content_sha256 string"


def records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) -> page_id, payload_bytes, payload_digest, record_type, refers_to, record (the WARC text).

    Null html is an empty payload. Payloads shorter than min_bytes are always responses; of longer equal ones those with
    the smallest page_id are responses and the others revisit it. A null page_id comes after all others.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html")).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    rows = rows.withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    groups = saved(groups.where("n > 1 and least is not null").select("payload_digest", "least"), "repeated-payloads")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)  # then the payloads are not shuffled
    rows = rows.join(groups, "payload_digest", "left")
    revisit = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    rows = rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("least")))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "%", "%25"), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), "record_type", F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), "payload_digest",
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("least")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.concat(head, block, F.lit("\r\n\r")).alias("record"))


def write(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes the archive of pages to a new folder, a file for each input partition or FILE_RECORDS records.

    Nulls, short payloads and repeats are as in records; repeated rows give repeated records, an empty table a folder without records.
    Other columns of pages are ignored.
    """
    made = records(pages, min_bytes).select("record")
    made.write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


@dataclass
class _File(InputPartition):
    path: str


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, inner


def _headers(stream) -> dict[str, str] | None:
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record where one should start: {line[:40]!r}")
    out = {}
    while (line := stream.readline().rstrip(b"\r\n")) :
        key, _, value = line.partition(b":")
        out[key.strip().lower().decode(errors="replace")] = value.strip().decode(errors="replace")
    return out


class _Buffered:
    """Reads lines and bytes of a seekable file, and skips without reading."""

    def __init__(self, handle, size: int = 1 << 20):
        self.handle, self.size, self.data, self.at = handle, size, b"", 0

    def readline(self) -> bytes:
        parts = []
        while True:
            end = self.data.find(b"\n", self.at)
            if end >= 0:
                parts.append(self.data[self.at : end + 1])
                self.at = end + 1
                return b"".join(parts)
            parts.append(self.data[self.at :])
            self.data, self.at = self.handle.read(self.size), 0
            if not self.data:
                return b"".join(parts)

    def read(self, n: int) -> bytes:
        have = self.data[self.at : self.at + n]
        self.at += len(have)
        return have if len(have) == n else have + self.handle.read(n - len(have))

    def skip(self, n: int) -> None:
        have = min(n, len(self.data) - self.at)
        self.at += have
        if n > have:
            self.handle.seek(n - have, 1)


#: Columns that a header gives, so that an equality on them is decided before the payload; fixed names.
_HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.digest = options.get("digest", "false").lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in _HEADER_OF and isinstance(f.value, str):
                self.wanted.setdefault(f.attribute[0], set()).add(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, inner = _open(self.path)
        if fs.get_file_info(inner).type == pafs.FileType.File:
            return [_File(self.path)]
        prefix = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else "file://"
        files = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(inner)) if x.type == pafs.FileType.File and x.size and x.base_name[0] not in "._")
        return [_File(prefix + x) for x in files]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        fs, inner = _open(partition.path)
        rows, held = [], 0
        with fs.open_input_file(inner) as handle:
            stream = _Buffered(gzip.GzipFile(fileobj=handle) if inner.endswith(".gz") else handle)  # GzipFile reads member after member
            while (head := _headers(stream)) is not None:
                n = int(head.get("content-length", "0"))
                row = self._described(head)
                if any({row[c]} != v for c, v in self.wanted.items()):
                    stream.skip(n)
                    continue
                content = b""
                if not head.get("content-type", "").startswith("application/http"):
                    content, n = (stream.read(n), 0) if self.payload or self.digest else (b"", n)
                    row["payload_bytes"] = int(head.get("content-length", "0"))
                else:
                    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                        n -= len(line)
                        key, _, value = line.partition(b":")
                        if key.lower() == b"content-length":
                            row["payload_bytes"] = int(value)
                    n -= len(line)
                    if row["record_type"] != "revisit" and (self.payload or self.digest):
                        content, n = stream.read(n), 0
                stream.skip(n)
                whole = row["record_type"] != "revisit"
                row["payload"] = content.decode("utf-8", "replace") if self.payload and whole else None
                row["content_sha256"] = hashlib.sha256(content).hexdigest() if self.digest and whole else None
                rows.append(row)
                held += len(content)
                if len(rows) >= 2000 or held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    @staticmethod
    def _described(head: dict[str, str]) -> dict:
        row = {c: head.get(h) for c, h in _HEADER_OF.items()}
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
        if row["target_uri"] is not None:
            row["target_uri"] = row["target_uri"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        return row | {"payload_bytes": None}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    text = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload", "content_sha256")
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.record_batch([pa.array([r[c] for r in rows], pa.string() if c in text else pa.int64()) for c in names], names=names)


class WarcSource(DataSource):
    """format("warc"): options path, payload (false: payloads are skipped), digest (true: content_sha256 of each payload)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read(spark: SparkSession, path: str, payload: bool = True, digest: bool = False) -> DataFrame:
    """The records of an archive folder or file (.gz: gzip members): see SCHEMA. Filters on record type and headers are pushed down.

    Headers and payloads that aren't UTF-8 are decoded with replacement characters. A folder without files gives no rows.
    """
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("digest", str(digest).lower()).load(path)


def digest(pages: DataFrame) -> DataFrame:
    """Writes the archive, reads it back, and gives for each page what its record says.

    A response's digest and length are those of the payload read back; a revisit's are its headers', which are those of
    the response that it refers to.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    number = lambda c: F.when(F.col(c) != "<urn:page:null>", F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).cast("long"))
    found = read(spark, path, payload=False, digest=True)
    return found.select(
        number("record_id").alias("page_id"), "payload_bytes", F.coalesce("content_sha256", "payload_digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to")
    )


