"""WARC archives as a Python data source: written record by record, read back headers first."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import prepare, shared_path

#: Bytes after which a task begins another file; files are the partitions of a read.
FILE_BYTES = 128 << 20
#: Rows of firsts (digest and id) up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Each committed write adds a manifest of its files; a folder without any is read whole.
MANIFEST = "files-"
ARCHIVE = ".warc.gz"
#: Bytes that are decompressed at once while a record's headers are read.
HEAD = 4096
#: Columns that come from one named header each.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", headers map<string,string>, payload binary"


def _store(path: str):
    """The pyarrow file system and path of a URI or plain path, so that archives can lie wherever executors share a store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# Records on disk. Each record is one gzip member whose extra field "sl" holds the member's length, so that readers can pass over it.


def member(data: bytes) -> bytes:
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    size = 10 + 2 + 12 + len(packed) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF)
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {re.sub('[\r\n]+', ' ', v)}\r\n" for k, v in headers.items())
    return b"WARC/1.1\r\n" + lines.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_headers(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        if name:
            out[name] = value.strip()
    return out


@dataclass
class Wanted:
    """What a read asks for: header values by column, and whether payloads are decoded."""

    values: dict[str, list[str]]
    payload: bool

    def takes(self, headers: dict[str, str]) -> bool:
        return all(headers.get(HEADERS[c]) in v for c, v in self.values.items())


class Member:
    """A gzip member of an open archive, decompressed piece by piece, never further than asked for."""

    def __init__(self, f, at: int):
        f.seek(at)
        first = f.read(1 << 14)
        self.f, self.fed, self.out = f, len(first), 0
        self.length = struct.unpack("<I", first[16:20])[0] if len(first) > 20 and first[3] & 4 and first[12:14] == b"sl" else None
        self.d, self.rest = zlib.decompressobj(31), first

    def piece(self, most: int) -> bytes:
        """Up to `most` more bytes; none at the end."""
        while not self.d.eof:
            if not self.rest:
                self.rest = self.f.read(1 << 16)
                self.fed += len(self.rest)
                if not self.rest:
                    raise ValueError("archive ends within a record")
            data = self.d.decompress(self.rest, most)
            self.rest = self.d.unconsumed_tail
            if data:
                self.out += len(data)
                return data
        return b""

    def beginning(self) -> tuple[dict[str, str], bytes]:
        """The headers, and what of the block came with them."""
        data = b""
        while b"\r\n\r\n" not in data and (more := self.piece(HEAD)):
            data += more
        head, _, block = data.partition(b"\r\n\r\n")
        return parse_headers(head), block

    def size(self) -> int:
        """Bytes of the member: from its extra field, or, in archives of others, by decompressing it."""
        if self.length is None:
            while self.piece(1 << 20):
                pass
            self.length = self.fed - len(self.d.unused_data)
        return self.length


def read_records(f, wanted: Wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the wanted records of an open archive of gzip members.

    Of a record that isn't wanted, or wanted without payload, HEAD bytes or so are
    decompressed for its headers; the rest is passed over by the length in its extra
    field. Only archives without that field are decompressed to the member's end.
    """
    size, at = f.size(), 0
    while at < size:
        member = Member(f, at)
        headers, block = member.beginning()
        want = wanted.takes(headers)
        if want and wanted.payload:
            parts = [block]
            while more := member.piece(1 << 20):
                parts.append(more)
            block = b"".join(parts)
        at += member.size()
        if want:
            yield headers, _payload(headers, block) if wanted.payload else None


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    block = block[: int(headers.get("Content-Length", 0))]
    if headers.get("Content-Type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


@dataclass
class ArchiveFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.wanted = options["path"], Wanted({}, str(options.get("payload", "false")).lower() == "true")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership tests on header columns; yields what Spark must still test."""
        for x in filters:
            column = x.attribute[0] if len(getattr(x, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(x, (EqualTo, In)):
                values = [x.value] if isinstance(x, EqualTo) else list(x.value)
                old = self.wanted.values.get(column, values)
                self.wanted.values[column] = [v for v in values if v in old]
            else:
                yield x

    def partitions(self) -> list[ArchiveFile]:
        """The files that committed writes list, or all archives of a folder that none of them made."""
        return [ArchiveFile(n) for n in _listed(*_store(self.path))]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        store, base = _store(self.path)
        kinds = pa.schema([*((c, pa.string()) for c in HEADERS), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        with store.open_input_file(f"{base}/{partition.path}") as f:
            rows, held = [], 0
            for headers, payload in read_records(f, self.wanted):
                rows.append([*(headers.get(h) for h in HEADERS.values()), list(headers.items()), payload])
                held += len(payload or b"") + 500
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)


def _manifests(store, base: str) -> list[str]:
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(x.path for x in found if x.base_name.startswith(MANIFEST) and x.base_name.endswith(".json"))


def _listed(store, base: str) -> list[str]:
    from pyarrow import fs

    if made := _manifests(store, base):
        names = []
        for path in made:
            with store.open_input_stream(path) as f:
                names += json.loads(f.read())
        return sorted(names)
    found = store.get_file_info(fs.FileSelector(base))
    return sorted(x.base_name for x in found if x.base_name.endswith(ARCHIVE))


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceWriter):
    """A file or more for each task, under new names for each attempt; only what the driver's commit lists counts."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator[Row]) -> Written:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        files, out = [], None
        try:
            for r in rows:
                if out is None or out.tell() >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    context = TaskContext.get()
                    files.append(f"part-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}{ARCHIVE}")
                    out = store.open_output_stream(f"{base}/{files[-1]}", compression=None)
                out.write(member(record(*_headers(r))))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        old = _manifests(store, base)
        gone = _listed(store, base) if self.overwrite else []
        with store.open_output_stream(f"{base}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.files)).encode())
        if self.overwrite:
            new = {n for m in messages if m for n in m.files}
            for path in [*old, *(f"{base}/{n}" for n in gone if n not in new)]:
                store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        for n in (n for m in messages if m for n in m.files):
            store.delete_file(f"{base}/{n}")


def _headers(r: Row) -> tuple[dict[str, str], bytes]:
    """A record's headers and block: an HTTP message with the payload, or with none for a revisit."""
    out = {h: r[c] for c, h in HEADERS.items() if r[c] is not None}
    out |= {k: v for k, v in (r["headers"] or {}).items() if v is not None}
    if r["record_type"] not in ("response", "revisit"):
        return out, bytes(r["payload"] or b"")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if r["record_type"] == "revisit":
        out["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    out["Content-Type"] = "application/http; msgtype=response"
    return out, http + (bytes(r["payload"] or b"") if r["record_type"] == "response" else b"")


class WarcSource(DataSource):
    """format("warc"): option path; for reads, payload=true decodes payloads (null otherwise)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write a record per row of pages (page_id, url, html) to archives under path.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of
    `least` bytes or more the one with the smallest page_id is a response, the
    others revisit it. Payloads are compared by SHA-1. A null page_id comes last:
    it revisits if its group has any id, else it is a response. Rows with equal
    payload and the group's smallest page_id, repeated rows that is, are all responses.
    Null urls leave the header out; line ends in them become spaces. Ids of any type
    are kept as they are. Payloads may be of any length. Other columns, whatever
    their names, are left out. No rows give archives without records.
    """
    names = {"page_id", "url", "html"}
    rows = pages.toDF(*[c if c in names else f"__extra_{i}" for i, c in enumerate(pages.columns)])
    url = F.col("url").cast("string") if "url" in rows.columns else F.lit(None).cast("string")
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = rows.select("page_id", url.alias("url"), html.alias("payload")).withColumn("sha1", F.sha1("payload"))
    own = rows.where(F.octet_length("payload") >= least).select("page_id", "sha1")
    firsts = own.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("sha1", "first")
    few = firsts.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(firsts) if few else firsts, "sha1", "left")
    late = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(F.col(c).cast("string")), F.lit(">")), F.lit("<urn:page>"))
    records = rows.select(
        F.when(late, "revisit").otherwise("response").alias("record_type"),
        urn("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha1:"), F.col("sha1")).alias("payload_digest"),
        F.when(late, urn("first")).alias("refers_to"),
        F.create_map(F.lit("X-Payload-Length"), F.octet_length("payload").cast("string")).alias("headers"),
        F.when(~late, F.col("payload")).alias("payload"),
    )
    base32(records).write.format("warc").mode("append").option("path", path).save()


def base32(records: DataFrame) -> DataFrame:
    """records with hexadecimal digests in the base32 that WARC uses: 40 bits become 8 letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    value = lambda k: F.conv(F.substring("payload_digest", 6 + 10 * k, 10), 16, 10).cast("long")
    letter = lambda k, j: F.substring(F.lit(letters), F.shiftright(value(k), 35 - 5 * j).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
    return records.withColumn("payload_digest", F.concat(F.lit("sha1:"), *[letter(k, j) for k in range(4) for j in range(8)]))


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def archived(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each row of pages, written to WARC and read back (see write_pages).

    Responses are read with their payloads, whose length and digest are taken from
    the bytes read; revisits without.
    """
    spark = pages.sparkSession
    register(spark)
    path = path or shared_path(spark, "warc")
    write_pages(pages, path, least)
    kind = pages.schema["page_id"].dataType.simpleString()
    page = lambda c: F.url_decode(F.regexp_extract(c, "^<urn:page:(.*)>$", 1))
    full = read_archives(spark, path, True).where("record_type = 'response'")
    full = base32(full.withColumn("payload_digest", F.concat(F.lit("sha1:"), F.sha1("payload")))).withColumn("bytes", F.octet_length("payload").cast("long"))
    rest = read_archives(spark, path).where("record_type = 'revisit'").withColumn("bytes", F.col("headers")["X-Payload-Length"].cast("long"))
    both = full.drop("payload", "headers").unionByName(rest.drop("payload", "headers"))
    known = F.when(F.col("record_id") != "<urn:page>", page("record_id"))
    return both.select(known.cast(kind).alias("page_id"), F.col("bytes").alias("payload_bytes"), F.substring("payload_digest", 6, 32).alias("payload_digest"), "record_type", F.when(F.col("refers_to").isNotNull(), page("refers_to")).cast(kind).alias("refers_to"))
