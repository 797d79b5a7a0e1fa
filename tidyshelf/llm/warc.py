"""WARC archives: a writer with revisit records and a sequential reader.

One gzip member holds one record. The reader inflates step by step, takes the header up to the empty
line, frames the block by Content-Length, checks the payload digest, and goes on with the next member;
it never holds more than one record and one chunk of the file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyshelf.llm.common import text_of
from tidyshelf.storage import Workspace

#: Payloads below this size are always stored.
MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 18

RECORD_SCHEMA = (
    "record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, "
    "payload_digest string, payload binary"
)


def _open(uri: str):
    """The file system and path of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _urn(record_id: str | None) -> str:
    return "urn:no-page" if record_id is None else f"urn:page:{quote(record_id, safe='')}"


def _id_of(urn: str | None) -> str | None:
    return unquote(urn[len("<urn:page:"):-1]) if urn and urn.startswith("<urn:page:") else None


def record_bytes(record_type: str, record_id: str | None, uri: str | None, digest: str, payload: bytes, length: int,
                 refers_to: str | None = None) -> bytes:
    """One record as its own gzip member. A revisit has an empty block and states the payload's length.

    Ids are percent-encoded; a null id has a name that no id gets.
    """
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{_urn(record_id)}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_urn(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"X-Payload-Length: {length}"]
    block = b"" if refers_to is not None else payload
    head.append(f"Content-Length: {len(block)}")
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    return b"".join(deflate.compress(p) for p in ("\r\n".join(head).encode() + b"\r\n\r\n", block, b"\r\n\r\n")) + deflate.flush()


class _Member:
    """The bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, source, carried: bytes):
        self.source, self.raw, self.inflate, self.ready = source, carried, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        """Inflate one more step; False at the member's end."""
        if self.inflate.eof:
            return False
        if not self.raw:
            self.raw = self.source.read(CHUNK)
            if not self.raw:
                raise ValueError("the archive ends inside a record")
        self.ready += self.inflate.decompress(self.raw, CHUNK)
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.ready.find(mark)) < 0:
            if not self.more():
                raise ValueError("a record without an end of its header")
        out = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.more():
                raise ValueError("a block shorter than its Content-Length")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def rest(self) -> bytes:
        """Go to the member's end; what the file holds after it and was read already."""
        while self.more():
            pass
        if bytes(self.ready) != b"\r\n\r\n":
            raise ValueError("a block longer than its Content-Length")
        return self.raw


def read_records(source) -> Iterator[dict]:
    """The records of an open archive, in order. A wrong frame or digest raises ValueError."""
    carried = source.read(CHUNK)
    while carried:
        member = _Member(source, carried)
        version, *lines = member.until(b"\r\n\r\n").decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        payload = member.exactly(int(head["content-length"]))
        carried = member.rest() or source.read(CHUNK)
        digest = head["warc-payload-digest"].removeprefix("sha256:")
        revisit = head["warc-type"] == "revisit"
        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload digest of {head['warc-record-id']} does not match")
        yield {
            "record_type": head["warc-type"], "record_id": _id_of(head.get("warc-record-id")), "target_uri": head.get("warc-target-uri"),
            "refers_to": _id_of(head.get("warc-refers-to")), "payload_digest": digest, "payload": None if revisit else payload,
            "payload_bytes": int(head["x-payload-length"]) if revisit else len(payload),
        }


def _write(folder: str, archive_bytes: int):
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        out, name, records, size, done = None, "", 0, 0, []

        def close():
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", records, size))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None or size >= archive_bytes:
                    close()
                    # a name of its own for each attempt: a lost attempt's file is in no manifest
                    name, records, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                html = row["html"] or b""
                raw = record_bytes(row["record_type"], row["record_id"], row["url"], row["digest"], html, len(html), row["refers_to"])
                out.write(raw)
                records, size = records + 1, size + len(raw)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done) if done else ([], [], []), schema, strict=True)], schema=schema)

    return task


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str | None = "url", html_col: str = "html",
               least: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, workspace: Workspace | None = None) -> DataFrame:
    """Write a record per row into archives below ``folder``; returns the manifest: path, records, bytes.

    Of rows with equal payloads of at least ``least`` bytes, that with the smallest id is a response and
    the others revisit it. Null payloads are empty; rows with a null id are always responses, are never
    referred to, and are read back with a null id; rows that repeat the smallest id are responses too. An empty table writes no archive.
    """
    store = workspace or Workspace(df.sparkSession)
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"), (F.col(f"`{url_col}`").cast("string") if url_col else F.lit(None).cast("string")).alias("url"),
        text_of(html_col).cast("binary").alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    # one row per repeated payload, written first: the join's large side can then be split where a payload is hot
    firsts = store.freeze(
        rows.filter((F.octet_length("html") >= least) & F.col("id").isNotNull())
        .groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"),
        "firsts",
    )
    revisit = F.col("first").isNotNull() & (F.col("id") != F.col("first"))
    records = rows.join(firsts, "digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("id").cast("string").alias("record_id"),
        "url", "digest", "html", F.when(revisit, F.col("first").cast("string")).alias("refers_to"),
    )
    return store.freeze(records.mapInArrow(_write(folder, archive_bytes), "path string, records long, bytes long"), "manifest")


def _read(with_payload: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"payload_bytes": pa.int64(), "payload": pa.binary()}.get(n, pa.string())) for n in
                            ("record_type", "record_id", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload")])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = _open(path)
                with files.open_input_stream(at, compression=None) as source:
                    held, size = [], 0
                    for record in read_records(source):
                        size += record["payload_bytes"] if with_payload else 200
                        held.append(record if with_payload else record | {"payload": None})
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return task


def read_warc(spark: SparkSession, archives: DataFrame | list[str], with_payload: bool = True) -> DataFrame:
    """The records of archives, given as a table with a column ``path`` or as a list of paths.

    Columns: record_type, record_id, target_uri, refers_to, payload_bytes, payload_digest, payload (null
    for revisits). Broken framing or a wrong digest fails the read.
    """
    if isinstance(archives, list):
        archives = spark.createDataFrame([(p,) for p in archives], T.StructType([T.StructField("path", T.StringType())]))
    paths = archives.select("path")
    return paths.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(_read(with_payload), RECORD_SCHEMA)
