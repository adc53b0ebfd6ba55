"""WARC archives: one gzip member per record, written and read sequentially by Spark tasks.

Archives live in a folder that all executors share, addressed by a URI that pyarrow's file systems open. A task writes
its rows to files whose names hold the task attempt, and the table of finished files (the manifest) is what readers
follow, so files of lost or repeated attempts are never read. Reading decompresses member by member in small chunks and
frames blocks by Content-Length; no archive is ever held whole.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.scale import fits_broadcast, spread, work_path
from ragloom.llm.common import Scratch, join_groups, pieces

CHUNK = 1 << 16
#: An archive is closed once it has this many compressed bytes.
ARCHIVE_BYTES = 1 << 30
#: Payload bytes that one output batch of the reader holds before it is passed on.
BATCH_BYTES = 8 << 20
REVISIT_BYTES = 1_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "archive string, records long, bytes long"
RECORDS = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
    ("target_uri", pa.string()), ("refers_to_id", pa.string()), ("payload_digest", pa.string()),
    ("payload_length", pa.int64()), ("digest_ok", pa.bool_()), ("payload", pa.binary()),
])
RECORDS_DDL = (
    "archive string, offset long, record_type string, record_id string, target_uri string, refers_to_id string, "
    "payload_digest string, payload_length long, digest_ok boolean, payload binary"
)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, record_id: str, uri: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC record, not compressed. A revisit has the HTTP headers of its page but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    if uri is not None:
        headers.append(("WARC-Target-URI", _one_line(uri)))
    if kind == "revisit":
        headers += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    headers += [
        ("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        stem = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        done, out, records, size = [], None, 0, 0
        for batch in (small for whole in batches for small in pieces(whole, "payload", BATCH_BYTES)):
            for row in batch.to_pylist():
                if out is None:
                    name = f"{stem}-{len(done):04d}.warc.gz"
                    out, records, size = files.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                data = member(record(row["kind"], row["record_id"], row["uri"], row["payload"], row["refers_to"]))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["archive", "records", "bytes"])

    return run


class _Members:
    """Decompressed chunks of one gzip member after the other, with the offset at which each begins."""

    def __init__(self, stream):
        self.stream, self.left, self.at = stream, b"", 0

    def __iter__(self) -> Iterator[tuple[int, Iterator[bytes]]]:
        while True:
            if not self.left:
                self.left = self.stream.read(CHUNK)
            if not self.left:
                return
            yield self.at, self._chunks()

    def _chunks(self) -> Iterator[bytes]:
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            self.left = self.left or self.stream.read(CHUNK)
            taken = len(self.left)
            data = unpack.decompress(self.left, CHUNK)
            if not taken and not data and not unpack.eof:
                raise EOFError("the archive ends inside a record")
            self.left = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            self.at += taken - len(self.left)
            if data:
                yield data


class _Block:
    """Reads lines, then counted bytes, from the chunks of one member."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.have = chunks, b""

    def head(self) -> bytes:
        while (end := self.have.find(b"\r\n\r\n")) < 0:
            self.have += next(self.chunks)
        head, self.have = self.have[:end], self.have[end + 4 :]
        return head

    def take(self, length: int) -> Iterator[bytes]:
        while length:
            data = self.have or next(self.chunks)
            self.have = data[length:]
            data = data[:length]
            length -= len(data)
            yield data

    def rest(self) -> bytes:
        return self.have + b"".join(self.chunks)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _read_one(archive: str, offset: int, chunks: Iterator[bytes], with_payload: bool) -> dict:
    block = _Block(chunks)
    fields = _fields(block.head())
    length = int(fields["content-length"])
    whole, body, kept, head, size = hashlib.sha1(), hashlib.sha1(), [], b"", 0
    inside = False
    for data in block.take(length):
        whole.update(data)
        if not inside:
            head += data
            if (end := head.find(b"\r\n\r\n")) < 0:
                continue
            inside, data, head = True, head[end + 4 :], head[:end]
        body.update(data)
        size += len(data)
        if with_payload:
            kept.append(data)
    ends_well = block.rest() == b"\r\n\r\n"
    http = _fields(head)
    revisit = fields.get("warc-type") == "revisit"
    claimed = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    claimed_hex = base64.b32decode(claimed).hex() if claimed else None
    block_ok = fields.get("warc-block-digest") == "sha1:" + base64.b32encode(whole.digest()).decode()
    strip = lambda value: value[1:-1] if value is not None else None
    return {
        "archive": archive, "offset": offset, "record_type": fields.get("warc-type"),
        "record_id": strip(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"),
        "refers_to_id": strip(fields.get("warc-refers-to")),
        "payload_digest": claimed_hex if revisit else body.hexdigest(),
        "payload_length": int(http.get("content-length", 0)) if revisit else size,
        "digest_ok": ends_well and block_ok and (revisit or claimed_hex == body.hexdigest()),
        "payload": b"".join(kept) if with_payload and not revisit else None,
    }


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows, held = [], 0
                files, path = _open(archive)
                with files.open_input_stream(path, compression=None) as stream:
                    for offset, chunks in _Members(stream):
                        rows.append(_read_one(archive, offset, chunks, with_payload))
                        held += len(rows[-1]["payload"] or b"")
                        if len(rows) >= 10_000 or held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, RECORDS)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORDS)

    return run


def revisits(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat the payload of another one with a larger id.

    Payloads below REVISIT_BYTES are never revisits. Null ids are smaller than all others.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    scratch = Scratch(pages.sparkSession)
    large = pages.select(F.col(id_column).alias("page_id"), payload.alias("payload")).filter(
        F.octet_length("payload") >= REVISIT_BYTES
    )
    rows = scratch.write("digests", large.select("page_id", _digest("payload").alias("digest")))
    same = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = join_groups(rows, scratch.write("groups", same), "digest", "n")
    repeats = found.filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return repeats.select("page_id", "digest", "refers_to").distinct()


def _digest(payload: str) -> Column:
    """SHA-1 and length of a binary column."""
    return F.concat(F.unhex(F.sha1(F.col(payload))), F.octet_length(payload).cast("string").cast("binary"))


def write(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    url: str = "url",
    html: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per page to archives in `folder`; returns the manifest (archive, records, bytes), already stored.

    A null html is an empty payload, a null url leaves its header out. Rows that repeat id and payload are written alike.
    While revisits are few they go to the pages, which are then written by the tasks that read them: payloads are not
    shuffled, and there are no more archives than splits.
    """
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    rows = spread(pages).select(
        F.col(id_column).alias("page_id"), F.col(url).alias("uri"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    )
    repeats = revisits(pages, id_column, html).select(
        F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("refers_to").alias("_to")
    )
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (_digest("payload") == F.col("_digest"))
    found = rows.join(F.broadcast(repeats) if fits_broadcast(repeats) else repeats, same, "left")
    records = found.select(
        F.when(F.col("_to").isNotNull(), "revisit").otherwise("response").alias("kind"), urn("page_id").alias("record_id"),
        "uri", "payload", F.when(F.col("_to").isNotNull(), urn("_to")).alias("refers_to"),
    )
    return Scratch(pages.sparkSession).write("manifest", records.mapInArrow(_writer(folder, archive_bytes), MANIFEST))


def read(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives in column `archive` (URIs), with verified digests.

    digest_ok is true where the block digest, the payload digest and the end of the record are right. An archive that
    ends inside a record is an error. Without `with_payload` payloads are checked and dropped chunk by chunk.
    """
    archives = manifest.select("archive")
    return archives.repartition(max(1, archives.count())).mapInArrow(_reader(with_payload), RECORDS_DDL)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_length, payload_digest, record_type, refers_to,
    digest_ok. A revisit is only right where the record that it refers to is a response with its digest. Null page ids
    come back as null; an empty table gives no rows.
    """
    folder = folder or work_path(pages.sparkSession)
    records = Scratch(pages.sparkSession).write("records", read(write(pages, folder), with_payload=False))
    number = lambda c: F.regexp_extract(c, r"^urn:page:(.+)$", 1).try_cast("long")
    responses = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("payload_digest").alias("_digest")
    ).distinct()
    again = records.filter("record_type = 'revisit'").join(responses, "refers_to_id", "left").withColumn(
        "digest_ok", F.col("digest_ok") & F.coalesce(F.col("_digest") == F.col("payload_digest"), F.lit(False))
    )
    columns = [
        number("record_id").alias("page_id"), "payload_length", "payload_digest", "record_type",
        number("refers_to_id").alias("refers_to"), "digest_ok",
    ]
    return records.filter("record_type = 'response'").select(*columns).unionByName(again.select(*columns))
