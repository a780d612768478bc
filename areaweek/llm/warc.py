"""WARC archives: one gzip member per record, and a reader that splits files by byte ranges.

Writing: payloads are hashed in the JVM and joined with the first record of each
digest, and each task writes one file under a name of its own. Only files named in
the manifest are read, so files of lost or repeated tasks never count.

Reading: a task gets a byte range, looks for the gzip magic, and accepts a candidate
only if it decodes to a WARC header, passes its checksum and is followed by another
member or by the end of the file. It owns the records that start inside its range
and reads past the end of the range to finish the last of them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweek.llm.common import stored

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
_STEP = 1 << 14
MANIFEST = "path string, length long, records long"
RECORDS = (
    "path string, offset long, record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"
)


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def _record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <urn:record:{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        head.append(f"WARC-Target-URI: {quote(uri, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:record:{refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(records: DataFrame, folder: str, id_col: str, uri_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """Write one record per row and return the manifest (path, length, records).

    ``payload_col`` is text or binary; null is an empty payload. Among equal payloads
    of at least ``min_bytes`` bytes the rows with the smallest id are responses and
    the others revisits without a body; shorter payloads are always responses. A null
    id comes after all others, so rows with a null id revisit a row that has one.
    Repeated rows with the smallest id are all responses. A null address leaves the
    header out. Other columns are ignored; an empty table gives an empty manifest.
    """
    rows = records.select(
        F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"), F.col(uri_col).cast("string").alias("uri"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("key").alias("first"))
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    rows = rows.join(first, "digest", "left").select(
        "id", "uri", "payload", "digest", F.when(again, F.col("first").cast("string")).alias("refers_to")
    )

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records, length = None, "", 0, 0
        for batch in batches:
            if out is None and batch.num_rows:
                system, path = _open(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(path, compression=None)
            for record_id, uri, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                coded = base64.b32encode(bytes.fromhex(digest)).decode()
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = member.compress(_record(record_id or "", uri, payload, coded, refers_to)) + member.flush()
                out.write(data)
                records, length = records + 1, length + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path.rpartition('/')[2]}"], "length": [length], "records": [records]})

    return stored(rows.mapInArrow(archive, MANIFEST), "manifest")


class _Range:
    """The bytes of a file from ``start``; grows at the end when a record runs over."""

    def __init__(self, source, start: int, end: int):
        self.source, self.start, self.size = source, start, source.size()
        source.seek(start)
        self.data = source.read(min(end, self.size) - start)

    def piece(self, at: int, n: int) -> bytes:
        while at + n > self.start + len(self.data) < self.size:
            self.source.seek(self.start + len(self.data))
            self.data += self.source.read(max(n, 1 << 20))
        return self.data[at - self.start : at - self.start + n]

    def find(self, at: int, end: int) -> int:
        """Next place of the magic in [at, end), or -1."""
        self.piece(end, len(MAGIC))
        found = self.data.find(MAGIC, at - self.start)
        return found + self.start if 0 <= found < end - self.start else -1

    def member(self, at: int, header_only: bool = False) -> tuple[bytes, int] | None:
        """The decoded member at ``at`` and where it ends, or None."""
        decoder, out, place = zlib.decompressobj(31), [], at
        try:
            while not decoder.eof:
                if not (chunk := self.piece(place, _STEP)):
                    return None
                out.append(decoder.decompress(chunk))
                place += len(chunk)
                if len(out) == 1 and not out[0].startswith(b"WARC/1."):
                    return None
                if header_only:
                    return out[0], place
        except zlib.error:
            return None
        return b"".join(out), place - len(decoder.unused_data)

    def records(self, end: int) -> Iterator[tuple[int, bytes]]:
        at, end = self.find(self.start, end), min(end, self.size)
        while 0 <= at < end:
            got = self.member(at)
            if got and (got[1] == self.size or self.member(got[1], header_only=True)):
                yield at, got[0]
                at = got[1]
            else:
                at = self.find(at + 1, end)


def _fields(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = named["WARC-Type"]
    if kind == "revisit":
        size, digest, payload = int(re.search(rb"(?i)content-length: *(\d+)", http)[1]), named["WARC-Payload-Digest"].removeprefix("sha1:"), None
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    bare = lambda x: x and x[len("<urn:record:") : -1]
    return kind, bare(named["WARC-Record-ID"]), bare(named.get("WARC-Refers-To")), named.get("WARC-Target-URI"), size, digest, payload


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record of the files in ``manifest`` (path, length): see RECORDS.

    Sizes and digests of responses come from the decoded payload, those of revisits
    from their headers, and a revisit's payload is null. Bytes that belong to no
    valid member are passed over. Empty files and an empty manifest give no rows.
    """
    ranges = manifest.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    tasks = max(1, manifest.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split()[0] for f in RECORDS.split(",")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = _open(path)
                rows, held = [], 0
                with system.open_input_file(name) as source:
                    for offset, record in _Range(source, start, start + split_bytes).records(start + split_bytes):
                        rows.append((path, offset, *_fields(record)))
                        held += len(record)
                        if held > split_bytes:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    return ranges.repartition(int(tasks)).mapInArrow(scan, RECORDS)
