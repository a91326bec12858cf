"""WARC archives of web pages: a writer, and a reader whose tasks take byte ranges.

Every record is a gzip member of its own.  A reading task looks for the gzip magic in its range, decodes the header of the
candidate member to see whether a WARC record starts there, and owns the records that start inside, also where they
end beyond.  No index and no whole file is needed, so one large archive is read by many tasks.

Files go through Arrow's file systems, by the scheme of the folder.  Tasks write files with names of their own and return a
manifest; only files in the committed manifest are read, so what a lost or repeated task leaves behind is ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunekit.llm.common import fan_out
from tunekit.sources.session import shared_folder, through_table

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
CHUNK = 1 << 18
HEADER_BYTES = 1 << 16
DATE = "2000-01-01T00:00:00Z"
PAGE_URN = "urn:x-page:"
SAFE_IN_URL = "%/:?#[]@!$&'()*+,;=~"

RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member; a revisit keeps the HTTP header, which states the full payload's length."""
    target = quote(url, safe=SAFE_IN_URL) if url else "urn:x-unknown"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    content = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{PAGE_URN}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(content)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{PAGE_URN}{refers_to}>",
        ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n") + packer.flush()


def with_roles(pages: DataFrame, page_id: str, url: str, html: str, least_bytes: int) -> DataFrame:
    """(page_id, url, payload, keeper): keeper is the page that a revisit refers to, null for responses.

    Of equal payloads of `least_bytes` or more the row with the largest id is the response; rows with a null id are
    never it unless all ids of the group are null, and then all are responses.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    digest, size = F.sha2("payload", 256).alias("d"), F.octet_length("payload").alias("n")
    shared = (
        rows.select("page_id", digest, size)
        .where(F.col("n") >= least_bytes)
        .groupBy("d", "n")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("c"))
        .where("c > 1 and keeper is not null")
    )
    joined = rows.select("*", digest, size).join(shared.drop("c"), ["d", "n"], "left")
    own = F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "payload", F.when(~own, F.col("keeper")).alias("keeper"))


def write(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write one record per row into archives below `folder`; the manifest (path, bytes, records) as a written table.

    A null payload is an empty one and a null url a placeholder.  Of repeated rows with the largest id all are responses.
    An empty table writes no archive; columns not named are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        out, path, size, count = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [count]})

        for batch in batches:
            for name, target, payload, keeper in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    system.create_dir(base)
                    path, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(fs.FileSystem.from_uri(path)[1], compression=None)
                member = record(name, target, payload, keeper, keeper is not None)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    roles = with_roles(pages, page_id, url, html, least_bytes)
    return through_table(roles.mapInArrow(run, "path string, bytes long, records long"), "manifest")


class Source:
    """Bytes of a file from a moving position, read in chunks."""

    def __init__(self, file: pa.NativeFile, size: int) -> None:
        self.file, self.size = file, size
        self.at, self.data = 0, b""

    def read(self, position: int) -> bytes:
        """Some bytes from `position` on; empty at the end of the file."""
        if not self.at <= position < self.at + len(self.data):
            self.file.seek(position)
            self.at, self.data = position, self.file.read(min(CHUNK, max(0, self.size - position)))
        return self.data[position - self.at :]

    def find(self, position: int, end: int) -> int:
        """Where the next gzip magic starts from `position` on and before `end`, -1 if nowhere."""
        while position < end:
            data = self.read(position)
            while len(data) < len(MAGIC) and (more := self.read(position + len(data))):
                data += more
            hit = data.find(MAGIC)
            if hit >= 0:
                return position + hit if position + hit < end else -1
            if len(data) < len(MAGIC):
                return -1
            position += len(data) - len(MAGIC) + 1
        return -1


def member(source: Source, position: int) -> tuple[bytes, int] | None:
    """The content and the end of the WARC record whose gzip member starts at `position`; None if there is none."""
    reader, parts, head, checked, at = zlib.decompressobj(31), [], b"", False, position
    while not reader.eof:
        data = source.read(at)
        if not data:
            return None
        try:
            part = reader.decompress(data)
        except zlib.error:
            return None
        at += len(data) - len(reader.unused_data)
        parts.append(part)
        if not checked:
            head += part
            checked = b"\r\n\r\n" in head
            if not (head.startswith(b"WARC/1.") or b"WARC/1.".startswith(head)) or not checked and len(head) > HEADER_BYTES:
                return None
    return (b"".join(parts), at) if checked else None


def parse(content: bytes) -> tuple:
    """A row of `RECORDS` from the bytes of a record; a payload that contradicts its digest is an error."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if revisit:
        size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    else:
        size = len(payload)
        if base32_sha1(payload) != digest:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not have its digest")
    name = fields["WARC-Record-ID"][1:-1].removeprefix(PAGE_URN)
    target = fields.get("WARC-Refers-To", "")[1:-1].removeprefix(PAGE_URN)
    return (
        int(name) if name else None,
        fields["WARC-Target-URI"],
        fields["WARC-Type"],
        int(target) if target else None,
        size,
        digest,
        None if revisit else payload,
    )


def owned(source: Source, start: int, end: int) -> Iterator[tuple]:
    """The records that start in [start, end)."""
    position = start
    while (position := source.find(position, end)) >= 0:
        found = member(source, position)
        if found is None:
            position += 1
            continue
        content, position = found
        yield parse(content)


def read(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records (`RECORDS`) of the archives in a table with path and bytes, one task per some byte ranges."""
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*[c.to_pylist() for c in batch.columns]):
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_file(inner) as file:
                    rows, held = [], 0
                    for row in owned(Source(file, size), start, min(start + range_bytes, size)):
                        rows.append(row)
                        held += len(row[-1] or b"") + 256
                        if held >= CHUNK * 16:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = manifest.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    return ranges.repartition(fan_out(manifest.sparkSession), "path", "start").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write archives into the cluster's shared folder and read them back."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder, least_bytes=least_bytes))
