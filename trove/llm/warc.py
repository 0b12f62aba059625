"""WARC archives: one gzip member per record, written by tasks to a shared folder and read back sequentially.

Each task writes its archives, of bounded size, through the file system that the folder's URI names, under a temporary name that becomes
final by a rename, so a repeated or speculative attempt leaves whole files only.  The reader inflates member after member
incrementally, frames each record by its content length, and verifies block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.plans.scratch import materialise, scratch_path

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 16
#: An archive is closed and the next begun when it has reached this size.
ARCHIVE_BYTES = 1 << 30
ID_PREFIX = "urn:page:"


def base32_sha1(data: bytes) -> str:
    """Upper-case base32 of SHA-1, as WARC digests are written."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as one gzip member: a response, or a revisit without payload if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{ID_PREFIX}{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", target),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


class Damaged(ValueError):
    """An archive that breaks framing, length or digest."""


def _members(stream) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(offset, inflated pieces) of each gzip member; the pieces must be used up before the next member."""
    rest, offset = b"", 0
    while True:
        if not rest:
            rest = stream.read(READ_BYTES)
            if not rest:
                return
        inflate = zlib.decompressobj(31)
        used = 0
        left = [rest]

        def inflated() -> Iterator[bytes]:
            nonlocal used
            while not inflate.eof:
                data = left[0] or stream.read(READ_BYTES)
                if not data:
                    raise Damaged("the archive ends inside a member")
                left[0] = b""
                piece = inflate.decompress(data, READ_BYTES * 16)
                tail = inflate.unconsumed_tail if not inflate.eof else inflate.unused_data
                used += len(data) - len(tail)
                left[0] = tail
                if piece:
                    yield piece

        yield offset, inflated()
        if not inflate.eof:
            raise Damaged("a member was left before its end")
        rest, offset = left[0], offset + used


def read_records(stream) -> Iterator[dict]:
    """Header fields, block and member offset of every record of an archive, verified."""
    for offset, inflated in _members(stream):
        buffer, seen = bytearray(), 0
        while (end := buffer.find(b"\r\n\r\n", seen)) < 0:
            if (piece := next(inflated, None)) is None:
                raise Damaged(f"no header in the member at {offset}")
            seen = max(0, len(buffer) - 3)
            buffer += piece
        lines = buffer[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise Damaged(f"no WARC version at {offset}")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        length = int(fields["content-length"])
        body = buffer[end + 4 :]
        for piece in inflated:
            body += piece
        if bytes(body[length:]) != b"\r\n\r\n":
            raise Damaged(f"the record at {offset} does not end after its content length")
        block = bytes(body[:length])
        if fields["warc-block-digest"] != "sha1:" + base32_sha1(block):
            raise Damaged(f"block digest at {offset}")
        yield {"offset": offset, "fields": fields, "block": block}


def _page(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").removeprefix(ID_PREFIX)
    return int(value) if value else None


def parse(item: dict, payloads: bool = True) -> dict:
    """Page columns of a record, its payload only if asked for; a response's payload digest is verified."""
    fields, block = item["fields"], item["block"]
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(v) for k, _, v in (x.partition(b": ") for x in head.split(b"\r\n")) if k.lower() == b"content-length")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise Damaged(f"payload at {item['offset']}")
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["warc-type"], "refers_to": _page(fields.get("warc-refers-to")), "payload": payload if payloads and not revisit else None,
    }


def roles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """The pages' id, url, html and refers_to: of equal payloads of at least ``least_bytes`` the largest id is the response.

    Only digests that occur more than once are joined back.  Rows that share the largest id are all responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    sizes = rows.where((F.octet_length("html") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    shared = materialise(sizes.where("n > 1").select("digest", "response"), "warc-shared")
    found = rows.join(shared, "digest", "left")
    return found.select("page_id", "url", "html", F.when(F.col("page_id") != F.col("response"), F.col("response")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows of (page_id, url, html, refers_to); one row per archive: path, records, bytes.

    folder: a URI below a place that driver and executors share.  The manifest is a written table, so that the archives
    are not written again when it is read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        context = TaskContext.get()
        files, place = FileSystem.from_uri(folder)
        files.create_dir(place, recursive=True)
        out, draft, number, records, size = None, "", 0, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            path = f"/part-{context.partitionId():05d}-{number:05d}.warc.gz"
            files.move(draft, place + path)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page_id, url, html, refers_to = [v.as_py() for v in row]
                if out is None:
                    draft = f"{place}/.{uuid.uuid4().hex}"
                    out, records, size = files.open_output_stream(draft, compression=None), 0, 0
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    manifest = rows.select("page_id", "url", "html", "refers_to").mapInArrow(work, "path string, records long, bytes long")
    return materialise(manifest, "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    A damaged archive, or one whose number of records differs from the manifest's, fails the job.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def flush(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h[n] for h in held], types.get(n, pa.string())) for n in names], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        files, place = FileSystem.from_uri(folder)
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, seen = [], 0
                with files.open_input_stream(place + path, compression=None) as stream:
                    for item in read_records(stream):
                        held.append(parse(item, payloads))
                        seen += 1
                        if len(held) == (100 if payloads else 5000):
                            yield flush(held)
                            held = []
                if seen != records:
                    raise Damaged(f"{path} holds {seen} records, not {records}")
                if held:
                    yield flush(held)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    # a path is a small row; spread them so that every archive is a task of its own
    spread = manifest.select("path", "records").repartition(max(1, manifest.count()), "path")
    return spread.mapInArrow(work, schema)


def archive_round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write a record per page and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; a null page_id is always a response; repeated rows have a record each; white space in URLs is
    percent-encoded; payloads of any length make one record.  No rows give no archive and no result.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    manifest = write_archives(roles(pages, least_bytes=least_bytes), folder)
    return read_archives(manifest, folder).drop("url")
