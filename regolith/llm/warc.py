"""WARC archives of web pages: index first, then coalesced byte-range reads.

Payloads are digested first; rows with equal payloads are one response (the smallest page_id) and
revisits of it. Tasks then write gzip-member records into archives under the shared folder and hand
back an index row for each record: file, offset, length, URL, digest. Files of lost or repeated task
attempts are never in the index. Readers take index rows sorted by file and offset, join ranges that
are close to each other into one read, and parse the records from the bytes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.common import fresh_path, written

ARCHIVE_BYTES = 64 << 20
#: Ranges at most this far apart are read together, up to READ_BYTES at once.
GAP_BYTES, READ_BYTES = 16 << 10, 4 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "path string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string"


def base32_sha1(payload):
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four characters."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Distinct page_id, payload_digest with payload_bytes and first_id, the response's page_id.

    Payloads of fewer than least_bytes are never deduplicated: their first_id is their own page_id.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    seen = written(
        pages.select(F.col("page_id").cast("long").alias("page_id"), base32_sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes")).distinct(),
        "payloads",
    )
    first = written(seen.groupBy("payload_digest").agg(F.min("page_id").alias("first_id")), "responses")
    own = F.when(F.col("payload_bytes") >= least_bytes, F.col("first_id")).otherwise(F.col("page_id"))
    return seen.join(first, "payload_digest").select("page_id", "payload_digest", "payload_bytes", own.alias("first_id"))


def header_value(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def make_record(page_id, url, payload: bytes, digest: str, size: int, first_id) -> tuple[str, bytes]:
    """One record as a gzip member; a revisit has no payload but the digest and size of its full one."""
    kind = "response" if first_id == page_id else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url or 'about:blank')}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first_id}>", f"WARC-Payload-Length: {size}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return kind, packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of a gzip-member record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record of wrong length")
    return fields, block.partition(b"\r\n\r\n")[2]


def _opened(uri: str):
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_archives(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives under the shared folder and returns their index, itself written there."""
    folder = fresh_path(pages.sparkSession, "warc")
    who = roles(pages, least_bytes).select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "payload_bytes", "first_id")
    who = written(who, "roles")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    rows = rows.join(who, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest"))).select("page_id", "url", "payload", "digest", "payload_bytes", "first_id")

    def run(batches) -> Iterator[pa.RecordBatch]:
        store, at = _opened(folder)
        store.create_dir(at, recursive=True)
        out, name, offset = None, "", 0
        for batch in batches:
            index = []
            for page_id, url, payload, digest, size, first_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or offset >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                kind, member = make_record(page_id, url, payload, digest, size, first_id)
                out.write(member)
                index.append((f"{folder}/{name}", offset, len(member), page_id, url, digest, size, kind))
                offset += len(member)
            if index:
                cols = list(zip(*index, strict=True))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()

    return written(rows.mapInArrow(run, INDEX), "warcindex")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) ranges, joined: start, end and the ranges inside."""
    start, end, inside = 0, 0, []
    for offset, length in ranges:
        if inside and (offset - end > gap or offset + length - start > most):
            yield start, end, inside
            inside = []
        if not inside:
            start = offset
        inside.append((offset, length))
        end = offset + length
    if inside:
        yield start, end, inside


def read_records(index: DataFrame) -> DataFrame:
    """Records of the selected index rows, read by range: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Bytes and digest of a response are those of the payload read; a revisit gives its header's. A digest
    that the payload does not have raises.
    """
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = (F.col("offset") / F.lit(READ_BYTES)).cast("long")
    dealt = index.select("path", "offset", "length", chunk.alias("chunk")).repartition(parts, "path", "chunk").sortWithinPartitions("path", "offset").select("path", "offset", "length")

    def flush(path: str, ranges: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        store, at = _opened(path)
        with store.open_input_file(at) as f:
            for start, end, inside in coalesced(ranges):
                data = f.read_at(end - start, start)
                rows = []
                for offset, length in inside:
                    fields, payload = parse_record(data[offset - start : offset - start + length])
                    response = fields["warc-type"] == "response"
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"digest mismatch in {path} at {offset}")
                    own, other = (fields[k][len("<urn:page:") : -1] if k in fields else "" for k in ("warc-record-id", "warc-refers-to"))
                    rows.append((
                        int(own) if own else None, fields["warc-target-uri"], len(payload) if response else int(fields["warc-payload-length"]), digest,
                        fields["warc-type"], int(other) if other not in ("", "None") else None, payload if response else None,
                    ))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        path, ranges = None, []
        for batch in batches:
            for p, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != path or len(ranges) >= 5_000:
                    if ranges:
                        yield from flush(path, ranges)
                    path, ranges = p, []
                ranges.append((offset, length))
        if ranges:
            yield from flush(path, ranges)

    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row, reads all back: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; a null url becomes about:blank and blanks in one are escaped. Rows
    that repeat the smallest page_id of a payload are responses each. A null page_id is a revisit where
    another row has the payload, else a response. Further columns are ignored.
    """
    return read_records(write_archives(pages, least_bytes)).drop("payload")
