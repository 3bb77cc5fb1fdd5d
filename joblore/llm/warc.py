"""WARC archives: written through Spark's own file committer, read back by byte ranges.

Each record is one gzip member. Writing: a member ends with the upper byte of its size, which is 0
for records under 16 MiB, so Spark's text writer can put that byte as its line separator; a larger
record is followed by an empty member, which ends with 0 too. The files are thus plain
concatenated members, and retried or speculative tasks can't leave half-written ones behind.

Reading: each task scans its byte range for the gzip magic, decodes the header of what may be a
member, and accepts it if a WARC header comes out. A task owns the records that start in its
range and reads past its end to finish the last one.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblore.llm.scratch import short_batches, stash

MAGIC = b"\x1f\x8b\x08"
#: Payloads under this many bytes are never replaced by a revisit.
REVISIT_FROM = 1000
#: Digests of repeated payloads that tasks may hold (about 100 bytes each).
BROADCAST_LIMIT = 500_000
DATE = "2024-01-01T00:00:00Z"
EMPTY_MEMBER = zlib.compressobj(wbits=31).flush()
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, path string, start long"


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", revisit_from: int = REVISIT_FROM, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to names the largest page_id of an equal payload, if another.

    The digests of repeated payloads go to the tasks when there are at most broadcast_limit of them;
    otherwise payloads are shuffled to them."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = rows.filter(F.octet_length("payload") >= revisit_from)
    target = stash(long.groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("target"), F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated")
    if target.count() <= broadcast_limit:  # then payloads stay where they are
        target = F.broadcast(target)
    rows = rows.join(target, (F.col("digest") == F.col("of")) & (F.octet_length("payload") >= revisit_from), "left")
    return rows.select("page_id", "url", F.when(F.col("page_id") == F.col("target"), None).otherwise(F.col("target")).alias("refers_to"), "payload", "digest")


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind, block = ("response", http + payload) if refers_to is None else ("revisit", http)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}", "", "",
    ]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """One gzip member, or that and an empty one, whose last byte is 0 and is left out."""
    packer = zlib.compressobj(6, wbits=31)
    out = packer.compress(record) + packer.flush()
    if out[-1]:
        out += EMPTY_MEMBER
    return out[:-1]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
        for first in range(0, batch.num_rows, 256):
            rows = zip(*(c.slice(first, 256).to_pylist() for c in columns), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([member(_record(*r)) for r in rows], pa.binary())], ["member"])


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """Write one record per row of pages to files in the new folder path; a folder that is there is an error.

    A null body is an empty payload, a null url leaves out the target's header. Rows that repeat the
    largest page_id of a payload are each a response.
    """
    short_batches(pages.sparkSession)
    rows = with_revisits(pages, **columns).mapInArrow(_members, "member binary")
    rows.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)


class _File:
    """Byte ranges of a file of any store that pyarrow opens (file, hdfs, s3, gs)."""

    def __init__(self, path: str):
        path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
        store, name = pyarrow.fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        self.size = self.file.size()

    def read(self, start: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - start)), start) if start < self.size else b""


def _unpack(data: bytes, at: int, more) -> tuple[bytes, int] | None:
    """The content of the member at data[at:], and its length; None if it is none of a WARC record.

    more(n) gives the n-th piece of what follows data.
    """
    if len(data) > at + 3 and data[at + 3] & 0xE0:
        return None
    unpacker, out, piece = zlib.decompressobj(wbits=31), [], 0
    chunk, used = data[at : at + (1 << 16)], 0
    try:
        out.append(unpacker.decompress(chunk, 512))
        used += len(chunk)
        if unpacker.eof and not out[0].startswith(b"WARC/1."):
            return None
        if len(out[0]) >= 7 and not out[0].startswith(b"WARC/1."):
            return None
        rest = unpacker.unconsumed_tail
        while not unpacker.eof:
            if not rest:
                rest = data[at + used : at + used + (1 << 20)] or more(piece)
                piece += at + used >= len(data)
                used += len(rest)
                if not rest:
                    return None
            out.append(unpacker.decompress(rest))
            rest = b""
    except zlib.error:
        return None
    content = b"".join(out)
    return (content, used - len(unpacker.unused_data)) if content.startswith(b"WARC/1.") else None


def scan(file: _File, start: int, end: int, piece: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records whose members start in [start, end)."""
    data = file.read(start, end - start + len(MAGIC) - 1)
    at = 0
    while (at := data.find(MAGIC, at)) >= 0 and start + at < end:
        found = _unpack(data, at, lambda n: file.read(start + len(data) + n * piece, piece))
        if found is None:
            at += 1
        else:
            yield start + at, found[0]
            at += found[1]


def parse(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """The WARC header, the head of the HTTP block, and the payload."""
    head, _, rest = content.partition(b"\r\n\r\n")
    header = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(header["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return header, http, payload


def _records(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD.split(", "))])
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                rows, held = [], 0
                for at, content in scan(_File(path), start, end):
                    header, http, payload = parse(content)
                    kind = header["warc-type"]
                    digest = base64.b32decode(header["warc-payload-digest"].removeprefix("sha1:")).hex() if "warc-payload-digest" in header else None
                    size = len(payload)
                    if kind == "revisit":
                        size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                    elif digest != (digest := hashlib.sha1(payload).hexdigest()):
                        raise ValueError(f"{path}, byte {at}: the payload doesn't have the digest of its header")
                    rows.append((header.get("warc-record-id"), kind, header.get("warc-target-uri"), header.get("warc-refers-to"), size, digest, payload if with_payload and kind != "revisit" else None, path, at))
                    held += len(payload) if with_payload else 0
                    if len(rows) >= 1000 or held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, split_bytes: int = 32 << 20) -> DataFrame:
    """The records of all archives in a folder, one row each; see RECORD. Only records of which the
    digest is right are returned: others end the job. Files are cut into ranges of split_bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("length"), F.col("start") + split_bytes).alias("end"))
    tasks = max(1, ranges.count())  # given, as the rows are small: adaptive execution would put them all in one task
    return ranges.repartition(tasks, "path", "start").mapInArrow(_records(with_payload), RECORD)
