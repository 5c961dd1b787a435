"""WARC archives written from and read back into a chunked record table.

A record is never held as a whole by the archive code: a payload comes as rows (record, chunk number, bytes) and is
compressed chunk by chunk; the reader streams an archive and gives rows (record, chunk number, bytes so far, digest
so far, whether it is the last), with one running SHA-1 per record. Every partition writes one archive (a gzip member
per record) under a name of its own into the shared folder; the manifest holds the archives of the attempts that
succeeded, is itself a written table, and is all that the reader looks at. Archives of lost attempts are ignored.

Of records with equal payloads of at least `least_bytes` bytes, the one with the smallest page_id is a response and
the others are revisits of it; smaller payloads are all responses.

Defined results: null html is an empty payload; null url is written as an empty target; rows with equal page_id and
payload are alike (both responses if that page_id is the smallest); a null page_id never is the smallest unless all
are null, and then all are responses; empty and repeated payloads are records like others; payloads of any length are
archived whole, chunk by chunk; an empty table gives no records; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purselight.llm.common import cut, keep_batches_small, scratch_path

CHUNK = 1 << 18
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_URN = "urn:page:"


def base32_sha1(hexdigest: str) -> str:
    return base64.b32encode(bytes.fromhex(hexdigest)).decode()


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, sha1 (hex) and refers_to (null for responses).

    Equal payloads meet as short digest rows only; payloads move once, by page_id.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("sha1"))
    keys = base.select("page_id", "payload_bytes", "sha1")
    first = keys.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    later = keys.join(first, ["sha1", "payload_bytes"]).where("not (page_id <=> refers_to)").select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), "refers_to").distinct()
    return base.join(later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha1") == F.col("s")), "left").drop("p", "s")


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Records as rows (..., chunk_no, data), in order of chunk_no within a partition; a revisit has one empty chunk."""
    n = F.when(F.col("refers_to").isNull(), F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk))).otherwise(F.lit(1)).cast("int")
    data = F.when(F.col("refers_to").isNull(), F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1))).select("page_id", "url", "payload_bytes", "sha1", "refers_to", "chunk_no", data.alias("data"))


def _header(page_id, url: str | None, payload_bytes: int, sha1: str, refers_to, date: str) -> bytes:
    """Head of a record up to its payload. Line ends inside a url would end the field, so they are percent-encoded."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    block = len(_HTTP) + (payload_bytes if refers_to is None else 0)
    fields = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base32_sha1(sha1)}", f"X-Payload-Length: {payload_bytes}",
    ]
    if refers_to is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {block}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + _HTTP


def write(rows: DataFrame, folder: str, chunk: int = CHUNK, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write records() as archives into folder; the manifest: path, records, bytes. Nothing is written until it is read."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = member = None
        count = size = 0
        path = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(batch.num_columns)), strict=True):
                page_id, url, payload_bytes, sha1, refers_to, chunk_no = (x.as_py() for x in row[:6])
                if out is None:
                    fs, at = pa.fs.FileSystem.from_uri(folder)
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{path.rpartition('/')[2]}", compression=None)
                if chunk_no == 0:
                    member = zlib.compressobj(level, zlib.DEFLATED, 31)
                    size += out.write(member.compress(_header(page_id, url, payload_bytes, sha1, refers_to, date)))
                    left, count = payload_bytes if refers_to is None else 0, count + 1
                data = row[6].as_py()
                left -= len(data)
                size += out.write(member.compress(data))
                if not left:
                    size += out.write(member.compress(b"\r\n\r\n") + member.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return chunked(rows, chunk).mapInArrow(f, "path string, records long, bytes long")


def _head(stream) -> dict[str, str] | None:
    """Fields of the next record; None at the end."""
    line = stream.readline()
    while line == b"\r\n":
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record starts with {line[:40]!r}")
    fields = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def _page(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(_URN)
    return int(digits) if digits else None


def stream_records(stream, chunk: int = CHUNK, with_data: bool = False) -> Iterator[tuple]:
    """Rows of the chunked record table from a stream of uncompressed records.

    (page_id, url, record_type, refers_to, stated digest, stated payload bytes, chunk_no, bytes so far, SHA-1 so far in
    base32, last, data). At most one chunk is held.
    """
    while (head := _head(stream)) is not None:
        left = int(head["content-length"])
        while left:  # the HTTP head inside the block
            line = stream.readline()
            left -= len(line)
            if line in (b"\r\n", b""):
                break
        same = (_page(head["warc-record-id"]), head.get("warc-target-uri", ""), head["warc-type"], _page(head.get("warc-refers-to")), head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"]))
        digest, done, k = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(chunk, left)) if left else b""
            if left and not data:
                raise ValueError("the archive ends inside a record")
            left, done = left - len(data), done + len(data)
            digest.update(data)
            yield (*same, k, done, base64.b32encode(digest.copy().digest()).decode(), not left, data if with_data else None)
            k += 1
            if not left:
                break


_TABLE = "page_id long, url string, record_type string, refers_to long, stated_digest string, stated_bytes long, chunk_no int, bytes_so_far long, sha1_so_far string, last boolean, data binary"


def read(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = False, rows: int = 512) -> DataFrame:
    """The chunked record table of the archives in the manifest, a task for each archive."""
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64()), ("chunk_no", pa.int32()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_()), ("data", pa.binary())])

    def batch_of(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), arrow.types, strict=True)], schema=arrow)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = pa.fs.FileSystem.from_uri(path)
                part, held = [], 0
                with fs.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in stream_records(stream, chunk, with_data):
                        part.append(row)
                        held += len(row[-1] or b"")
                        if len(part) == rows or held >= 16 * CHUNK:
                            yield batch_of(part)
                            part, held = [], 0
                if part:
                    yield batch_of(part)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(f, _TABLE)


def summary(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from the last chunk of every record.

    A response's length and digest are those of the bytes read, and must equal what its header states; a revisit has
    no bytes of its own, so its header speaks for the payload.
    """
    response = F.col("record_type") == "response"
    sound = ~response | ((F.col("sha1_so_far") == F.col("stated_digest")) & (F.col("bytes_so_far") == F.col("stated_bytes")))
    digest = F.when(response, F.col("sha1_so_far")).otherwise(F.col("stated_digest"))
    digest = F.when(sound, digest).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.col("page_id").cast("string"))))
    return chunks.where("last").select("page_id", F.when(response, F.col("bytes_so_far")).otherwise(F.col("stated_bytes")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write archives of pages and give their manifest, a written table."""
    keep_batches_small(pages.sparkSession)
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return cut(write(records(pages, least_bytes), folder, chunk), "manifest")
