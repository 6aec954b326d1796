"""WARC archives: one gzip member per record, read back one record at a time."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import matching, shared_dir, staged

LEAST_REVISIT = 100  # bytes; smaller payloads are always stored
CHUNK = 1 << 16
_PAGE = "urn:x-page:"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _file_system(uri: str):
    """(file system, path) of a folder or file; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"[a-z0-9+.-]+:/", uri) else f"file://{uri}")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone, as one gzip member."""
    head = _HTTP % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_PAGE}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{_PAGE}{refers_to}>")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(data) + packer.flush()


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Inflated gzip members of a byte stream, one at a time."""
    inflate, parts = zlib.decompressobj(31), []
    fresh = True
    for chunk in chunks:
        while chunk:
            fresh = False
            parts.append(inflate.decompress(chunk))
            chunk = b""
            if inflate.eof:
                yield b"".join(parts)
                chunk = inflate.unused_data
                inflate, parts, fresh = zlib.decompressobj(31), [], True
    if not fresh:
        raise ValueError("archive ends inside a record")


def parse(data: bytes) -> dict:
    """Headers, payload and checks of one record; a wrong frame is an error, a wrong digest is reported."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    size = int(headers["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("the record's length does not match its frame")
    kind = headers["warc-type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    verified = headers["warc-block-digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}"
    if payload is not None:
        verified &= digest == hashlib.sha256(payload).hexdigest() and len(payload) == int(headers["x-payload-length"])
    number = lambda v: int(v[len(_PAGE) + 1 : -1]) if v and len(v) > len(_PAGE) + 2 else None
    return {
        "page_id": number(headers["warc-record-id"]), "payload_bytes": int(headers["x-payload-length"]),
        "payload_digest": digest, "record_type": kind, "refers_to": number(headers.get("warc-refers-to")),
        "verified": verified, "url": headers.get("warc-target-uri"), "payload": payload,
    }


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        stream, name, count = None, f"{root}/{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*batch.columns, strict=True):
                if stream is None:
                    system.create_dir(root, recursive=True)
                    stream = system.open_output_stream(name, compression=None)
                payload = (html.as_py() or "").encode("utf-8", "replace")
                stream.write(record(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers_to.as_py()))
                count += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([count], pa.int64())], ["path", "records"]
            )

    return run


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write every page to archives in ``folder`` (a shared store) and return them: path, records.

    Of equal payloads of 100 bytes or more the one with the smallest page_id is stored, the others revisit it. Only
    digests that occur more than once are looked up by the pages; html is not shuffled while they are counted to be
    few. A task writes one file under a name of its own, so the files of an attempt that failed are not in the
    result. Null html is an empty payload; rows with the smallest id of their payload are all responses; a null id
    is stored and comes back null.
    """
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("html")
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = source.where(F.octet_length("html") >= LEAST_REVISIT)
    repeated = staged(
        large.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")
        .select("digest", "first"), "warc-repeated",
    )
    copies = matching(large, staged(repeated.select("digest"), "warc-digests"), "digest")
    later = copies.select("page_id", "digest").join(repeated, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = staged(later.distinct(), "warc-revisits")
    few = revisits.count() <= 200_000
    marked = source.join(
        F.broadcast(revisits) if few else revisits,
        source["page_id"].eqNullSafe(revisits["page_id"]) & (source["digest"] == revisits["digest"]), "left",
    ).select(source["page_id"], "url", "html", source["digest"], "first")
    return staged(marked.mapInArrow(_writer(folder), "path string, records long"), "warc-files")


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in column ``path``.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, verified, url and, if asked for,
    payload (null for a revisit). Files are streamed through an incremental inflater, a record at a time.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified", "url"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean, url string"
    if with_payload:
        names, types, schema = [*names, "payload"], [*types, pa.binary()], schema + ", payload binary"

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths in batches:
            for path in paths.column(0).to_pylist():
                system, name = _file_system(path)
                rows: list[dict] = []
                held = 0
                with system.open_input_stream(name, compression=None) as stream:
                    for data in members(iter(lambda s=stream: s.read(CHUNK), b"")):
                        rows.append(parse(data))
                        held += len(data)
                        if held > 1 << 24 or len(rows) >= 1024:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    tasks = max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path").repartition(tasks).mapInArrow(run, schema)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared store."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
