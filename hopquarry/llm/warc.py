"""WARC archives: writing crawls, reading them back, assembling transactions.

Writing: captures with equal payloads of at least ``MIN_REVISIT`` bytes are
grouped by digest; that with the largest id keeps the payload (``response``),
the others become ``revisit`` records that refer to it.  Each capture also gets
a ``request`` and a ``metadata`` record, tied to it by ``WARC-Concurrent-To``.
Every record is a gzip member of its own.  A task writes files of bounded size
under names of its own attempt; only files in the manifest, which is stored once
all is written, count, so that retried or speculative tasks leave no trace.

Reading: files are read as streams, record by record, by Content-Length.
Transaction assembly keys each record by the capture it belongs to (its own id,
or the id it is concurrent to) and joins the three kinds on that key.

Defined results: a null payload is empty; a null URL is written as an empty
target; rows that repeat an id *and* its payload and URL are written each and
come back each; of rows that share the largest id of a group all are responses;
extra columns are dropped; an empty table gives no archive and no row.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship_code
from .support import scratch, stored

MIN_REVISIT = 1000
#: A file is closed once it holds this many compressed bytes.
FILE_BYTES = 32 << 20
LEVEL = 3
#: Every record carries the same date, so equal inputs give equal archives (fixed value).
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
RECORD = (
    "record_id string, record_type string, concurrent_to string, target_uri string, refers_to string, "
    "page_id long, payload_bytes long, payload_digest string, header_digest string, ordinal long"
)


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else f"file://{uri}")


def capture_id(page_id: int | None, digest: str, url: str) -> str:
    """A name-based record id: the same for the same capture, at any attempt."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}"


def header(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def capture_records(page_id: int | None, url: str, payload: bytes, digest: str, size: int, original: tuple[int, str] | None) -> list[bytes]:
    """The three records of one capture; ``original`` is (page id, URL) of the response that it revisits."""
    own = capture_id(page_id, digest, url)
    target = "".join(c if c.isprintable() and c != " " else "%" + "%".join(f"{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)
    host = target.partition("://")[2].partition("/")[0]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target)]
    typed = [("WARC-Type", "response")]
    if original:
        typed = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{capture_id(original[0], digest, original[1])}>")]
    main = [*typed, ("WARC-Record-ID", f"<{own}>"), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    ask = f"GET {'/' + target.partition('://')[2].partition('/')[2]} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    notes = "".join(f"{k}: {v}\r\n" for k, v in (("pageId", page_id), ("revisitOf", original and original[0])) if v is not None).encode()
    beside = lambda kind: [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, kind + own)}>"), *common, ("WARC-Concurrent-To", f"<{own}>")]
    return [
        header(main, http if original else http + payload),
        header([*beside("request"), ("Content-Type", "application/http; msgtype=request")], ask),
        header([*beside("metadata"), ("Content-Type", "application/warc-fields")], notes),
    ]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write one capture per row below ``folder``; return the stored manifest of files."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    # hot groups shrink before the shuffle: only counts and the largest capture go on
    groups = (
        rows.where(F.col("size") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    marked = rows.join(groups, "digest", "left")
    revisit = ~F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("first").isNotNull()
    marked = marked.select(
        "page_id", "url", "digest", "size",
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
        F.when(revisit, F.col("first.page_id")).alias("first_id"),
        F.when(revisit, F.col("first.url")).alias("first_url"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        context = TaskContext.get()
        out, path, written, records, manifest = None, "", 0, 0, []
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None:
                        path = f"{base}/part-{context.partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                        store.create_dir(base)
                        out, written, records = store.open_output_stream(path), 0, 0
                    first = None if row["first_url"] is None else (row["first_id"], row["first_url"])
                    for record in capture_records(row["page_id"], row["url"], row["payload"], row["digest"], row["size"], first):
                        press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        data = press.compress(record) + press.flush()
                        out.write(data)
                        written, records = written + len(data), records + 1
                    if written >= FILE_BYTES:
                        out.close()
                        manifest.append((path, records, written))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            manifest.append((path, records, written))
        columns = zip(*manifest, strict=True) if manifest else ((), (), ())
        kinds = (pa.string(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return stored(marked.mapInArrow(write, MANIFEST), "manifest")


def members(stream) -> Iterator[bytes]:
    """The records of a .warc.gz stream, one gzip member each."""
    unpack, parts = zlib.decompressobj(31), []
    while chunk := stream.read(1 << 20):
        while chunk:
            parts.append(unpack.decompress(chunk))
            chunk = b""
            if unpack.eof:
                yield b"".join(parts)
                chunk = unpack.unused_data
                unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, in lower case, and the block of Content-Length bytes."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("the record is shorter than its Content-Length")
    return fields, rest[:size]


def read_archives(manifest: DataFrame, root: str, keep_payload: bool = False) -> DataFrame:
    """One row per record (``RECORD``) of the files that the manifest names."""
    schema = RECORD + (", payload binary" if keep_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def bare(value: str | None) -> str | None:
        return value.strip("<>") if value else None

    def row_of(fields: dict[str, str], block: bytes, ordinal: int) -> list:
        kind = fields["warc-type"]
        page_id = refers = size = digest = payload = None
        refers = bare(fields.get("warc-refers-to"))
        if kind == "metadata":
            notes = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if line)
            page_id = int(notes["pageId"]) if "pageId" in notes else None
            refers = notes.get("revisitOf")
        elif kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            if kind == "response":
                size, digest = len(payload), hashlib.sha1(payload).hexdigest()
            else:
                size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
        stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        own = [bare(fields["warc-record-id"]), kind, bare(fields.get("warc-concurrent-to")), fields.get("warc-target-uri"), refers, page_id, size, digest, stated, ordinal]
        return [*own, payload] if keep_payload else own

    kinds = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * keep_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path) as stream:
                    for ordinal, record in enumerate(members(stream)):
                        rows.append(row_of(*parse_record(record), ordinal))
                        held += 400 + (len(record) if keep_payload else 0)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = manifest.select("path")
    return files.repartition(max(1, min(files.count(), 100_000)), "path").mapInArrow(read, schema)


def assemble_transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, request and metadata.

    Requests and metadata are first brought to one row per capture that they
    are concurrent to, so a capture that was written several times over keeps
    exactly its number of rows.
    """
    captures = records.where(F.col("record_type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture"),
        F.struct("record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "header_digest").alias("response"),
    )
    beside = (
        records.where(F.col("record_type").isin("request", "metadata"))
        .groupBy(F.col("concurrent_to").alias("capture"))
        .agg(
            F.max(F.when(F.col("record_type") == "request", F.struct("record_id", "target_uri"))).alias("request"),
            F.max(F.when(F.col("record_type") == "metadata", F.struct("record_id", "page_id", "refers_to"))).alias("metadata"),
        )
    )
    # the records come from a manifest of a few rows, so the planner would take them for small
    return captures.join(beside.hint("merge"), "capture", "left")


def archive_and_reassemble(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` as WARC below the shared folder, read it back, one nested row per capture."""
    ship_code(spark)
    folder = scratch(spark, "warc")
    return assemble_transactions(read_archives(write_archives(pages, folder), folder))
