"""WARC archives: one gzip member per record, written and read back sequentially, with digests verified."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cuespan.llm.common import lookup_join, materialize, scratch

#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 100
#: A file is closed when it has this many bytes; a reader's task is one file.
FILE_BYTES = 64 << 20
CHUNK = 1 << 16
#: Record time is data, not the clock, so that reruns agree byte for byte.
DATE = "1970-01-01T00:00:00Z"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(chunks: Iterator[bytes]) -> Iterator[Iterator[bytes]]:
    """The gzip members of a byte stream, each as an iterator of its decompressed parts."""
    chunks = iter(chunks)
    rest = next(chunks, b"")
    while rest:
        unzip = zlib.decompressobj(31)

        def parts():
            nonlocal rest
            while not unzip.eof:
                data = unzip.decompress(rest, 1 << 20)
                rest = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
                if data:
                    yield data
                elif not unzip.eof and not rest and not (rest := next(chunks, b"")):
                    raise ValueError("the archive ends inside a record")

        yield (own := parts())
        for _ in own:
            pass
        if not rest:
            rest = next(chunks, b"")


def parse_record(parts: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, framed by Content-Length; raises when either digest is wrong."""
    data = bytearray()
    while (end := data.find(b"\r\n\r\n")) < 0:
        if not (part := next(parts, b"")):
            raise ValueError("a record without the end of its header")
        data += part
    first, *lines = data[:end].decode("utf-8", "surrogateescape").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    want = end + 4 + int(head["content-length"])
    for part in parts:
        data += part
    if len(data) != want + 4 or data[want:] != b"\r\n\r\n":
        raise ValueError(f"a record of {len(data)} bytes where {want + 4} are due")
    block = bytes(data[end + 4 : want])
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != head["warc-block-digest"]:
        raise ValueError(f"wrong block digest in {head.get('warc-record-id')}")
    return head, block


def assign_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Pages with their digest and role: page_id, url, html, digest, refers_to (null for a response)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    groups = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    groups = materialize(groups.where("_n > 1"))
    rows = lookup_join(rows, groups, "digest", "_n", "page_id")
    return rows.select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("_first"), F.col("_first")).alias("refers_to"))


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES, level: int = 4) -> DataFrame:
    """Writes archives below `path` and returns their manifest: path, n_records, n_bytes.

    Each task writes files of its own under a name no other attempt uses, on any file system that
    pyarrow reaches by URI; only files in the manifest count, so a retried task does no harm.
    """

    def write(batches):
        store, base = pafs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        out, name, n, size, task = None, "", 0, 0, TaskContext.get().partitionId()
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    name, n, size = f"{task:06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                zipper = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = zipper.compress(record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)) + zipper.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    done, out = [*done, (name, n, size)], None
        if out is not None:
            out.close()
            done.append((name, n, size))
        if done:
            names, counts, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_pydict({"path": [f"{path.rstrip('/')}/{x}" for x in names], "n_records": pa.array(counts, pa.int64()), "n_bytes": pa.array(sizes, pa.int64())})

    return materialize(records.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, "path string, n_records long, n_bytes long"))


READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_warc(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives in `manifest` (path): one task reads whole files from front to back.

    Raises on a broken gzip member, a wrong length, or a block or payload digest that does not
    match. payload is null for revisits, and for all records without `with_payload`.
    """
    number = lambda text: int(x) if (x := text.removeprefix("<urn:page:").removesuffix(">")) else None

    def read(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                store, name = pafs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with store.open_input_stream(name, compression=None) as file:
                    for parts in members(iter(lambda: file.read(CHUNK), b"")):
                        head, block = parse_record(parts)
                        http, _, body = block.partition(b"\r\n\r\n")
                        length = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
                        digest, revisit = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"] == "revisit"
                        if not revisit and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
                            raise ValueError(f"wrong payload in {head['warc-record-id']}")
                        rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], number(head["warc-refers-to"]) if revisit else None, length, digest, body if with_payload and not revisit else None))
                        held += len(body)
                        if len(rows) >= 4096 or held >= 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(read, READ_SCHEMA)


def warc_round_trip(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Writes the pages as archives and reads them back without payloads: READ_SCHEMA, one row per page.

    Of pages with equal payloads of LEAST_BYTES or more the smallest page_id is the response and
    the others revisit it; shorter ones are all responses. A null html is an empty payload, a
    null url is left out, line ends in a url are escaped. A row that repeats an id and payload is
    a response as its twin is. Null ids stay null and are responses. An empty table gives no rows.
    """
    manifest = write_warc(assign_records(pages, **columns), path or scratch(pages.sparkSession))
    return read_warc(manifest, with_payload=False)
