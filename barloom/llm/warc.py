"""WARC archives through a chunked record table.

A payload never travels as one value behind the scan: it is a run of rows
(record, chunk number, bytes). The writer streams those rows into archive files
with an incremental digest; the reader streams archives back into the same kind
of rows, each carrying the digest of the payload up to and including its chunk.
Both hold one chunk and one buffer, whatever the size of a record.

Records with equal payloads (SHA-1 and length) of at least ``min_revisit_bytes``
are written once, for the largest key, as ``response``; the others are
``revisit`` records that refer to it. Finding that key is an aggregate with
partial sums before the shuffle, so a payload that a third of all rows share
costs one row a task.

Archives go to the given folder (below ``spark.checkpoint.dir`` by default)
through ``pyarrow.fs``, one gzip member a record. File names are unique to the
attempt, and only files that the finished job's manifest names are read, so
lost executors and retried tasks leave no trace in the result.

Edge cases: a null payload is empty; a null URL is written as an empty header;
repeated rows are a record each, of one kind (all responses if theirs is the
largest key, else all revisits); a row without a key is a response without a
record number and comes back without one; an empty table makes an empty
manifest; other columns may have any name. Keys travel as text, so every 64-bit
number comes back as it was.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, shared_dir, small_batches

#: Bytes of payload in a row of the chunk table.
CHUNK_BYTES = 64 * 1024
#: Chunks that go to a Python worker at a time, so that it holds 16 MB of them.
BATCH_CHUNKS = 256
#: A new archive file is begun beyond this many compressed bytes.
ARCHIVE_BYTES = 512 * 1024 * 1024
DATE = "2025-01-01T00:00:00Z"
RECORD = "urn:barloom:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = (
    "record string, chunk_no int, data binary, digest string, last boolean, payload_bytes long, "
    "payload_digest string, record_type string, refers_to string, uri string"
)


def chunk_table(pages: DataFrame, key: str, url: str, payload: str, chunk_bytes: int = CHUNK_BYTES, min_revisit_bytes: int = 0) -> DataFrame:
    """Rows (key, uri, refers_to, bytes, sha1, chunk_no, chunks, chunk), a record's chunks in order."""
    full = pages.select(
        F.col(key).cast("long").alias("key"),
        F.coalesce(F.col(url).cast("string"), F.lit("")).alias("uri"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    digests = full.select("key", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    newest = digests.where(F.col("bytes") >= min_revisit_bytes).groupBy("sha1", "bytes").agg(F.max("key").alias("keep"), F.count("*").alias("n"))
    repeats = newest.where("n > 1").select("sha1", "bytes", "keep")
    # only revisits join the payloads, and by key and digest, which are spread evenly
    revisits = digests.join(repeats, ["sha1", "bytes"]).where("key <> keep").select("key", "sha1", F.col("keep").cast("string").alias("refers_to")).distinct()
    known = full.select("key", "uri", "payload", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    rows = known.join(revisits, ["key", "sha1"], "left")
    n = F.when(F.col("refers_to").isNotNull(), F.lit(1)).otherwise(F.greatest(F.ceil(F.col("bytes") / chunk_bytes), F.lit(1))).cast("int")
    # the numbers are exploded and each row cuts its own chunk, so no second payload is built
    each = rows.withColumn("chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    chunk = F.when(F.col("refers_to").isNull(), F.substring(F.col("payload"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    return each.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "uri", "refers_to", "bytes", "sha1", "chunks", "chunk_no", chunk.alias("chunk"))


def _open(path: str, write: bool):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if write:
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(at, compression=None)
    return system.open_input_stream(at, compression=None)


def _header(r) -> bytes:
    digest = base64.b32encode(bytes.fromhex(r.sha1)).decode()
    uri = "".join(c for c in r.uri if c >= " " and c != "\x7f")
    revisit = isinstance(r.refers_to, str)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % r.bytes
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD}{r.key}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {r.bytes}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD}{r.refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else r.bytes)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = path = gz = sha = None
        size = records = 0
        for b in batches:
            for r in b.itertuples(index=False):
                if out is None:
                    path, size, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(path, True)
                if r.chunk_no == 0:
                    gz, sha, sent = zlib.compressobj(3, zlib.DEFLATED, 31), hashlib.sha1(), 0
                    size += out.write(gz.compress(_header(r))) or 0
                chunk = bytes(r.chunk)
                sha.update(chunk)
                sent += len(chunk)
                z = gz.compress(chunk)
                out.write(z)
                size += len(z)
                if r.chunk_no == r.chunks - 1:
                    if not isinstance(r.refers_to, str) and (sent != r.bytes or sha.hexdigest() != r.sha1):
                        raise ValueError(f"record {r.key}: the chunks do not add up to the payload")
                    z = gz.compress(b"\r\n\r\n") + gz.flush()
                    out.write(z)
                    size, records = size + len(z), records + 1
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        yield pd.DataFrame({"path": [path], "records": [records], "bytes": [size]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [records], "bytes": [size]})

    return write


def write_warc(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the chunk table as archives; the manifest (path, records, bytes), as it stands in the folder."""
    small_batches(chunks.sparkSession, BATCH_CHUNKS)
    return materialize(chunks.mapInPandas(_writer(folder, archive_bytes), "path string, records long, bytes long"), "manifest")


class _Stream:
    """Bytes of an archive: decompressed as they are asked for."""

    def __init__(self, source, block: int = 256 * 1024):
        self.source, self.block, self.buffer, self.z = source, block, bytearray(), zlib.decompressobj(31)
        self.rest = b""

    def _more(self) -> bool:
        raw = self.rest or self.source.read(self.block)
        if not raw:
            return False
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        self.buffer += self.z.decompress(raw, self.block)
        self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        if len(out) < n:
            raise EOFError("the archive ends within a record")
        del self.buffer[:n]
        return out


def records_of(source, chunk_bytes: int) -> Iterator[tuple]:
    """Chunk rows of an archive, as in ``CHUNKS``."""
    s = _Stream(source)
    while (head := s.until(b"\r\n\r\n")) is not None:
        h = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        left = int(h["Content-Length"])
        if h["Content-Type"].startswith("application/http"):
            left -= len(s.until(b"\r\n\r\n")) + 4
        kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
        stated = int(h["WARC-Payload-Length"])
        fixed = (digest, kind, h.get("WARC-Refers-To", "").strip("<>") or None, h.get("WARC-Target-URI"))
        sha, n, size = hashlib.sha1(), 0, 0
        while True:
            data = s.take(min(left, chunk_bytes))
            left -= len(data)
            sha.update(data)
            size += len(data)
            so_far = base64.b32encode(sha.copy().digest()).decode()
            if not left and kind == "response" and (so_far != digest or size != stated):
                raise ValueError(f"{h['WARC-Record-ID']}: the payload does not have the digest or length that its header states")
            # of a response the bytes read so far; a revisit has no payload, only its header's length
            yield (h["WARC-Record-ID"].strip("<>"), n, data, so_far, not left, size if kind == "response" else stated, *fixed)
            n += 1
            if not left:
                break
        s.take(4)


def read_warc(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, rows: int = BATCH_CHUNKS) -> DataFrame:
    """The chunk rows of the manifest's archives; ``digest`` is that of the payload so far."""
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                with _open(path, False) as source:
                    batch = []
                    for row in records_of(source, chunk_bytes):
                        batch.append(row)
                        if len(batch) >= rows:
                            yield pd.DataFrame(batch, columns=names)
                            batch = []
                    if batch:
                        yield pd.DataFrame(batch, columns=names)

    files = manifest.select("path")
    width = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(max(width, 1), "path").mapInPandas(read, CHUNKS)


def op4_warc_chunks(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    chunks = chunk_table(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    back = read_warc(write_warc(chunks, shared_dir(spark, "warc")))

    def page(c):
        return F.substring(c, len(RECORD) + 1, 20).try_cast("long")

    # a record's last chunk row knows the whole payload; no shuffle is needed
    return back.where("last").select(
        page("record").alias("page_id"),
        "payload_bytes",
        F.when(F.col("record_type") == "response", F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
        (F.col("chunk_no") + 1).cast("long").alias("chunks"),
    )
