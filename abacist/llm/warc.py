"""WARC archives as tables of record chunks."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.llm.common import raw, shared_folder, small, written

#: Bytes of payload in one chunk row, and of an archive that one task reads.
CHUNK_BYTES = 64 << 10
SPLIT_BYTES = 8 << 20
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 100
RECORD = "urn:page:"
MANIFEST = "path string, start long, stop long, records long"
CHUNKS = "page_id long, record_type string, refers_to long, url string, chunk_no long, data binary, payload_bytes long, payload_digest string, last boolean"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _head(page_id, url, digest, size, refers_to) -> bytes:
    """Record header and HTTP header; a page without id gets a random name."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = f"{RECORD}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    lines.append(f"Content-Length: {len(http) + (size if refers_to is None else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def _writing(folder: str):
    """One archive per task, a gzip member per record; rows of the manifest name its readable parts.

    A task that is run again writes another file: only files in the manifest count.
    """

    def run(batches):
        store, base = _files(folder)
        path = f"{base}/{uuid.uuid4().hex}.warc.gz"
        start = at = records = 0
        store.create_dir(base, recursive=True)
        rows = []
        with store.open_output_stream(path, compression=None) as f:
            for batch in batches:
                data, offsets = raw(batch.column(2))
                columns = [batch.column(k).to_pylist() for k in (0, 1, 3, 4)]
                for k, (page_id, url, digest, refers_to) in enumerate(zip(*columns)):
                    payload = memoryview(data[offsets[k] : offsets[k + 1]])
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    at += f.write(z.compress(_head(page_id, url, digest, len(payload), refers_to)))
                    if refers_to is None:
                        for s in range(0, len(payload), CHUNK_BYTES):
                            at += f.write(z.compress(payload[s : s + CHUNK_BYTES]))
                    at += f.write(z.compress(b"\r\n\r\n") + z.flush())
                    records += 1
                    if at - start >= SPLIT_BYTES:
                        rows.append((start, at, records))
                        start, records = at, 0
        if records:
            rows.append((start, at, records))
        table = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *[pa.array(list(c), pa.int64()) for c in table]], names=["path", "start", "stop", "records"])

    return run


class _Bytes:
    """Decompressed bytes of a part of an archive, a little at a time."""

    def __init__(self, f, start, stop):
        f.seek(start)
        self.f, self.left, self.z, self.held = f, stop - start, zlib.decompressobj(31), b""

    def more(self) -> bool:
        while True:
            if self.z.eof:
                rest = self.z.unused_data
                self.z = zlib.decompressobj(31)
                data = rest
            else:
                data = self.z.unconsumed_tail
            if not data:
                data = self.f.read(min(self.left, CHUNK_BYTES))
                self.left -= len(data)
                if not data:
                    return False
            got = self.z.decompress(data, CHUNK_BYTES)
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (k := self.held.find(mark)) < 0:
            if not self.more():
                return None
        out, self.held = self.held[:k], self.held[k + len(mark) :]
        return out

    def take(self, n: int):
        """The next n bytes in pieces."""
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends within a record")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def _page(name: str | None):
    return int(name[len(RECORD) + 1 : -1]) if name and name.startswith(f"<{RECORD}") else None


def _records(stream: _Bytes):
    """Chunk rows of every record: each carries the bytes and the digest up to its end."""
    while (head := stream.until(b"\r\n\r\n")) is not None:
        f = _fields(head)
        http = stream.until(b"\r\n\r\n")
        h = _fields(http)
        common = (_page(f["warc-record-id"]), f["warc-type"], _page(f.get("warc-refers-to")), f.get("warc-target-uri"))
        if f["warc-type"] == "revisit":
            yield (*common, 0, b"", int(h["content-length"]), f["warc-payload-digest"].partition(":")[2], True)
        else:
            size = int(f["content-length"]) - len(http) - 4
            digest, done, number, part = hashlib.sha256(), 0, 0, b""
            for piece in stream.take(size):
                part += piece
                while len(part) >= CHUNK_BYTES and done + CHUNK_BYTES < size:
                    digest.update(part[:CHUNK_BYTES])
                    done += CHUNK_BYTES
                    yield (*common, number, part[:CHUNK_BYTES], done, digest.hexdigest(), False)
                    part, number = part[CHUNK_BYTES:], number + 1
            digest.update(part)
            if digest.hexdigest() != f["warc-payload-digest"].partition(":")[2]:
                raise ValueError(f"payload of {f['warc-record-id']} does not have its digest")
            yield (*common, number, part, size, digest.hexdigest(), True)
        for _ in stream.take(4):
            pass


def _reading(folder: str):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        store, _ = _files(folder)
        for b in batches:
            for path, start, stop, _ in zip(*[c.to_pylist() for c in b.columns]):
                with store.open_input_file(path) as f:
                    rows, size = [], 0
                    for row in _records(_Bytes(f, start, stop)):
                        rows.append(row)
                        size += len(row[5])
                        if size >= 16 * CHUNK_BYTES or len(rows) >= 4096:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a WARC record per row under `folder` and return the manifest of what was written.

    Of rows with equal payloads of at least LEAST_REVISIT bytes, that with the
    smallest id is a response and the others are revisits of it.  Null html is
    an empty payload; a null url has no target header; rows with a null id are
    responses with random names.  `folder` is on storage that all executors
    share, in a form that Arrow's file systems open.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("html"), F.sha2(body.cast("binary"), 256).alias("digest"))
    keys = rows.filter((F.octet_length("html") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest", F.octet_length("html").alias("size"))
    firsts = keys.groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = keys.join(written(firsts), ["digest", "size"]).filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    marked = rows.join(small(written(again)), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    return written(marked.mapInArrow(_writing(folder), MANIFEST))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The chunk rows of all records in the manifest.

    A payload larger than CHUNK_BYTES is many rows (page_id, chunk_no, data);
    payload_bytes and payload_digest run up to the end of the chunk, so the row
    marked `last` has those of the whole payload.  No task holds more than a
    chunk of a record.  Revisits have one row without data.
    """
    parts = manifest.count()
    spread = manifest.repartition(max(1, parts), "path", "start") if parts else manifest
    return spread.mapInArrow(_reading(folder), CHUNKS)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write the archives to a new shared folder, read them back: one row per record.

    Repeated rows are repeated records, and rows that share an id but not the
    payload are records of their own.  An empty table gives an empty result.
    """
    folder = shared_folder(pages.sparkSession)
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    records = read_archives(write_archives(pages, folder, **columns), folder)
    return records.filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
