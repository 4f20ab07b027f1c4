"""WARC archives, and their records as a chunked table.

Both directions go through the chunked record table: rows of record and chunk number with at most ``CHUNK`` bytes of payload.

Writing: payloads are cut into chunk rows before they reach a writer, which compresses chunk after chunk, carries the SHA-1 so far and compares it with the
header's at the end. Each task streams its rows into archive files of the shared folder; a file gets a fresh name for each attempt, and only
files of the attempt whose manifest row is kept count, so a lost executor leaves at most an unread file. A payload that
equals another one is written once as ``response``; the others are ``revisit`` records that refer to it.

Reading: a file is inflated and parsed as a stream. A chunk row also has the bytes so far and the SHA-1 of the payload so far, so no record is
held whole. Files are read in parallel. A file that is cut, or that lacks a record of its manifest row, raises.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm.scratch import new_path, save

CHUNK = 1 << 16
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
FILE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3a://", "s3://", re.sub("^file:/+", "file:///", uri)))


def record_id(page_id: int | None, copy: int) -> str:
    """A record's id follows from its page, so that a revisit can name its response before that is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{copy}')}>"


def _head(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


class Writer:
    """Gzipped WARC records in files of about FILE_BYTES; each record is a gzip member."""

    def __init__(self, folder: str):
        self.uri = folder.rstrip("/")
        self.system, self.folder = _open(self.uri)
        self.out, self.done, self.expected = None, [], None

    def _start(self) -> None:
        self.system.create_dir(self.folder, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        self.path = f"{self.uri}/{name}"
        self.out, self.bytes, self.records = self.system.open_output_stream(f"{self.folder}/{name}", compression=None), 0, 0
        self._begin()
        self._put(_head([("WARC-Type", "warcinfo"), ("WARC-Date", DATE), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields"), ("Content-Length", "0")]))
        self._finish()

    def _begin(self) -> None:
        self.z = zlib.compressobj(1, zlib.DEFLATED, 31)

    def _put(self, data: bytes | memoryview) -> None:
        if got := self.z.compress(data):
            self.out.write(got)
            self.bytes += len(got)

    def _finish(self) -> None:
        got = self.z.compress(_END) + self.z.flush()
        self.out.write(got)
        self.bytes += len(got)

    def begin(self, page_id: int | None, url: str | None, size: int, sha1_hex: str, refers_to: int | None) -> None:
        """The head of a record of ``size`` bytes of payload; a revisit has none of its own."""
        if self.out is None:
            self._start()
        kind = "response" if refers_to is None else "revisit"
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"Content-Length: {size}\r\n\r\n".encode())
        body = size if refers_to is None else 0
        fields = [("WARC-Type", kind), ("WARC-Date", DATE), ("WARC-Record-ID", record_id(page_id, 0)), ("WARC-Target-URI", quote(url or "urn:none", safe=":/?#[]@!$&'()*+,;=%-._~")),
                  ("X-Page-Id", "" if page_id is None else str(page_id)), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode())]
        if refers_to is not None:
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, 0)), ("X-Refers-To-Page-Id", str(refers_to))]
        fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + body))]
        self._begin()
        self._put(_head(fields) + http)
        self.left, self.sha, self.expected = body, hashlib.sha1(), sha1_hex if refers_to is None else None

    def chunk(self, data: memoryview) -> None:
        """The next bytes of the record's payload; the record ends when all have come."""
        self._put(data)
        self.sha.update(data)
        self.left -= len(data)
        if self.left <= 0:
            if self.left or self.expected not in (None, self.sha.hexdigest()):
                raise ValueError("a payload's chunks don't add up to it")
            self._finish()
            self.records += 1
            if self.bytes >= FILE_BYTES:
                self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.records, self.bytes))
            self.out = None


_MANIFEST = "path string, records long, bytes long"


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes a record for each row of page_id, url and html, and returns the manifest of the files (path, records, bytes).

    Of equal payloads of ``least_bytes`` or more, the one with the largest page_id is the response; rows that repeat
    that page_id are responses too. A null html is an empty payload; a null page_id is never referred to.
    """
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", body.alias("body"), F.sha1(body).alias("sha1"), F.octet_length(body).alias("size"))
    last = (rows.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
            .where("n > 1 and last is not null").select("sha1", "size", "last"))
    refers = F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last"))
    ready = rows.join(last.hint("merge"), ["sha1", "size"], "left").withColumn("refers_to", refers)
    # chunks are cut before rows are multiplied, so the whole body isn't repeated for each
    count = F.when(F.col("refers_to").isNull() & (F.col("size") > 0), F.ceil(F.col("size") / CHUNK)).otherwise(F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.when(F.col("refers_to").isNull(), F.substring("body", k * CHUNK + 1, F.lit(CHUNK))).otherwise(F.lit(b"")))
    chunks = ready.select("page_id", "url", "size", "sha1", "refers_to", cut.alias("cut")).select("page_id", "url", "size", "sha1", "refers_to", F.posexplode("cut").alias("chunk_no", "data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Writer(folder)
        for b in batches:
            data = b.column(6)
            for r, (page, url, size, sha, ref, number) in enumerate(zip(*(b.column(k).to_pylist() for k in range(6)), strict=True)):
                if number == 0:
                    w.begin(page, url, size, sha, ref)
                w.chunk(memoryview(data[r].as_buffer()))
        w.close()
        if w.done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*w.done, strict=True)], names=["path", "records", "bytes"])
    return save(chunks.mapInArrow(run, _MANIFEST), "manifest")


class _Stream:
    """Bytes of a gzipped file, member after member, read a piece at a time."""

    def __init__(self, source):
        self.source, self.z, self.held, self.raw, self.inside = source, zlib.decompressobj(31), b"", b"", False

    def _more(self) -> bool:
        while True:
            if self.z.eof:
                self.raw, self.z, self.inside = self.z.unused_data, zlib.decompressobj(31), False
            if not self.raw and not self.z.unconsumed_tail:
                self.raw = self.source.read(CHUNK)
                if not self.raw:
                    if self.inside:
                        raise EOFError("the archive ends inside a gzip member")
                    return False
            data, self.raw, self.inside = self.z.unconsumed_tail or self.raw, b"", True
            got = self.z.decompress(data, CHUNK)
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """All up to and with ``mark``; None at the end of the file, which must not come after a part of it."""
        while (k := self.held.find(mark)) < 0:
            if not self._more():
                if self.held:
                    raise EOFError("the archive ends inside a record")
                return None
        out, self.held = self.held[: k + len(mark)], self.held[k + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces of up to CHUNK."""
        while n:
            if not self.held and not self._more():
                raise EOFError("the archive ends inside a record")
            out = self.held[: min(n, CHUNK)]
            self.held, n = self.held[len(out) :], n - len(out)
            yield out


def read_records(source) -> Iterator[tuple[dict[str, str], int, bytes, int, str, bool]]:
    """(fields, chunk number, bytes, bytes so far, SHA-1 so far, last) for each chunk of each record's payload; an empty payload has one empty chunk."""
    s = _Stream(source)
    while (head := s.until(_END)) is not None:
        lines = head.decode("utf-8", "replace").strip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        left = int(fields["content-length"])
        if fields.get("content-type", "").startswith("application/http"):
            left -= len(s.until(_END) or b"")
        if left < 0:
            raise EOFError("the archive ends inside a record")
        sha, total, number, chunk = hashlib.sha1(), 0, 0, b""
        for piece in s.take(left):
            chunk += piece
            while len(chunk) >= CHUNK and total + CHUNK < left:
                sha.update(chunk[:CHUNK])
                total += CHUNK
                yield fields, number, chunk[:CHUNK], total, sha.hexdigest(), False
                number, chunk = number + 1, chunk[CHUNK:]
        sha.update(chunk)
        yield fields, number, chunk, total + len(chunk), sha.hexdigest(), True
        if s.until(_END) is None:
            raise EOFError("the archive ends inside a record")


_CHUNKS = "record_id string, record_type string, page_id long, url string, header_digest string, refers_to long, chunk_no int, data binary, bytes_so_far long, digest_so_far string, last boolean"


def read_archives(manifest: DataFrame) -> DataFrame:
    """The chunk table of all page records in the manifest's files (path and records), each file in a task of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _CHUNKS.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            for path, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, at = _open(path)
                rows, held, ends = [], 0, 0
                with system.open_input_stream(at, compression=None) as source:
                    for f, number, data, total, sha, last in read_records(source):
                        if f["warc-type"] not in ("response", "revisit"):
                            continue
                        num = lambda k, f=f: int(f[k]) if f.get(k) else None
                        digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                        rows.append((f["warc-record-id"], f["warc-type"], num("x-page-id"), f.get("warc-target-uri"), digest, num("x-refers-to-page-id"), number, data, total, sha, last))
                        held += len(data)
                        ends += last
                        if held > 4 * CHUNK or len(rows) >= 2000:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)
                if ends != expected:
                    raise EOFError(f"{path} has {ends} of {expected} records")
    # a given number of partitions isn't coalesced
    return manifest.select("path", "records").repartitionByRange(max(1, manifest.count()), "path").mapInArrow(run, _CHUNKS)


def payloads(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record, from its last chunk; a revisit's from the response that it refers to."""
    ends = chunks.where("last").select("page_id", "record_type", "refers_to", "header_digest", F.col("bytes_so_far").alias("bytes"), F.col("digest_so_far").alias("digest"))
    own = ends.where("record_type = 'response'")
    full = own.select(F.col("page_id").alias("refers_to"), F.col("bytes").alias("r_bytes"), F.col("digest").alias("r_digest")).dropDuplicates(["refers_to"])
    revisits = ends.where("record_type = 'revisit'").join(full, "refers_to", "left").select("page_id", F.col("r_bytes").alias("bytes"), F.when(F.col("r_digest") == F.col("header_digest"), F.col("r_digest")).alias("digest"), "record_type", "refers_to")
    return (own.select("page_id", "bytes", "digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)
            .select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"))


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes archives of ``pages`` in the shared folder, reads them back, and reports each record's payload."""
    manifest = write_archives(pages, new_path(pages.sparkSession, "warc"))
    return payloads(save(read_archives(manifest).drop("data"), "records"))
