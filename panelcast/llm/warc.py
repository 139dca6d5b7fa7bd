"""WARC archives: monolithic gzip files rewritten record by record, with a sidecar offset index.

A crawl writer often compresses a whole archive as one gzip stream, which can
only be read from its start.  ``normalise`` inflates such a stream once, writes
every record as a gzip member of its own, and puts a sidecar index (JSON lines:
offset, length, record) beside the archive, so that any record can be fetched
by one ranged read.  On the way, records whose payload an earlier page holds
become ``revisit`` records: headers, and a reference to the response.

The job never shuffles a payload.  Every partition writes its pages in place
(archives roll at ``ROLL`` bytes), and only (archive, place, id, digest, size)
travels: equal digests are counted before they move, the least id of each
digest comes back to its archive, and the archive's task edits the stream.
Archives lie under names of their own in the shared folder, and only those
that a finished task reports are read, so a task that is run again leaves at
most files that nobody reads.

Results for odd input:
* a null html is an empty payload; empty payloads are equal to each other;
* very long pages are one record each, of which a task holds one at a time;
* of rows with equal id and payload one is the response, the others revisit it;
* null ids come last among equal payloads; a null URL has no target header and
  comes back null;
* control characters in a URL are percent-encoded in its header, and come back
  so; the bytes of a payload are kept as they are;
* an empty table makes no archive; further columns are ignored, whatever their
  names;
* a damaged or cut-off archive, or a payload that differs from its digest, is a
  ``ValueError`` that names the archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

ROLL = 256 << 20  # uncompressed bytes after which a new archive begins
CHUNK = 1 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTROL = re.compile(r"[\x00-\x20\x7f]")

Headers = list[tuple[str, str]]


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, as Spark writes them."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(archive: str, seq: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{seq}')}>"


def encode(headers: Headers, block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


class Inflated:
    """Bytes of a gzip file of one or many members, inflated as they are asked for."""

    def __init__(self, read: Callable[[int], bytes], name: str) -> None:
        self.read_raw, self.name = read, name
        self.inflate = zlib.decompressobj(31)
        self.rest, self.buffer, self.inside = b"", bytearray(), False

    def _more(self) -> bool:
        """Inflate a little further; False at the end of the file."""
        raw = self.rest or self.read_raw(CHUNK)
        self.rest = b""
        if not raw and not self.inside:
            return False
        try:
            new = self.inflate.decompress(raw, CHUNK)
        except zlib.error as e:
            raise ValueError(f"{self.name}: {e}") from e
        if not raw and not new and not self.inflate.eof:
            raise ValueError(f"{self.name}: the gzip stream is cut off")
        self.buffer += new
        self.inside = not self.inflate.eof
        if self.inflate.eof:
            self.rest = self.inflate.unused_data
            self.inflate = zlib.decompressobj(31)
        else:
            self.rest = self.inflate.unconsumed_tail
        return True

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError(f"{self.name}: a record is cut off")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def head(self) -> bytes | None:
        """Up to the next empty line; None at the end."""
        at = 0
        while (end := self.buffer.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(self.buffer) - 3)
            if not self._more():
                if self.buffer:
                    raise ValueError(f"{self.name}: a record header is cut off")
                return None
        return self.take(end + 4)


def records(stream: Inflated) -> Iterator[tuple[Headers, bytes]]:
    """Headers (without Content-Length) and block of every record."""
    while (head := stream.head()) is not None:
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"{stream.name}: no record where one should begin")
        headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines if x)]
        size = [v for k, v in headers if k.lower() == "content-length"]
        if len(size) != 1 or not size[0].isdigit():
            raise ValueError(f"{stream.name}: a record without length")
        block = stream.take(int(size[0]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"{stream.name}: a record does not end where its length says")
        yield [(k, v) for k, v in headers if k.lower() != "content-length"], block


def normalise(source: str, target: str, edit: Callable[[Headers, bytes], tuple[Headers, bytes]]) -> int:
    """Rewrite an archive with one gzip member per record and its index in ``target + '.idx'``; the number of records."""
    from_fs, from_path = filesystem(source)
    to_fs, to_path = filesystem(target)
    n = 0
    with from_fs.open_input_stream(from_path, compression=None) as raw, to_fs.open_output_stream(to_path, compression=None) as out, \
            to_fs.open_output_stream(to_path + ".idx", compression=None) as index:
        for headers, block in records(Inflated(lambda k: raw.read(k), source)):
            headers, block = edit(headers, block)
            squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = squeeze.compress(encode(headers, block)) + squeeze.flush()
            entry = {"offset": out.tell(), "length": len(member)} | {k: v for k, v in headers}
            out.write(member)
            index.write((json.dumps(entry) + "\n").encode())
            n += 1
    return n


def index_entries(archive: str) -> Iterator[dict]:
    """The sidecar index, line by line."""
    where, path = filesystem(archive + ".idx")
    with where.open_input_stream(path, compression=None) as f:
        rest = b""
        while chunk := f.read(CHUNK):
            *lines, rest = (rest + chunk).split(b"\n")
            yield from map(json.loads, lines)


def fetch(archive: str, offset: int, length: int) -> tuple[Headers, bytes]:
    """One record by a ranged read."""
    where, path = filesystem(archive)
    with where.open_input_file(path) as f:
        return _member(f.read_at(length, offset), archive)


def _member(raw: bytes, archive: str) -> tuple[Headers, bytes]:
    pieces = iter([raw])
    found = list(records(Inflated(lambda _: next(pieces, b""), archive)))
    if len(found) != 1:
        raise ValueError(f"{archive}: an index entry does not hold one record")
    return found[0]


# -- the table side ---------------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   roll: int = ROLL, date: str = DATE) -> DataFrame:
    """Write every page as a response record, archives being one gzip stream each: (archive, seq, id, digest, bytes)."""
    slim = pages.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"),
                        F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").cast("binary").alias("payload"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(folder)
        out = squeeze = None
        archive, seq, size = "", 0, 0

        def close() -> None:
            if out is not None:
                out.write(squeeze.flush())
                out.close()

        for b in batches:
            rows = []
            for name, url, payload in zip(*[b.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                if out is None or size >= roll:
                    close()
                    where.create_dir(base, recursive=True)
                    archive, seq, size = f"mono-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where.open_output_stream(f"{base}/{archive}", compression=None)
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(archive, 0)), ("WARC-Date", date),
                            ("Content-Type", "application/warc-fields")]
                    out.write(squeeze.compress(encode(info, b"format: WARC File Format 1.1\r\n")))
                payload = payload or b""
                seq += 1
                digest = digest_of(payload)
                headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(archive, seq)), ("WARC-Date", date),
                           ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
                if url is not None:
                    headers.append(("WARC-Target-URI", CONTROL.sub(lambda m: quote(m[0]), url)))
                if name is not None:
                    headers.append(("X-Page-Id", quote(name)))
                record = encode(headers, http_head(len(payload)) + payload)
                size += len(record)
                out.write(squeeze.compress(record))
                rows.append((archive, seq, digest, len(payload)))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), b.column(0),
                                   pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())],
                                  ["archive", "seq", "id", "digest", "bytes"])
        close()

    return slim.mapInArrow(run, f"archive string, seq long, id {kind}, digest string, bytes long")


def revisits(written: DataFrame, least: int = 0) -> DataFrame:
    """``written`` with ``first``: the record that this one revisits (null for responses)."""
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "archive", "seq")
    firsts = written.where(F.col("bytes") >= least).groupBy("digest", "bytes") \
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = written.join(firsts, ["digest", "bytes"], "left")
    itself = (F.col("first.archive") == F.col("archive")) & (F.col("first.seq") == F.col("seq"))
    return met.select("archive", "seq", F.when(~itself, F.struct(
        F.col("first.archive").alias("archive"), F.col("first.seq").alias("seq"),
        F.col("first.id").cast("string").alias("id"))).alias("first"))


def _revisit(headers: Headers, block: bytes, first: dict) -> tuple[Headers, bytes]:
    """The record without its payload; its HTTP head keeps the payload's size."""
    out = [(k, "revisit" if k == "WARC-Type" else v) for k, v in headers]
    out += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first["archive"], first["seq"]))]
    if first["id"] is not None:
        out.append(("X-Refers-To-Page-Id", quote(first["id"])))
    return out, block[:block.index(b"\r\n\r\n") + 4]


def normalise_all(places: DataFrame, folder: str) -> DataFrame:
    """Normalise the archives of ``revisits``, one task each: (archive, records)."""
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, dict | None]]:
        for b in batches:
            yield from zip(*[b.column(k).to_pylist() for k in range(3)], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(folder)
        for archive, group in groupby(rows(batches), lambda r: r[0]):
            def edit(headers: Headers, block: bytes, group=group) -> tuple[Headers, bytes]:
                if ("WARC-Type", "warcinfo") in headers:
                    return headers, block
                _, seq, first = next(group)
                if ("WARC-Record-ID", record_id(archive, seq)) not in headers:
                    raise ValueError(f"{archive}: record {seq} is not in its place")
                return (headers, block) if first is None else _revisit(headers, block, first)

            target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            n = normalise(f"{folder}/{archive}", target, edit)
            yield pa.record_batch([pa.array([target]), pa.array([n], pa.int64())], ["archive", "records"])

    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few slim rows stand for large files: no merging
    return places.repartition(n, "archive").sortWithinPartitions("archive", "seq").mapInArrow(run, "archive string, records long")


def read_archives(archives: DataFrame, id_type: str = "string", with_payload: bool = True) -> DataFrame:
    """Every response and revisit record of the archives, read by the sidecar index and checked:
    (id, url, record_type, payload_digest, payload_bytes, refers_to, archive, offset, length, payload)."""
    shape = ("id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, "
             "archive string, offset long, length long, payload binary")
    kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.binary()]
    names = [x.split()[0] for x in shape.split(", ")]

    def one(f, archive: str, entry: dict) -> tuple | None:
        if entry["WARC-Type"] not in ("response", "revisit"):
            return None
        headers, block = _member(f.read_at(entry["length"], entry["offset"]), archive)
        h = dict(headers)
        end = block.index(b"\r\n\r\n") + 4
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block[:end].decode().split("\r\n")[1:])}
        digest, payload = h["WARC-Payload-Digest"].removeprefix("sha1:"), None
        if h["WARC-Type"] == "response":
            payload = block[end:]
            if digest_of(payload) != digest or len(payload) != int(http["content-length"]):
                raise ValueError(f"{archive}: the payload at {entry['offset']} differs from its digest")
        plain = lambda k: unquote(h[k]) if k in h else None
        return (plain("X-Page-Id"), h.get("WARC-Target-URI"), h["WARC-Type"], digest, int(http["content-length"]),
                plain("X-Refers-To-Page-Id"), archive, entry["offset"], entry["length"], payload if with_payload else None)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                where, path = filesystem(archive)
                rows, size = [], 0
                with where.open_input_file(path) as f:
                    for entry in index_entries(archive):
                        if (r := one(f, archive, entry)) is not None:
                            rows.append(r)
                            size += len(r[-1] or b"")
                        if len(rows) >= 2_000 or size > 16 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                yield batch(rows)

    return archives.select("archive").mapInArrow(run, shape).withColumns(
        {c: F.col(c).cast(id_type) for c in ("id", "refers_to")})


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  least: int = 0, roll: int = ROLL) -> DataFrame:
    """Write ``pages`` into ``folder``, payloads of at least ``least`` bytes once, and normalise: (archive, records)."""
    written = cut_lineage(write_archives(pages, folder, id_col, url_col, html_col, roll))  # the files are written once
    return cut_lineage(normalise_all(revisits(written, least), folder))
