"""WARC archives of pages, and a two-level index of their captures.

Writing: each task writes archives of gzip members, one for each record, into a folder all
machines share; payloads seen before become revisit records. Index: captures sorted by URL key
(host reversed) are packed into compressed blocks; a sparse directory holds the first key of
each block. Reading: binary search in the directory, range read of a block, binary search in
the block, range read of the record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.batches import stored
from brightloom.session import ensure_checkpoint_dir

KEY_LIMIT = 1024
CAPTURES = "url_key string, page_id bigint, file string, offset bigint, length bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload string"
NO_PAGE = -(1 << 63)  # stands for a null page_id where captures are sorted


@dataclass(frozen=True)
class Archiving:
    """file_bytes: an archive this large is closed. block_lines: captures in an index block at least.
    directory_rows: blocks at most (and one for each task more), so that the directory stays
    small; beyond it blocks grow. gap: bytes between two wanted records of a file that are read
    rather than skipped. level: of gzip. date: the records' WARC-Date.
    """

    file_bytes: int = 1 << 28
    block_lines: int = 3000
    directory_rows: int = 100_000
    gap: int = 1 << 16
    level: int = 5
    date: str = "2000-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Sort key of a URL: the host's labels reversed, then port, path and query; scheme, `www.`, fragment and user don't count.

    A key beyond `KEY_LIMIT` characters is cut and ends with a digest of the whole.
    """
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        parts = None
    if parts is None or not host:
        key = url.lower()
    else:
        default = {"http": 80, "https": 443}.get(parts.scheme)
        key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "") + ")" + (parts.path or "/")
        key += f"?{parts.query}" if parts.query else ""
    key = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", key)
    return key if len(key) <= KEY_LIMIT else key[: KEY_LIMIT - 41] + "#" + hashlib.sha1(key.encode()).hexdigest()


def keyed(pages: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(url_key, page_id), one row for each row of `pages`; a null page_id is `NO_PAGE`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [url_key(url) for url in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(0)], ["url_key", "page_id"])

    return pages.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_PAGE)), F.col(url_column)).mapInArrow(run, "url_key string, page_id bigint")


def named(page: int) -> str:
    return f"<urn:x-page:{'none' if page == NO_PAGE else page}>"


def page_of(name: str) -> int | None:
    value = name.rsplit(":", 1)[1].rstrip(">")
    return None if value == "none" else int(value)


def record(page: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, rule: Archiving) -> bytes:
    """The bytes of a response record, or of a revisit of `refers_to`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    uri = re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", named(page)),
        ("WARC-Date", rule.date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", named(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple:
    """A row of `RECORDS` from the bytes of a record; what it says of a payload it holds is checked."""
    head, rest = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, payload = rest[: int(fields["Content-Length"])].split(b"\r\n\r\n", 1)
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    page, url = page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"]
    if kind == "revisit":
        return page, url, size, digest, kind, page_of(fields["WARC-Refers-To"]), None
    if len(payload) != size or base32(payload) != digest:
        raise ValueError(f"damaged record of page {page}")
    return page, url, size, digest, kind, None, payload.decode()


def base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system a URI belongs to, and the path there; executors reach it by themselves."""
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{kind}/{uuid.uuid4().hex}"


class Files:
    """Files of one task in a shared folder. Each attempt has names of its own, so that what a lost one leaves is never read."""

    def __init__(self, folder: str, suffix: str, opening: bytes, limit: int):
        self.store, self.path = store_of(folder)
        self.suffix, self.opening, self.limit, self.out = suffix, opening, limit, None

    def add(self, data: bytes) -> tuple[str, int]:
        """Append; the name of the file and the offset."""
        if self.out is None:
            self.store.create_dir(self.path, recursive=True)
            self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", 0
            self.out = self.store.open_output_stream(f"{self.path}/{self.name}", compression=None)
            self._write(self.opening)
        place = self.name, self.at
        self._write(data)
        if self.at >= self.limit:
            self.close()
        return place

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def packed_pages(pages: DataFrame, id_column: str, url_column: str, payload_column: str) -> DataFrame:
    """(page_id, url, digest, packed): payloads compressed for the way to the writer, with their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            digests, packed = [], []
            for html in batch.column(2):
                payload = (html.as_py() or "").encode()
                digests.append(hashlib.sha1(payload).digest())
                packed.append(packer.compress(payload))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["page_id", "url", "digest", "packed"])

    chosen = pages.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_PAGE)), url_column, payload_column)
    return chosen.mapInArrow(run, "page_id bigint, url string, digest binary, packed binary")


def write_archives(
    pages: DataFrame, least_bytes: int = 0, rule: Archiving = Archiving(), id_column: str = "page_id", url_column: str = "url", payload_column: str = "html"
) -> tuple[str, DataFrame]:
    """Write a record for each page; (folder, captures), captures being a written table of `CAPTURES`.

    Of pages with equal payloads of `least_bytes` or more, that with the smallest page_id is a
    response, others are revisits of it; smaller payloads are all responses. A null payload is
    empty, a null url too. A null page_id is larger than all others here; repeats of the
    response's own row are responses as well. No pages give no files and no rows.
    """
    folder = new_folder(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col(payload_column), F.lit("")), "UTF-8")
    page = F.col(id_column).cast("long")
    narrow = pages.select(page.alias("page_id"), F.unhex(F.sha1(payload)).alias("digest"), F.length(payload).alias("size"))
    firsts = narrow.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # Written, so that a payload with very many copies is split at run time in the join.
    firsts = stored(firsts.filter("n > 1").select("digest", F.coalesce("first", F.lit(NO_PAGE)).alias("first")))
    placed = packed_pages(pages, id_column, url_column, payload_column).join(firsts, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        opening = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
        files = Files(folder, ".warc.gz", member(opening % (str(uuid.uuid4()).encode(), rule.date.encode()), rule.level), rule.file_bytes)
        for batch in batches:
            rows = []
            for page, url, digest, packed, first in zip(*(column.to_pylist() for column in batch.columns)):
                data = record(page, url, unpacker.decompress(packed), base64.b32encode(digest).decode(), None if first is None or first == page else first, rule)
                data = member(data, rule.level)
                rows.append((url_key(url), page, *files.add(data), len(data)))
            if rows:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows))), ["url_key", "page_id", "file", "offset", "length"])
        files.close()

    return folder, stored(placed.select("page_id", "url", "digest", "packed", "first").mapInArrow(run, CAPTURES))


def line_of(key: str, page: int, file: str, offset: int, length: int) -> str:
    return f"{key} {page} {file} {offset} {length}"


@dataclass(frozen=True)
class Index:
    """folder: of the block files. directory: sorted rows (url_key, page_id, file, offset, length), one for the first capture of each block."""

    folder: str
    directory: list[tuple[str, int, str, int, int]]


def build_index(captures: DataFrame, rule: Archiving = Archiving()) -> Index:
    """Sort captures by URL key and page into compressed blocks, and list the blocks.

    The sort is by ranges of all five columns, so one URL's captures may fill many tasks. The
    directory comes to the driver: at most `directory_rows` blocks and one for each task.
    """
    folder = new_folder(captures.sparkSession, "cdx")
    lines = max(rule.block_lines, -(-captures.count() // rule.directory_rows))
    order = ["url_key", "page_id", "file", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder, ".cdx.gz", b"", rule.file_bytes)
        held: list[tuple] = []

        def closed() -> pa.RecordBatch:
            data = gzip.compress("\n".join(line_of(*row) for row in held).encode(), rule.level, mtime=0)
            row = (held[0][0], held[0][1], *files.add(data), len(data))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], order)

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                held.append(row)
                if len(held) == lines:
                    yield closed()
        if held:
            yield closed()
        files.close()

    blocks = captures.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, CAPTURES)
    return Index(folder, sorted(map(tuple, blocks.collect())))


class Lookup:
    """Searches of one task; the block read last is kept."""

    def __init__(self, index: Index):
        self.store, self.path = store_of(index.folder)
        self.directory = index.directory
        self.firsts = [row[:2] for row in index.directory]
        self.at, self.rows, self.file, self.name = -1, [], None, None

    def block(self, i: int) -> list[tuple]:
        """Captures of a block, by one range read."""
        if i != self.at:
            _, _, name, offset, length = self.directory[i]
            if name != self.name:
                self.file, self.name = self.store.open_input_file(f"{self.path}/{name}"), name
            lines = gzip.decompress(self.file.read_at(length, offset)).decode().split("\n")
            self.rows = [(key, int(page), file, int(at), int(size)) for key, page, file, at, size in (line.split(" ") for line in lines)]
            self.at = i
        return self.rows

    def captures(self, low: tuple, high: tuple) -> Iterator[tuple]:
        """Captures whose (url_key, page_id) is low or more and high or less."""
        i = max(0, bisect_left(self.firsts, low) - 1)
        while i < len(self.firsts) and self.firsts[i] <= high:
            rows = self.block(i)
            start, end = bisect_left(rows, low), bisect_right(rows, high, key=lambda row: row[:2])
            yield from rows[start:end]
            i += 1


def look_up(index: Index, wanted: DataFrame) -> DataFrame:
    """`CAPTURES` of the wanted keys, as a written table: `wanted` has url_key and, if one capture is meant, page_id.

    Keys are sorted first, so a task reads neighbouring blocks and each once. Wanted rows that are repeated count once; null keys find nothing.
    """
    by_page = "page_id" in wanted.columns
    columns = ["url_key", "page_id"] if by_page else ["url_key"]
    shared = wanted.sparkSession.sparkContext.broadcast(index)  # its directory has a bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                low, high = (row, row) if by_page else ((row[0], NO_PAGE), (row[0], (1 << 63) - 1))
                for capture in lookup.captures(low, high):
                    found.append(capture)
                    if len(found) == 10_000:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*found))), ["url_key", "page_id", "file", "offset", "length"])
                        found = []
            if found:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*found))), ["url_key", "page_id", "file", "offset", "length"])

    asked = wanted.select(*columns).dropna().distinct()
    return stored(asked.repartitionByRange(*columns).sortWithinPartitions(*columns).mapInArrow(run, CAPTURES))


def read_records(folder: str, captures: DataFrame, payloads: bool = True, rule: Archiving = Archiving()) -> DataFrame:
    """`RECORDS` of the captures, read by range from the archives, neighbours together; `payloads` false leaves that column null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        name, source = None, None
        names = [part.split()[0] for part in RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                places = list(zip(*(column.to_pylist() for column in whole.slice(first, 500).columns)))
                rows, i = [], 0
                while i < len(places):
                    file, start, length = places[i]
                    if file != name:
                        source, name = store.open_input_file(f"{path}/{file}"), file
                    j, end = i + 1, start + length
                    while j < len(places) and places[j][0] == file and places[j][1] - end <= rule.gap and places[j][1] + places[j][2] - start <= 1 << 24:
                        end = max(end, places[j][1] + places[j][2])
                        j += 1
                    data = memoryview(source.read_at(end - start, start))
                    for _, at, size in places[i:j]:
                        row = parsed(zlib.decompress(data[at - start : at - start + size], 31))
                        rows.append(row if payloads else (*row[:-1], None))
                    i = j
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows), types)], names)

    places = captures.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(run, RECORDS)
