"""WARC archives of pages, with a two-level capture index.

Every page becomes a record, its own gzip member, in archives below the shared folder. Of pages with equal payloads the
one of the largest key is the response, the others revisit it. The index sorts entries by reversed-host URL key and
page; each range of keys is one index file of compressed blocks with a sparse directory of their first keys at its end.
To read a page, a binary search over the files' first keys names the file, one over its directory the block, one in the
block the entry, and only that entry's byte range of the archive is read.

Defined results: a null html is an empty payload; equal payloads of any size, zero included, share one response. Rows that
repeat the largest key are all responses. A null key is below every other; a group of null keys only is all responses. A
null url has the empty key. What a retried task left behind is never read, for the entries name the files of the attempt
that counted.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import settle, shared_folder

ARCHIVE_BYTES, BLOCK_ENTRIES, FILE_ENTRIES = 512 << 20, 1000, 100_000
#: Gzip level of records and blocks.
LEVEL = 3
# Fixed values of the formats.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_KEEP = "".join(chr(c) for c in range(33, 127))


def url_key(url: str | None) -> str:
    """Reversed host, path and query, without scheme, leading www. and fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return quote(url or "", safe=_KEEP)
    if not host:
        return quote((url or "").strip(), safe=_KEEP)
    query = f"?{parts.query}" if parts.query else ""
    return quote(",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + query, safe=_KEEP).lower()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=_KEEP)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers, HTTP headers and payload of one record; a payload that does not fit its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its digest")
    return fields | {"payload": payload, "payload_bytes": size, "payload_digest": digest}


def _page(text: str | None) -> int | None:
    name = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name else None


def _place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        return pyarrow.fs.FileSystem.from_uri(folder)
    return pyarrow.fs.LocalFileSystem(), folder


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the records and return the entries: key, page_id, file, offset, length."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    largest = rows.groupBy("sha").agg(F.max("page_id").alias("largest"))
    typed = rows.join(largest, "sha").select(
        "page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(folder)
        system.create_dir(base, recursive=True)
        name, out, at = "", None, 0
        for batch in batches:
            entries = []
            for page, url, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None or at > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                member = _gzip(record(page, url, payload, refers))
                out.write(member)
                entries.append((url_key(url), page, name, at, len(member)))
                at += len(member)
            columns = list(zip(*entries, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ENTRY.values(), strict=True)], list(_ENTRY))
        if out is not None:
            out.close()

    return settle(typed.mapInArrow(run, "key string, page_id bigint, file string, offset bigint, length bigint"), "captures")


_ENTRY = {"key": pa.string(), "page_id": pa.int64(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64()}
_LOWEST = -(1 << 63)


def write_index(entries: DataFrame, folder: str, file_entries: int = FILE_ENTRIES, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Write the sorted index files and return the top level: first key and page, file, size of the tail."""
    files = max(1, -(-entries.count() // file_entries))
    order = [F.col("key"), F.coalesce("page_id", F.lit(_LOWEST))]
    ranged = entries.repartitionByRange(files, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(folder)
        system.create_dir(base, recursive=True)
        name = f"captures-{uuid.uuid4().hex}.idx"
        directory, held, at, out = [], [], 0, None

        def put() -> None:
            nonlocal at, held, out
            if out is None:
                out = system.open_output_stream(f"{base}/{name}", compression=None)
            block = _gzip("\n".join(json.dumps(e) for e in held).encode())
            out.write(block)
            directory.append((held[0][0], held[0][1], at, len(block)))
            at += len(block)
            held = []

        for batch in batches:
            for entry in zip(*(batch.column(c).to_pylist() for c in _ENTRY), strict=True):
                held.append([entry[0], _LOWEST if entry[1] is None else entry[1], *entry[2:]])
                if len(held) == block_entries:
                    put()
        if held:
            put()
        if out is not None:
            tail = _gzip(json.dumps(directory).encode())
            out.write(tail)
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([name]), pa.array([at], pa.int64()), pa.array([len(tail)], pa.int64())],
                ["key", "page", "file", "tail_at", "tail_size"])

    return settle(ranged.mapInArrow(run, "key string, page bigint, file string, tail_at bigint, tail_size bigint"), "index")


class Lookup:
    """Reads captures by key and page through one index file; open archives are kept while they are used in turn."""

    def __init__(self, folder: str, file: str, tail_at: int, tail_size: int):
        self.system, self.base = _place(folder)
        self.index = self.system.open_input_file(f"{self.base}/{file}")
        self.directory = [tuple(e) for e in json.loads(zlib.decompress(self.index.read_at(tail_size, tail_at), 31))]
        self.block, self.entries = -1, []
        self.archives: dict[str, pa.NativeFile] = {}

    def entries_of(self, key: str, page: int) -> list[list]:
        """All entries of the key and page; repeated rows may run over several blocks."""
        at = max(bisect.bisect_left(self.directory, (key, page), key=lambda e: e[:2]) - 1, 0)
        out = []
        while at < len(self.directory) and (at == 0 or self.directory[at][:2] <= (key, page)):
            if at != self.block:
                _, _, offset, size = self.directory[at]
                self.block, self.entries = at, [json.loads(x) for x in zlib.decompress(self.index.read_at(size, offset), 31).split(b"\n")]
            k = bisect.bisect_left(self.entries, (key, page), key=lambda e: (e[0], e[1]))
            while k < len(self.entries) and (self.entries[k][0], self.entries[k][1]) == (key, page):
                out.append(self.entries[k])
                k += 1
            at += 1
        return out

    def read(self, entry: list) -> dict:
        _, _, file, offset, length = entry
        if file not in self.archives:
            if len(self.archives) >= 64:
                self.archives.pop(next(iter(self.archives))).close()
            self.archives[file] = self.system.open_input_file(f"{self.base}/{file}")
        return parse(zlib.decompress(self.archives[file].read_at(length, offset), 31))


def read_back(wanted: DataFrame, top: DataFrame, folder: str) -> DataFrame:
    """wanted: page_id, url. A row per capture found: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The top level has a row for each index file, FILE_ENTRIES captures each; it is the only thing the driver sees.
    """
    files = sorted((r["key"], r["page"], r["file"], r["tail_at"], r["tail_size"]) for r in top.collect())
    firsts = [f[:2] for f in files]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [url_key(u) for u in batch.column("url").to_pylist()]
            pages = [_LOWEST if p is None else p for p in batch.column("page_id").to_pylist()]
            at = [max(bisect.bisect_right(firsts, (k, p)) - 1, 0) for k, p in zip(keys, pages, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(keys, pa.string()), pa.array(pages, pa.int64())], ["at", "key", "page"])

    searched = wanted.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(find, "at int, key string, page bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, now, last = None, -1, None
        for batch in batches:
            out = []
            for at, key, page in zip(*(batch.column(c).to_pylist() for c in ("at", "key", "page")), strict=True):
                if at != now:
                    now, lookup = at, Lookup(folder, *files[at][2:])
                if (at, key, page) == last:
                    continue  # a repeated row: its captures were all read with the first
                last = (at, key, page)
                for entry in lookup.entries_of(key, page):
                    got = lookup.read(entry)
                    out.append((_page(got["WARC-Record-ID"]), got["payload_bytes"], got["payload_digest"], got["WARC-Type"], _page(got.get("WARC-Refers-To"))))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                                             ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ordered = searched.repartition(max(len(files), 1), "at").sortWithinPartitions("at", "key", "page")
    return ordered.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame, folder: str | None = None, file_entries: int = FILE_ENTRIES) -> DataFrame:
    """Write archives and index, then read every page back through them."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    top = write_index(write_archives(pages, folder), folder, file_entries)
    return read_back(pages.select("page_id", "url"), top, folder)
