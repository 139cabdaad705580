"""WARC archives with a two-level capture index."""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwright.llm.common import prepare, table
from wardwright.session import scratch_path, settle

BLOCK_ENTRIES = 256
REVISIT_BYTES = 1000  # payloads from this size on are stored once
_NO_PAGE = -(1 << 63) - 1
_DATE, _EXACT = "2024-01-01T00:00:00Z", "X-Exact-Target-URI"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _files(path: str):
    """The file system of a folder and the folder in it; any that Spark's shared folder may lie on."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        path = re.sub("^s3[an]://", "s3://", path)  # Hadoop's names for one store
        return fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    return fs.LocalFileSystem(), path


def sort_key(url: str | None) -> str:
    """Host labels in reverse, then port, path and query: captures of a domain lie together."""
    if not url or "://" not in url:
        return url or ""
    rest = url.split("://", 1)[1].split("#", 1)[0]
    cut = min((rest.find(c) for c in "/?" if c in rest), default=len(rest))
    host, colon, port = rest[:cut].rpartition("@")[2].lower().partition(":")
    return ",".join(reversed(host.split("."))) + colon + port + ")" + rest[cut:]


def _header(name: str, value) -> bytes:
    return f"{name}: {value}\r\n".encode()


def _target(url: str) -> bytes:
    """The header of the captured address, as it is. One that would end the line is written with its line ends escaped, as in any
    address, and once more in a field of our own that restores it."""
    plain = _header("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))
    return plain + _header(_EXACT, json.dumps(url)) if "\r" in url or "\n" in url else plain


def _warcinfo() -> bytes:
    """The record that an archive file begins with."""
    block = b"software: wardwright\r\nformat: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    head = b"WARC/1.1\r\n" + _header("WARC-Type", "warcinfo") + _header("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>") + _header("WARC-Date", _DATE)
    head += b"Content-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % len(block)
    return gzip.compress(head + block + b"\r\n\r\n", 5, mtime=0)


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A WARC record, compressed as a gzip member of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = b"WARC/1.1\r\n" + _header("WARC-Type", kind) + _header("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>")
    if url is not None:
        head += _target(url)
    head += _header("WARC-Date", _DATE) + _header("WARC-Payload-Digest", f"sha1:{digest}")
    if refers_to is not None:
        head += _header("WARC-Profile", _PROFILE) + _header("WARC-Refers-To", f"<urn:page:{refers_to}>")
    head += b"Content-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block)
    return gzip.compress(head + block + b"\r\n\r\n", 5, mtime=0)


def parse_record(member: bytes) -> dict:
    """Fields and payload of a record; the digest of a stored payload is checked."""
    data = gzip.decompress(member)
    head, block = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    refers = fields.get("WARC-Refers-To")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = payload[:size] if refers is None else None
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of record {page} does not fit its digest")
    url = json.loads(fields[_EXACT]) if _EXACT in fields else fields.get("WARC-Target-URI")
    return {"page_id": int(page) if page else None, "url": url, "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": None if refers is None else int(refers[len("<urn:page:") : -1]), "payload": payload}


@dataclass
class Archive:
    """Written archives: `captures` has a row per record; `root` lists each index file with its first key and where its
    block directory lies, one entry per file."""

    folder: str
    captures: DataFrame
    root: list[tuple[str, int, str, int, int]]


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> Archive:
    """Write a record per row, and the index over all of them, below the shared folder.

    Each file begins with a warcinfo record. Of the records whose payloads are equal and have `REVISIT_BYTES` or more, the one with the largest id is stored and
    the others refer to it; rows that repeat its id are stored too, and so are all rows of a payload that only comes with
    null ids. A null payload counts as empty. A null URL has the empty key. Each task writes files under names of its
    own, and only the files of finished tasks are listed, so a lost executor leaves nothing half read.
    """
    spark = prepare(pages.sparkSession)
    folder = scratch_path(spark, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    shared = settle(rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("stored"), F.count("*").alias("n"))
                    .where("n > 1 AND stored IS NOT NULL").select("digest", "stored"), "shared-payloads")
    refers = F.when((F.octet_length("payload") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("stored")), F.col("stored"))
    # The broadcast or the shuffle of this join is Spark's choice by the size of the settled table.
    dealt = rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _files(folder)
        out, at, name = None, 0, f"{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in batches:
                lines = []
                for page, target, data, digest, refers_to in batch.astype(object).itertuples(index=False):
                    page, refers_to = (None if pd.isna(v) else int(v) for v in (page, refers_to))
                    if out is None:
                        system.create_dir(base, recursive=True)
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                        out.write(first := _warcinfo())
                        at = len(first)
                    member = _record(page, None if pd.isna(target) else target, bytes(data), digest, refers_to)
                    out.write(member)
                    lines.append((sort_key(None if pd.isna(target) else target), page, name, at, len(member)))
                    at += len(member)
                if lines:
                    yield pd.DataFrame(lines, columns=["key", "page_id", "file", "offset", "length"]).astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    captures = settle(dealt.mapInPandas(write, "key string, page_id long, file string, offset long, length long"), "captures")
    return Archive(folder, captures, _write_index(captures, folder))


def _write_index(captures: DataFrame, folder: str) -> list[tuple[str, int, str, int, int]]:
    """Sort the captures by key into compressed blocks, one file per range; each file ends with its block directory."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _files(folder)
        name, out, at, held, directory = f"{uuid.uuid4().hex}.index", None, 0, [], []

        def flush() -> None:
            nonlocal out, at, held
            if out is None:
                out = system.open_output_stream(f"{base}/{name}", compression=None)
            data = zlib.compress("\n".join(json.dumps(line) for line in held).encode("utf-8"), 5)
            directory.append([held[0][0], held[0][1], at, len(data)])
            out.write(data)
            at, held = at + len(data), []

        for batch in batches:
            for key, page, file, offset, length in batch.astype(object).itertuples(index=False):
                held.append([key, _NO_PAGE if pd.isna(page) else int(page), file, int(offset), int(length)])
                if len(held) == BLOCK_ENTRIES:
                    flush()
        if held:
            flush()
        if out is not None:
            data = zlib.compress(json.dumps(directory).encode("utf-8"), 5)
            out.write(data)
            out.close()
            yield pd.DataFrame([(directory[0][0], str(directory[0][1]), name, at, len(data))], columns=["key", "page", "file", "offset", "length"])

    sorted_rows = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    files = settle(sorted_rows.mapInPandas(write, "key string, page string, file string, offset long, length long"), "index-files")
    return sorted(((r["key"], int(r["page"]), r["file"], r["offset"], r["length"]) for r in files.collect()), key=_rank)


def _rank(entry) -> tuple[bytes, int]:
    """Where an entry stands: Spark sorts strings by their UTF-8 bytes and nulls first."""
    return entry[0].encode("utf-8"), entry[1]


class IndexReader:
    """Finds captures: the root names the index files, the directory of a file its blocks, a block the ranges."""

    def __init__(self, folder: str, root: list):
        self.system, self.base = _files(folder)
        self.root, self.firsts = root, [_rank(r) for r in root]
        self.streams: dict[str, object] = {}
        self.directory: tuple = (None, None, None)
        self.block: tuple = (None, None)

    def _range(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.streams:
            if len(self.streams) >= 64:
                self.streams.pop(next(iter(self.streams))).close()
            self.streams[file] = self.system.open_input_file(f"{self.base}/{file}")
        return self.streams[file].read_at(length, offset)

    def find(self, key: str, page: int) -> Iterator[dict]:
        """The records of a capture key and page, in index order."""
        target = (key.encode("utf-8"), page)
        for n in range(max(0, bisect_left(self.firsts, target) - 1), len(self.root)):
            if self.firsts[n] > target:
                return
            _, _, file, offset, length = self.root[n]
            if self.directory[0] != file:
                blocks = json.loads(zlib.decompress(self._range(file, offset, length)))
                self.directory = (file, blocks, [_rank(b) for b in blocks])
            _, blocks, firsts = self.directory
            for b in range(max(0, bisect_left(firsts, target) - 1), len(blocks)):
                if firsts[b] > target:
                    break
                if self.block[0] != (file, b):
                    lines = [json.loads(x) for x in zlib.decompress(self._range(file, *blocks[b][2:])).split(b"\n")]
                    self.block = ((file, b), (lines, [_rank(x) for x in lines]))
                lines, ranks = self.block[1]
                for k in range(bisect_left(ranks, target), len(lines)):
                    if ranks[k] != target:
                        break
                    yield parse_record(self._range(lines[k][2], lines[k][3], lines[k][4]))


RECORD_TYPE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_captures(archive: Archive, wanted: DataFrame, url: str = "url", page_id: str = "page_id", payload: bool = True,
                  records_per_task: int = 5000) -> DataFrame:
    """The records of the wanted (url, page_id) rows, each once, read through the index by range.

    The wanted keys are sorted like the index, so a task walks over neighbouring blocks. Keys without a capture give
    no row; a capture written twice gives two.
    """

    @F.pandas_udf("string")
    def keyed(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: sort_key(None if pd.isna(u) else u))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = IndexReader(archive_folder, root)
        names = [c.split()[0] for c in RECORD_TYPE.split(", ")] + ["payload"] * payload
        for batch in batches:
            found = [r for key, page in batch.astype(object).itertuples(index=False) for r in reader.find(key, _NO_PAGE if pd.isna(page) else int(page))]
            for at in range(0, len(found), 200):
                yield pd.DataFrame(found[at : at + 200], columns=[*names]).astype({"page_id": "Int64", "refers_to": "Int64"})

    archive_folder, root = archive.folder, archive.root
    keys = wanted.select(keyed(F.col(url)).alias("key"), F.col(page_id).cast("long").alias("page_id")).distinct()
    # A key is small but the record behind it is not, so tasks are dealt by the number of records, not by bytes.
    tasks = 1 + archive.captures.count() // records_per_task
    return keys.repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id").mapInPandas(
        read, RECORD_TYPE + (", payload binary" if payload else ""))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return read_captures(write_archives(pages), pages, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS stored FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> stored THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> stored THEN stored END AS refers_to
FROM g
"""
