"""Web archives with a two-level capture index.

Pages are written as WARC records, one gzip member each, so a record can be read by its byte
range. Of records with equal payloads the one with the largest page_id holds the payload
(`response`), the others refer to it (`revisit`) and keep only the HTTP header.

The index has a line per capture, sorted by the URL with its host reversed (`com,example)/a`),
in gzip blocks of LINES lines. Each index file ends with its sparse directory: the first key and
the byte range of every block. A lookup finds the file by its key bounds, searches the directory
by bisection, reads the range of one block, searches its lines by bisection, and then reads the
ranges of the records. Bulk lookups deal the keys out by index file, and the records they find by
stretches of archive files, so every block and every stretch is read once, in order.

Payloads meet by digest only as narrow rows, one per page and payload. Digests that hold more than
a thousandth of all pages are at most a thousand, so they are broadcast; the others are joined by
shuffle. Texts are joined with their verdict by page and payload, and are shuffled once. Files get
a name of their own per task attempt and count only if the task's rows are committed, so a lost
executor leaves no damage. They are written and read through Arrow's file systems, in the shared
checkpoint folder.

Defined cases: a null html is the empty payload; a null url is empty, as is its key; a null
page_id is smaller than all others; of repeated rows with the largest page_id one is the
response; captures of one key are all found; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexspan.llm.common import landed, query, table
from lexspan.session import ensure_checkpoint_dir

LINES = 1000
FILE_LINES = 2_000_000
FILE_BYTES = 1 << 30
READ_BYTES = 8 << 20
TASK_BYTES = 512 << 20
LEAST_REVISIT = 0
HOT_SHARE = 1000
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^#]*)"


def reversed_host_key(url: Column) -> Column:
    """`http://www.example.com:80/a?b#c` as `com,example,www:80)/a?b`; what is no URL stays as it is."""
    url = F.coalesce(url, F.lit(""))
    host, port, rest = (F.regexp_extract(url, _URL, i) for i in (1, 2, 3))
    key = F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), port, F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    # A line of the index ends its key with a blank.
    return F.regexp_replace(F.when(url.rlike(_URL), key).otherwise(url), r"[\x00-\x20\x7F]", "%20")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared file."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


# Writing -----------------------------------------------------------------------------------------


# A page, its id as text so that null is a value, and its payload: the SHA-1, and a second hash beside it.
_PAGE = ["page", "digest", "check"]


def verdicts(held: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """The page_id that holds the payload of each distinct row page, digest, check, page_id, bytes, n.

    Null where the payload stands alone or is shorter than `least`.
    """
    same = held.filter(F.col("bytes") >= least).groupBy("digest", "check").agg(
        F.sum("n").alias("of"), F.count("*").alias("rows"), F.max("page_id").alias("holder"))
    groups = landed(same.filter("of > 1"), "payload-groups")
    bound = held.count() / HOT_SHARE
    few, many = (groups.filter(c).select("digest", "check", F.struct("holder").alias("group")) for c in (F.col("rows") > bound, F.col("rows") <= bound))
    # Fewer than HOT_SHARE groups can each hold more than this part of all rows.
    hot = held.join(F.broadcast(few), ["digest", "check"], "left")
    rest = hot.filter(F.col("group").isNull()).drop("group").join(many, ["digest", "check"], "left")
    return hot.filter(F.col("group").isNotNull()).unionByName(rest).select(*_PAGE, "group")


def record_id(page_id: int | None, check: int, copy: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{check & 0xFFFFFFFFFFFFFFFF:016x}:{copy}>"


def page_of(record: str | None) -> int | None:
    """The page_id in a record id."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]*):[0-9a-f]{16}:[0-9]+>", record or "")
    return int(found[1]) if found and found[1] else None


def build_record(name: str, url: str, payload: bytes, digest: str, refers: str | None) -> bytes:
    """A WARC record; one that refers to another keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    target = re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if target else []), f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {refers}", f"WARC-Profile: {_PROFILE}"] if refers else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


_CAPTURE = pa.schema([
    ("key", pa.string()), ("page_id", pa.int64()), ("record", pa.string()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()),
    ("length", pa.int64()), ("kind", pa.string()), ("digest", pa.string())])
_CAPTURE_DDL = "key string, page_id long, record string, url string, file string, offset long, length long, kind string, digest string"


def _writer(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for key, page_id, check, copy, url, html, group in zip(*(batch[c].to_pylist() for c in ("key", "page_id", "check", "copy", "url", "html", "group"))):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                payload = html.encode("utf-8", "surrogatepass")
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                # The first copy of the page that holds the payload is the response.
                own = group is None or (group["holder"] == page_id and copy == 1)
                to = None if own else record_id(group["holder"], check, 1)
                record = record_id(page_id, check, copy)
                member = gzip.compress(build_record(record, url, payload, digest, to), mtime=0)
                out.write(member)
                rows.append((key, page_id, record, url, name, at, len(member), "revisit" if to else "response", digest))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CAPTURE)] if rows else [pa.array([], f.type) for f in _CAPTURE], schema=_CAPTURE)
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Folder of the archives and one row per capture, from rows page_id, url, html."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("check", F.xxhash64("html"))
    rows = rows.withColumn("page", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    held = rows.groupBy(*_PAGE).agg(F.max("page_id").alias("page_id"), F.max(F.octet_length("html")).alias("bytes"), F.count("*").alias("n"))
    told = verdicts(landed(held, "payloads"), least)
    copy = F.row_number().over(W.partitionBy(*_PAGE).orderBy("url"))
    # The join has dealt the pages out as the numbering of their copies needs them.
    placed = rows.join(told, _PAGE).withColumn("copy", copy)
    folder = f"{ensure_checkpoint_dir(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    system, base = opened(folder)
    system.create_dir(base)
    records = placed.select(reversed_host_key(F.col("url")).alias("key"), "page_id", "check", "copy", "url", "html", "group")
    return folder, landed(records.mapInArrow(_writer(folder, file_bytes), _CAPTURE_DDL), "captures")


# Index -------------------------------------------------------------------------------------------


def _tasks(spark: SparkSession, work: int, most: int) -> int:
    """Tasks for an amount of work that rows' own bytes do not show: at least one per core."""
    return max(spark.sparkContext.defaultParallelism, -(-work // most))


@dataclass(frozen=True)
class IndexFile:
    """Bounds of one index file and the byte range of its directory."""

    first: bytes
    last: bytes
    file: str
    offset: int
    length: int


@dataclass(frozen=True)
class Index:
    folder: str
    files: tuple[IndexFile, ...]  # in key order, one per task that wrote the index


def _index_writer(folder: str, lines: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        name = f"index-{uuid.uuid4().hex}.gz"
        out, at, held, blocks, last = None, 0, [], [], ""

        def flush() -> None:
            nonlocal out, at, held
            out = out or system.open_output_stream(f"{base}/{name}", compression=None)
            data = gzip.compress("\n".join(f"{k} {rest}" for k, rest in held).encode("utf-8", "surrogatepass"), mtime=0)
            out.write(data)
            blocks.append((held[0][0], at, len(data)))
            at, held = at + len(data), []

        for batch in batches:
            for row in batch.to_pylist():
                last = row.pop("key")
                held.append((last, json.dumps(row)))
                if len(held) == lines:
                    flush()
            yield pa.RecordBatch.from_pylist([], _FILE)
        if held:
            flush()
        if out is not None:
            data = gzip.compress("\n".join(f"{k} {o} {n}" for k, o, n in blocks).encode("utf-8", "surrogatepass"), mtime=0)
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_pylist([{"first": blocks[0][0], "last": last, "file": name, "offset": at, "length": len(data)}], _FILE)

    return write


_FILE = pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write_index(folder: str, captures: DataFrame, lines: int = LINES) -> Index:
    """Sorted, compressed blocks of captures with a directory per file, written beside the archives."""
    order = ["key", "page_id", "record"]
    placed = captures.repartitionByRange(_tasks(captures.sparkSession, captures.count(), FILE_LINES), *order).sortWithinPartitions(*order)
    files = landed(placed.mapInArrow(_index_writer(folder, lines), "first string, last string, file string, offset long, length long"), "index-files")
    # One row per partition of the sort.
    found = [IndexFile(r.first.encode(), r.last.encode(), r.file, r.offset, r.length) for r in files.collect()]
    return Index(folder, tuple(sorted(found, key=lambda f: (f.first, f.last))))


class IndexReader:
    """Reads captures of keys from one index file by bisection and range reads."""

    def __init__(self, folder: str, file: IndexFile):
        system, base = opened(folder)
        self.handle, self.reads = system.open_input_file(f"{base}/{file.file}"), 0
        self.directory = [(k, int(o), int(n)) for k, o, n in (line.rsplit(b" ", 2) for line in self._lines(file.offset, file.length))]
        self.firsts = [k for k, _, _ in self.directory]
        self.block, self.held = -1, []

    def _lines(self, offset: int, length: int) -> list[bytes]:
        self.reads += 1
        return gzip.decompress(self.handle.read_at(length, offset)).split(b"\n")

    def captures(self, key: bytes) -> Iterator[dict]:
        # Captures of a key can begin in the block before the first one that starts with it.
        i = max(0, bisect_left(self.firsts, key) - 1)
        while i < len(self.firsts) and self.firsts[i] <= key:
            if self.block != i:
                self.block, self.held = i, self._lines(*self.directory[i][1:])
            at = bisect_left(self.held, key, key=lambda line: line[: line.index(b" ")])
            while at < len(self.held) and self.held[at].startswith(key + b" "):
                yield {"key": key.decode(), **json.loads(self.held[at][len(key) + 1 :])}
                at += 1
            i += 1


def holding(index: Index, key: bytes) -> list[int]:
    """Numbers of the index files whose bounds include a key, by bisection."""
    i = bisect_left(index.files, key, key=lambda f: f.last)
    out = []
    while i < len(index.files) and index.files[i].first <= key:
        out.append(i)
        i += 1
    return out


def _locator(index: Index):
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(n, k) for k in batch["key"].to_pylist() for n in holding(index, k.encode())]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in pairs], pa.int32()), pa.array([k for _, k in pairs], pa.string())], names=["part", "key"])

    return locate


def _searcher(index: Index):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, reader, rows = None, None, []
        for batch in batches:
            for n, key in zip(batch["part"].to_pylist(), batch["key"].to_pylist()):
                if n != part:
                    part, reader = n, IndexReader(index.folder, index.files[n])
                for row in reader.captures(key.encode()):
                    rows.append(row)
                    if len(rows) == LINES:
                        yield pa.RecordBatch.from_pylist(rows, _CAPTURE)
                        rows = []
        yield pa.RecordBatch.from_pylist(rows, _CAPTURE)

    return search


def lookup(index: Index, keys: DataFrame) -> DataFrame:
    """All captures of the keys in column `key`."""
    asked = keys.select("key").distinct().mapInArrow(_locator(index), "part int, key string")
    dealt = asked.repartition(max(1, len(index.files)), "part").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(_searcher(index), _CAPTURE_DDL)


# Reading -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _headers(raw: bytes) -> dict[str, str]:
    return {k.decode(): v.decode("utf-8", "surrogatepass") for k, v in (line.split(b": ", 1) for line in raw.split(b"\r\n")[1:])}


def parse_record(member: bytes) -> Record:
    """The record in a gzip member; a payload that differs from its digest is refused."""
    raw = gzip.decompress(member)
    head, rest = raw.split(b"\r\n\r\n", 1)
    headers = _headers(head)
    block = rest[: int(headers["Content-Length"])]
    if not raw.startswith(b"WARC/1.1\r\n") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a record")
    http, payload = block.split(b"\r\n\r\n", 1)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != f"sha1:{digest}":
        raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
    return Record(headers, _headers(http), payload)


def _stretches(places: list[tuple[str, int, int]], limit: int = READ_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of places (file, offset, length) that follow each other closely: one read each."""
    i = 0
    while i < len(places):
        j = i + 1
        while j < len(places) and places[j][0] == places[i][0] and places[j][1] <= places[j - 1][1] + places[j - 1][2] + (1 << 16) \
                and places[j][1] + places[j][2] - places[i][1] <= limit:
            j += 1
        yield i, j
        i = j


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _reader(folder: str, payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        name, handle = None, None
        for batch in batches:
            places = list(zip(*(batch[c].to_pylist() for c in ("file", "offset", "length"))))
            urls = batch["url"].to_pylist()
            for i, j in _stretches(places):
                file, start, _ = places[i]
                if file != name:
                    name, handle = file, system.open_input_file(f"{base}/{file}")
                data = handle.read_at(places[j - 1][1] + places[j - 1][2] - start, start)
                rows = []
                for (_, offset, length), url in zip(places[i:j], urls[i:j]):
                    record = parse_record(data[offset - start : offset - start + length])
                    h = record.headers
                    rows.append({
                        "page_id": page_of(h["WARC-Record-ID"]), "url": url, "record_type": h["WARC-Type"], "refers_to": page_of(h.get("WARC-Refers-To")),
                        "payload_bytes": len(record.payload) if h["WARC-Type"] == "response" else int(record.http["Content-Length"]),
                        "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": record.payload if payload else None})
                yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return read


def fetch(index: Index, captures: DataFrame, payload: bool = True) -> DataFrame:
    """Records of captures, read by byte range; a revisit has the length and digest of the full payload."""
    stretch = F.floor(F.col("offset") / (8 * READ_BYTES))
    found = landed(captures.select("file", "offset", "length", "url"), "found")
    tasks = _tasks(found.sparkSession, found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0], TASK_BYTES)
    placed = found.repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset")
    return placed.mapInArrow(_reader(index.folder, payload), "page_id long, url string, record_type string, refers_to long, "
                             "payload_bytes long, payload_digest string, payload binary")


def find(index: Index, url_key: str) -> list[Record]:
    """Records of one key, read by this process."""
    system, base = opened(index.folder)
    out = []
    for n in holding(index, url_key.encode()):
        for c in IndexReader(index.folder, index.files[n]).captures(url_key.encode()):
            out.append(parse_record(system.open_input_file(f"{base}/{c['file']}").read_at(c["length"], c["offset"])))
    return out


_SQL = r"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) || '00' AS hex FROM pages),
-- Base32: five bits at a time, cut out of two bytes.
coded AS (
  SELECT rid, page_id, payload, strlen(payload)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
      1 + ((('0x' || substr(hex, 1 + (i * 5 // 8) * 2, 4))::INT >> (11 - (i * 5) % 8)::INT) & 31)]), '') AS payload_digest
  FROM sized),
placed AS (
  SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS largest FROM coded
  WINDOW w AS (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, rid DESC))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN largest END AS refers_to
FROM placed
"""


@query("op11_warc_index", _SQL)
def op11_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, archived, indexed, looked up by its key and read back."""
    pages = table(spark, sf_dir, "pages")
    folder, captures = write_archives(pages)
    index = write_index(folder, captures)
    found = lookup(index, pages.select(reversed_host_key(F.col("url")).alias("key")))
    return fetch(index, found, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
