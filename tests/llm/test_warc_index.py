"""Archives, their two-level index and reads by range."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from lexspan.llm import warc_index as A

SCHEMA = "page_id long, url string, html string, uid string, digest string, kind string"


def pages_of(spark, rows):
    """Pages, with further columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows):
    largest, seen = {}, {}
    for i, _, html in rows:
        best = largest.get(html or "")
        largest[html or ""] = i if best is None else best if i is None else max(best, i)
    out = []
    for i, _, html in rows:
        text = html or ""
        one = i == largest[text] and not seen.get(text)
        seen[text] = seen.get(text) or one
        out.append((i, len(text.encode()), digest(text), "response" if one else "revisit", None if one else largest[text]))
    return sorted(out, key=repr)


ODD_PAGES = [
    (1, "http://www.Example.com/a?b=c#d", "<p>é日</p>"), (2, "http://example.com", "<p>é日</p>"), (3, None, None), (4, "", ""), (5, "no url at all", "x"),
    (None, "http://example.com/", "x"), (6, "http://u:p@b.example.com:8080/p q", "y\r\n\r\nWARC/1.1\r\n"), (6, "http://u:p@b.example.com:8080/p q", "y\r\n\r\nWARC/1.1\r\n"),
    (7, "http://例え.jp/ü", "z" * 300_000), (8, "ftp://a/b\n c", "y"), (None, None, "only"), (9, "http://example.com/", "x"),
]


def through(spark, rows, lines=A.LINES, **how):
    pages = pages_of(spark, rows)
    folder, captures = A.write_archives(pages, **how)
    index = A.write_index(folder, captures, lines)
    return pages, captures, index, A.lookup(index, pages.select(A.reversed_host_key(F.col("url")).alias("key")))


def found(index, captures):
    rows = A.fetch(index, captures).collect()
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr), rows


@pytest.mark.parametrize("lines, file_bytes", [(A.LINES, A.FILE_BYTES), (2, 1)])
def test_what_is_written_comes_back(spark, lines, file_bytes):
    _, captures, index, hits = through(spark, ODD_PAGES, lines, file_bytes=file_bytes)
    assert captures.count() == len(ODD_PAGES)
    got, rows = found(index, hits)
    assert got == plain(ODD_PAGES)
    texts = {i: (h or "").encode() for i, _, h in ODD_PAGES if i}
    assert all(bytes(r.payload) == texts[r.page_id] for r in rows if r.record_type == "response" and r.page_id)
    assert {r.url for r in rows} == {u or "" for _, u, _ in ODD_PAGES}


def test_archives_read_from_front_to_back(spark):
    """Every file is a sequence of gzip members, each one record."""
    _, captures, index, _ = through(spark, ODD_PAGES)
    system, base = A.opened(index.folder)
    ids = []
    for name in {r.file for r in captures.collect()}:
        places = sorted((r.offset, r.length) for r in captures.collect() if r.file == name)
        with system.open_input_file(f"{base}/{name}") as f:
            data = f.read()
        assert [o for o, _ in places] == [0, *[o + n for o, n in places][:-1]] and sum(n for _, n in places) == len(data)
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        ids += [A.parse_record(data[o : o + n]).headers["WARC-Record-ID"] for o, n in places]
    assert len(set(ids)) == len(ODD_PAGES)


def test_a_lookup_reads_one_directory_and_the_blocks_of_its_key(spark):
    rows = [(i, f"http://h{i % 50}.example.com/{i}", f"page {i}") for i in range(3000)]
    rows += [(10_000 + i, "http://hot.example.com/same", "same") for i in range(1500)]
    _, captures, index, hits = through(spark, rows, lines=50)
    got, _ = found(index, hits)
    assert got == plain(rows)
    key = "com,example,h7)/1007"
    (n,) = A.holding(index, key.encode())
    reader = A.IndexReader(index.folder, index.files[n])
    assert [c["page_id"] for c in reader.captures(key.encode())] == [1007] and reader.reads <= 3
    assert [r.payload for r in A.find(index, key)] == [b"page 1007"]
    assert A.find(index, "com,example,h7)/none") == [] and A.find(index, "zz") == [] and A.find(index, "") == []
    hot = A.find(index, "com,example,hot)/same")
    assert len(hot) == 1500 and sum(r.headers["WARC-Type"] == "response" for r in hot) == 1


def test_small_payloads_can_all_be_responses(spark):
    rows = [(i, "http://a.b/", "xx" if i < 5 else "longer") for i in range(8)]
    _, _, index, hits = through(spark, rows, least=3)
    kinds = {(r.page_id, r.record_type) for r in A.fetch(index, hits, payload=False).collect()}
    assert kinds == {*((i, "response") for i in range(5)), (5, "revisit"), (6, "revisit"), (7, "response")}


def test_a_damaged_payload_is_refused():
    good = A.build_record("<urn:page:1>", "http://a/", b"text", digest("text"), None)
    assert A.parse_record(gzip.compress(good)).payload == b"text"
    with pytest.raises(ValueError, match="differs"):
        A.parse_record(gzip.compress(good.replace(b"\r\n\r\ntext", b"\r\n\r\ntesT")))


def test_keys(spark):
    urls = {"HTTP://WWW.Example.COM:80/A?b#c": "com,example,www:80)/A?b", "https://example.com": "com,example)/", "a b": "a%20b", "": "", None: ""}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.k for r in df.select(A.reversed_host_key(F.col("url")).alias("k")).collect()] == list(urls.values())


def test_no_pages(spark):
    _, captures, index, hits = through(spark, [])
    assert captures.count() == 0 and index.files == () and hits.collect() == [] and A.fetch(index, hits).collect() == []
