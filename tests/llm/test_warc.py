"""WARC archives: round trip, and errors on damaged files."""

import gzip
import hashlib

import pytest

from pagetrail.llm import warc
from pagetrail.llm.shared import scratch


def want(rows):
    out, first = [], {}
    for page_id, _, html in rows:
        b = (html or "").encode()
        if len(b) >= warc.SMALLEST and page_id is not None:
            first[b] = min(first.get(b, page_id), page_id)
    for page_id, _, html in rows:
        b = (html or "").encode()
        low = first.get(b)
        again = low is not None and page_id != low
        out.append((page_id, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", low if again else None))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a/", "x" * 100), (3, None, "x" * 100), (9, "http://a/\r\nEvil: 1", "x" * 100), (4, "u", "é" * 49), (6, "u", "é" * 49), (7, "u", "é" * 50),
    (8, "u", "é" * 50), (1, "u", None), (2, "u", ""), (None, "u", "x" * 100), (None, "u", "only null ids " * 20), (3, "u", "x" * 100),
    (10, "u", "\r\n\r\nWARC/1.1\r\n\x1f\x8b" * 20), (11, "u", "long " * 400_000),
]


@pytest.mark.parametrize("size", [64 << 20, 300])
def test_round_trip(spark, size):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "1 as first").repartition(3)
    manifest = warc.write_archives(df, scratch(spark, "warc-test"), archive_bytes=size)
    got = warc.read_archives(manifest, payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(ROWS)
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert manifest.agg({"records": "sum"}).first()[0] == len(ROWS)
    assert warc.round_trip(df.limit(0)).count() == 0


def chunked(data, n):
    return [data[i : i + n] for i in range(0, len(data), n)]


def test_reader_verifies_and_streams():
    pages = [(i, f"http://h/{i}", bytes([i]) * (i * 37)) for i in range(30)]
    parts = [warc.page_member(i, u, b, hashlib.sha256(b).hexdigest(), None, False) for i, u, b in pages]
    whole = b"".join(parts)
    assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == 30
    for n in (1, 7, 1000, 1 << 20):
        assert [r.payload for r in warc.read_records(chunked(whole, n))] == [b for _, _, b in pages]
    with pytest.raises(warc.BadRecord):
        list(warc.read_records([whole[:-5]]))
    text = gzip.decompress(parts[9])
    for old, new in ((b"\x09\x09", b"\x09\x08"), (b"Content-Length: 4", b"Content-Length: 3"), (b"WARC/1.1", b"WORC/1.1")):
        with pytest.raises(warc.BadRecord):
            list(warc.read_records([gzip.compress(text.replace(old, new, 1))]))
    wrong = warc.page_member(1, None, b"body", hashlib.sha256(b"other").hexdigest(), None, False)
    with pytest.raises(warc.BadRecord, match="payload digest"):
        list(warc.read_records([wrong]))


def test_archives_are_named_by_attempt_and_counted(spark):
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string").coalesce(2)
    folder = scratch(spark, "warc-test")
    one, two = warc.write_archives(df, folder, archive_bytes=600), warc.write_archives(df, folder)  # as if a second attempt packed otherwise
    assert not {r.path for r in one.collect()} & {r.path for r in two.collect()}
    assert warc.read_archives(one).count() == warc.read_archives(two).count() == 20
    with pytest.raises(Exception, match="its manifest says"):
        warc.read_archives(two.selectExpr("path", "records + 1 as records")).count()
