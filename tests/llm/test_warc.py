"""Archives byte for byte, and damage to them."""

from __future__ import annotations

import hashlib

import pytest

from ledgerline.llm import warc
from ledgerline.sources.scratch import Scratch

BIG, OTHER = "<p>é</p>" * 200, "x" * 1000
PAGES = [
    (1, "http://a.org/\r\nX: y", BIG, 9, b"z"),
    (7, "http://b.org/", BIG, 9, b"z"),
    (3, None, BIG, 9, b"z"),
    (4, "http://c.org/", "short", 9, b"z"),
    (5, "http://d.org/", "short", 9, b"z"),
    (6, "http://e.org/", None, 9, b"z"),
    (8, "http://f.org/", "", 9, b"z"),
    (9, "http://g.org/", OTHER, 9, b"z"),
    (9, "http://g.org/again", OTHER, 9, b"z"),
    (None, "http://h.org/", OTHER, 9, b"z"),
]
SCHEMA = "page_id long, url string, html string, digest long, payload binary"


def plain_records() -> list[tuple]:
    """(page_id, record) written one by one."""
    out = []
    for page, url, html, *_ in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h, *_ in PAGES if (h or "").encode() == raw and p is not None]
        again = len(raw) >= 1000 and page != max(same)
        head = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: <urn:page:{'unknown' if page is None else page}>"]
        head += ["WARC-Date: 2024-01-31T00:00:00Z", f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}"]
        head += [f"WARC-Payload-Digest: sha1:{hashlib.sha1(raw).hexdigest()}"]
        if again:
            head += [f"WARC-Profile: {warc.REVISIT}", f"WARC-Refers-To: <urn:page:{max(same)}>"]
        head += ["Content-Type: text/html", f"Content-Length: {0 if again else len(raw)}", "", ""]
        out.append((page, "\r\n".join(head).encode() + (b"" if again else raw) + b"\r\n\r\n"))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def archive(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    return warc.write_archive(spark, pages, Scratch(spark, "warc").path, date="2024-01-31T00:00:00Z")


def test_records_are_rebuilt_byte_for_byte(spark, archive):
    got = sorted(((r.page_id, bytes(r.record)) for r in warc.read_records(spark, archive).collect()), key=repr)
    assert got == plain_records()


def test_payloads_are_stored_once(spark, archive):
    stored = [bytes(r.payload) for r in spark.read.parquet(archive.payloads).collect()]
    assert sorted(stored) == sorted({(h or "").encode() for _, _, h, *_ in PAGES})


def test_index(spark, archive):
    got = {(r.page_id, r.target_uri): (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_index(spark, archive).collect()}
    size = len(BIG.encode())
    assert got[1, "http://a.org/X: y"] == ("revisit", 7, size) and got[3, None if (3, None) in got else ""] == ("revisit", 7, size)
    assert got[7, "http://b.org/"] == ("response", None, size)
    assert got[4, "http://c.org/"] == got[5, "http://d.org/"] == ("response", None, 5)
    assert got[9, "http://g.org/"] == got[9, "http://g.org/again"] == ("response", None, 1000)
    assert got[None, "http://h.org/"] == ("revisit", 9, 1000)


def test_damage_is_an_error(spark):
    path = Scratch(spark, "warc").path
    archive = warc.write_archive(spark, spark.createDataFrame(PAGES[:2], SCHEMA), path)
    digest = spark.read.parquet(archive.payloads).first().digest
    spark.createDataFrame([(digest, b"other bytes")], "digest string, payload binary").write.mode("overwrite").parquet(archive.payloads)
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_records(spark, archive).collect()
