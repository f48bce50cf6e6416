"""ARC and WARC: both header versions, declared lengths, revisits, broken archives."""

from __future__ import annotations

import gzip

import pytest

from touchline.llm import warc


@pytest.mark.parametrize("version", [1, 2])
def test_parse(version):
    head = warc.arc_head(version, "one file.arc", "19990102030405")
    fields = {"URL": "http://a.b/c d", "IP-address": "1.2.3.4", "Archive-date": "19990102030405", "Content-type": "text/html"}
    blocks = [b"HTTP/1.0 200 OK\r\n\r\nbody\n\nhttp://x 1.1.1.1 2 t 3\n", b"", b"\n\n"]
    data = head + b"".join(warc.arc_record(version, fields, b) for b in blocks[:2]) + b"\n"
    got = list(warc.parse_arc(data))
    assert [b for _, b in got[1:]] == blocks[:2]
    assert got[0][0]["URL"] == "filedesc://one%20file.arc" and got[1][0]["URL"] == "http://a.b/c%20d"
    assert set(got[1][0]) == set(warc.FIELDS[version])
    for bad in (data[:-30], head[5:], head + b"http://a 1 2 3\n", head + warc.arc_record(3 - version, fields, b"x")):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))


def test_convert():
    fields = {"URL": "http://a/", "IP-address": "1.2.3.4", "Archive-date": "19990102030405"}
    record = warc.convert(fields, b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello", "7")
    (head, block), = warc.parse_warc(record)
    assert head["WARC-Type"] == "response" and head["WARC-Date"] == "1999-01-02T03:04:05Z" and block.endswith(b"hello")
    assert head["WARC-Payload-Digest"] == "sha1:" + warc.digest(b"hello")
    (again, block), = warc.parse_warc(warc.convert(fields, b"HTTP/1.1 200 OK\r\n\r\nhello", "9", "7"))
    assert again["WARC-Type"] == "revisit" and again["WARC-Refers-To"] == head["WARC-Record-ID"] and not block.endswith(b"hello")
    (other, _), = warc.parse_warc(warc.convert(fields | {"Content-type": "text/dns"}, b"plain", "1"))
    assert other["WARC-Type"] == "resource" and other["Content-Type"] == "text/dns"
    assert warc.warc_date("199901020304") == "1999-01-02T03:04:00Z" and warc.warc_date("x") == "1970-01-01T00:00:00Z"


def test_pages(spark):
    rows = [(4, "http://a/b c", "same", 1), (2, None, "same", 1), (9, "u", "same", 1), (2, "v", "same", 2), (None, "w", "same", 1), (1, "x", None, 1), (3, "y", "", 1), (None, "z", "alone", 1), (8, "p", "\r\n\r\nWARC/1.1\r\n é", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.page_archives(df)).collect()), key=str)
    d = lambda s: warc.digest(s.encode())
    same = [("4", 4, d("same"), "revisit", "2"), ("2", 4, d("same"), "response", None), ("9", 4, d("same"), "revisit", "2"), ("2", 4, d("same"), "response", None), (None, 4, d("same"), "revisit", "2")]
    want = [*same, ("1", 0, d(""), "response", None), ("3", 0, d(""), "revisit", "1"), (None, 5, d("alone"), "response", None), ("8", len("\r\n\r\nWARC/1.1\r\n é".encode()), d("\r\n\r\nWARC/1.1\r\n é"), "response", None)]
    assert got == sorted(want, key=str)
    assert warc.read_archives(warc.page_archives(df.limit(0))).count() == 0


def test_several_archives_and_damage(spark):
    df = spark.range(50).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 100) as html").coalesce(1)
    arcs = warc.write_arc(df, archive_bytes=1000)
    assert arcs.count() > 3
    stored = warc.convert_archives(arcs)
    assert warc.read_archives(stored).count() == 50
    data = gzip.decompress(stored.first().data)
    broken = gzip.compress(data.replace(b"HTTP/1.1 200", b"HTTP/1.1 201", 1))
    bad = spark.createDataFrame([("a", bytearray(broken))], "name string, data binary")
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(bad).count()


def test_page_urls_like_a_version_block(spark):
    """A page whose url begins with filedesc:// is a page, and the records after it keep their own keys."""
    rows = [(i, "filedesc://old.arc" if i % 3 == 1 else "http://a/", f"page {i % 7}") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = sorted((int(r.page_id), r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.page_archives(df)).collect())
    assert got == [(i, warc.digest(html.encode()), "response" if i < 7 else "revisit", None if i < 7 else str(i % 7)) for i, _, html in rows]
    arcs = warc.write_arc(df)
    for keys in ("slice(keys, 1, 29)", "concat(keys, array('x'))"):
        wrong = arcs.selectExpr("name", "data", f"{keys} as keys", f"{keys.replace('keys', 'originals')} as originals")
        with pytest.raises(Exception, match="keys"):
            warc.convert_archives(wrong).count()
