"""WARC files: streaming, charsets, all source headers; links in every quoting; odd pages."""

import gzip

from pyspark.sql import functions as F

from spanloom.llm import warc


def record(kind, body, extra=b""):
    return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:uuid:%d>\r\nWARC-Target-URI: http://a\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(body), extra, len(body), body)


def page(html, kind=b"text/html"):
    return b"HTTP/1.1 200 OK\r\nContent-Type: " + kind + b"\r\n\r\n" + html


BLOCKS = [b"", b"\n", b"no line end", b"\r\n\r\nWARC/1.0\r\nfake: 1\r\n\r\n", bytes(range(256)) * 40, b"x" * 5_000_000 + b"\n\n"]


def test_files_give_equal_blocks(spark, tmp_path):
    data = [record(b"resource", x) for x in BLOCKS]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(data)))
    got = warc.read_warc(spark, str(tmp_path)).select("path", "record_id", F.md5("block").alias("m"), F.length("block").alias("n")).collect()
    import hashlib

    want = sorted((len(x), hashlib.md5(x).hexdigest()) for x in BLOCKS)
    for name in ("a.warc", "b.warc.gz", "c.warc.gz"):
        assert sorted((r["n"], r["m"]) for r in got if r["path"].endswith(name)) == want


def test_charsets_and_source_headers(spark, tmp_path):
    blocks = [
        page("<p>über</p>".encode("latin-1"), b"text/html; charset=ISO-8859-1"),
        page("<meta charset='windows-1252'><p>“so” €1</p>".encode("cp1252")),
        page("<p>日本 the</p>".encode("shift_jis"), b"text/html; charset=Shift_JIS"),
        page("<p>plain é here</p>".encode(), b"text/html; charset=unknown-9"),
        b"<p>no head, no charset at all</p>",
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(b"response", x, b"WARC-IP-Address: 10.0.0.1\r\nX-Crawl: one: two\r\n")) for x in blocks))
    made = warc.derive(warc.from_warc(warc.read_warc(spark, str(tmp_path)))).collect()
    assert {r["block"] for r in made if r["record_type"] == "conversion"} == {"über", "“so” €1", "日本 the", "plain é here", "no head, no charset at all"}
    for r in made:
        if r["record_type"] == "metadata":
            assert "source-warc: WARC-IP-Address: 10.0.0.1\r\n" in r["block"] and "source-warc: X-Crawl: one: two\r\n" in r["block"]
            assert f"WARC-Refers-To: {r['refers_to']}\r\n" in r["headers"]


def test_links_and_entities(spark):
    html = "<a href = '/one'>1</a><a class=x href=/two>2</a><A HREF=\"/a&amp;lt;b\">3</A><area href='/four' ><a name=x>no</a><link href=/no>&amp &lt &unknown; &amp;lt; a&b;c &#39;&"
    rows = [(1, "u", html, "m"), (1, "u", html, "m"), (2, None, "x" * 1_000_000, None), (None, None, None, None)]
    got = warc.derive(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string, record_type string"))).collect()
    assert len(got) == 8
    own = [r for r in got if r["page_id"] == 1 and r["record_type"] == "metadata"]
    assert len({r["record_id"] for r in own}) == 1 and [x[9:] for x in own[0]["block"].split("\r\n") if x.startswith("outlink: ")] == ["/one", "/two", "/a&lt;b", "/four"]
    assert {r["block"] for r in got if r["page_id"] == 1 and r["record_type"] == "conversion"} == {"123no&amp &lt &unknown; &lt; a&b;c '&"}
    assert {r["content_length"] for r in got if r["page_id"] == 2 and r["record_type"] == "conversion"} == {1_000_000}
