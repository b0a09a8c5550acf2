import base64
import hashlib
import time
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from routestats.llm import derivatives as dv

PAGE = (
    '<!DOCTYPE html><html lang="EN-us"><head><title>A &amp; B</title><style>p{x:1}</style><script>if (a<b) "</p>"</script></head>'
    '<body><!-- gone <p>no</p> --><h1>Head&nbsp;line</h1><p>One <b>bo</b>ld &lt;tag&gt; 2 &#62; 1<br>next   line</p>'
    '<a href="/x?a=1&amp;b=2">in</a> <A HREF=\'http://other.test/\'>out</A><ul><li>i1<li>i2</ul>caf&eacute; a < b</body></html>'
)


def test_plain_text():
    assert dv.plain_text(PAGE) == "Head line\nOne bold <tag> 2 > 1\nnext line\nin out\ni1\ni2\ncafé a < b"
    assert dv.plain_text("") == "" and dv.plain_text("no tags\r\n\r\n at all ") == "no tags\nat all"
    assert dv.plain_text("a<script>never closed <p>x") == "a" and dv.plain_text("a<!-- open") == "a"
    assert len(dv.plain_text("<p>x" * 200_000)) == 399_999


@pytest.mark.parametrize("part", ["<a", "<a ", "<title ", "<script ", "<html ", "<!--", "<!-- -->", "</", "<p", "<a href", "<svg><", "]]>", "<style>"])
@pytest.mark.parametrize("end", ["", ">", "<!-- -->", "</title >"])
def test_time_grows_with_the_page_only(part, end):
    page = part * (1_000_000 // len(part)) + end
    started = time.process_time()
    dv.plain_text(page), dv.title_of(page)
    list(dv.attributes(page, dv._A, dv._HREF)), list(dv.attributes(page, dv._HTML, dv._LANG))
    assert time.process_time() - started < 4


def test_open_elements_and_tags():
    assert dv.title_of("<title>a <b") == "a <b" and dv.title_of("<TITLE x>a</title ><title>b</title>") == "a" and dv.title_of("<title") is None
    assert dv.plain_text("one <b two") == "one <b two" and dv.plain_text("a<p>b<script>c</p> d") == "a\nb"
    links = list(dv.attributes("<a x href=1><A HREF='2'><a name=q><b href=4><a\nhref=\"5\" href=6>", dv._A, dv._HREF))
    assert links == ["1", "2", "5"]


def test_whole_records_against_a_plain_version(spark, sf):
    """Titles, languages, links and digests of all pages, read by a parser."""

    class Page(HTMLParser):
        def __init__(self):
            super().__init__()
            self.title, self.lang, self.links, self.inside = None, None, [], False

        def handle_starttag(self, tag, attrs):
            attrs = dict(attrs)
            if tag == "html":
                self.lang = attrs.get("lang")
            if tag == "a" and attrs.get("href") is not None:
                self.links.append(attrs["href"])
            if tag == "title" and self.title is None:
                self.title, self.inside = "", True

        def handle_endtag(self, tag):
            self.inside &= tag != "title"

        def handle_data(self, data):
            if self.inside:
                self.title += data

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {(r.page_id, r.record_type): r for r in dv.build_derivatives(dv.page_responses(pages)).collect()}
    for page in pages.collect():
        parser = Page()
        parser.feed(page.html or "")
        parser.close()
        data = (page.html or "").encode()
        digest = "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
        meta = bytes(rows[page.page_id, "metadata"].block).decode()
        fields = [line.split(": ", 1) for line in meta.strip().split("\r\n")]
        told = dict(fields)
        assert told["payload-digest"] == digest and told["payload-length"] == str(len(data)) and told["http-status"] == "HTTP/1.1 200 OK"
        assert told["source-header-content-type"] == "text/html; charset=utf-8"
        assert told.get("title", "").strip() == " ".join((parser.title or "").split())
        assert told.get("languages-declared") == (parser.lang.lower() if parser.lang else None)
        links = [f"{urljoin(page.url or '', link.strip())} L a/@href" for link in parser.links]
        assert [v for n, v in fields if n == "outlink"] == [" ".join(v.split()) for v in links]
        text = bytes(rows[page.page_id, "conversion"].block)
        assert told["text-digest"] == rows[page.page_id, "conversion"].block_digest == "sha1:" + base64.b32encode(hashlib.sha1(text).digest()).decode()


def test_text_agrees_with_a_parser(spark, sf):
    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.off:
                self.out.append(data)

    for (page,) in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect():
        parser = Text()
        parser.feed(page)
        parser.close()
        assert "".join(dv.plain_text(page).split()) == "".join("".join(parser.out).split())


def test_records_are_linked_and_can_be_read_back(spark, clashing):
    rows = [(1, "http://a.test/dir/page", PAGE), (2, None, None), (3, "http://b.test/", "")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = dv.build_derivatives(dv.page_responses(pages)).collect()
    assert len(found) == 6
    by_id = {r.record_id: r for r in found}
    for row in found:
        ((headers, block),) = dv.parse_records(dv.warc_record(row.headers, bytes(row.block)))
        assert block == bytes(row.block) and headers["WARC-Type"] == row.record_type
        assert headers["WARC-Record-ID"] == row.record_id and headers["WARC-Refers-To"] == row.refers_to
        assert headers["WARC-Block-Digest"] == row.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        other = by_id[headers["WARC-Concurrent-To"]]
        assert other.page_id == row.page_id and other.record_type != row.record_type and other.refers_to == row.refers_to
        assert headers.get("WARC-Target-URI") == dict(zip([1, 2, 3], [r[1] for r in rows], strict=True))[row.page_id]
    meta = next(bytes(r.block).decode() for r in found if r.page_id == 1 and r.record_type == "metadata")
    text = next(r for r in found if r.page_id == 1 and r.record_type == "conversion")
    assert bytes(text.block).decode() == dv.plain_text(PAGE)
    for line in ("http-status: HTTP/1.1 200 OK", "source-header-content-type: text/html; charset=utf-8", "title: A & B",
                 f"source-header-content-length: {len(PAGE.encode())}", "languages-declared: en-us",
                 "outlink: http://a.test/x?a=1&b=2 L a/@href", "outlink: http://other.test/ L a/@href",
                 f"payload-digest: {text.payload_digest}", f"text-digest: {text.block_digest}"):
        assert f"{line}\r\n" in meta


def test_given_identifiers_are_kept_and_results_repeat(spark):
    responses = spark.createDataFrame(
        [(1, "<urn:uuid:x>", "http://a/", "2020-05-05T00:00:00Z", "HTTP/1.0 404 Not Found", "Server: s\r\nbad\r\nX:  y ", bytearray(b"\xff<p>t"), "sha1:GIVEN"),
         (1, None, None, None, None, None, None, None)],
        "page_id long, record_id string, target_uri string, date string, status string, source_headers string, payload binary, payload_digest string",
    )
    one, two = (sorted(map(tuple, dv.build_derivatives(responses).collect())) for _ in range(2))
    assert one == two
    given = [r for r in dv.build_derivatives(responses).collect() if r.refers_to == "<urn:uuid:x>"]
    assert len(given) == 2 and all(r.payload_digest == "sha1:GIVEN" and "WARC-Refers-To-Date: 2020-05-05T00:00:00Z" in r.headers for r in given)
    meta = bytes(next(r.block for r in given if r.record_type == "metadata")).decode()
    assert "http-status: HTTP/1.0 404 Not Found" in meta and "source-header-x: y" in meta and "bad" not in meta
    assert dv.build_derivatives(responses.limit(0)).count() == 0


def test_header_values_stay_on_one_line(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nWARC-Type: evil", "<title>x\n\ny</title>")], "page_id long, url string, html string")
    for row in dv.build_derivatives(dv.page_responses(pages)).collect():
        assert row.headers.count("WARC-Type: ") == 1 + row.headers.count(" WARC-Type: evil")
    assert dv.page_responses(pages).select(F.length("payload")).first()[0] == 19
