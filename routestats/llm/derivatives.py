"""WARC derivatives: linked metadata and plain-text conversion records for responses."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routestats.llm.arrow import map_rows

#: Used for responses without a date of their own.
DATE = "2024-01-01T00:00:00Z"

_DROPPED = re.compile(
    r"<!--.*?(?P<end>-->|\Z)|<!\[CDATA\[|\]\]>"
    r"|<(?P<name>script|style|noscript|template|svg|title|textarea|iframe)\b[^>]*>.*?(?P<stop></(?P=name)\s*>|\Z)",
    re.S | re.I,
)
_OPEN = re.compile(r"<!--.*|<!\[CDATA\[", re.S | re.I)
_BREAKS = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr"
    r"|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>", re.I,
)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?P<stop></title\s*>|\Z)", re.S | re.I)
_HTML, _LANG = re.compile(r"<html\b", re.I), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_A, _HREF = re.compile(r"<a\b", re.I), re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _closed(page: str) -> tuple[str, str]:
    """The page up to its last ``>``, and the rest, in which no tag can end: so no pattern looks for one in vain from
    every ``<`` on."""
    at = page.rfind(">") + 1
    return page[:at], page[at:]


def _replaced(pattern: re.Pattern, by: str, text: str) -> str:
    head, tail = _closed(text)
    return pattern.sub(by, head) + tail


def _without_dropped(page: str) -> str:
    """The page without comments and without elements whose content is no text; open ones go to its end."""
    (head, tail), is_open = _closed(page), False

    def space(found: re.Match) -> str:
        nonlocal is_open
        is_open |= found["end"] == "" or found["stop"] == ""
        return " "

    head = _DROPPED.sub(space, head)
    return head if is_open else head + _OPEN.sub(" ", tail)


def plain_text(page: str) -> str:
    """The visible text of an HTML page: a line for each block, spaces collapsed, entities resolved."""
    text = _replaced(_TAG, "", _replaced(_BREAKS, "\n", _without_dropped(page)))
    return _LINES.sub("\n", _SPACES.sub(" ", html.unescape(text).replace("\r", "\n"))).strip(" \n")


def title_of(page: str) -> str | None:
    """What the first title element holds; an open one goes to the end of the page."""
    head, tail = _closed(page)
    found = _TITLE.search(head)
    return found and found[1] + (tail if found["stop"] == "" else "")


def attributes(page: str, element: re.Pattern, attribute: re.Pattern) -> Iterator[str]:
    """The attribute's value in each tag of the element that has it; every tag is looked through once."""
    for tag in _TAG.finditer(_closed(page)[0]):
        begin = element.search(tag[0])
        found = begin and attribute.search(tag[0], begin.end())
        if found:
            yield next(g for g in found.groups() if g is not None)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A name that depends on the parts alone, so that a repeated task gives the same one."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(parts).encode('utf-8', 'surrogatepass')).digest(), version=3)}>"


def _one_line(value: str) -> str:
    return " ".join(value.split())


def warc_headers(fields: list[tuple[str, str | None]]) -> str:
    """Header lines of a record; fields without a value are left out."""
    return "".join(f"{name}: {_one_line(value)}\r\n" for name, value in fields if value is not None)


def warc_record(headers: str, block: bytes) -> bytes:
    """A whole record as it stands in a WARC file."""
    return b"WARC/1.1\r\n" + headers.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and the block of every record in the bytes of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
        headers = dict(line.split(": ", 1) for line in lines)
        length = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 8 + length


def derive(
    record: str, uri: str | None, date: str, status: str, source_headers: str, payload: bytes, payload_digest: str | None = None
) -> list[tuple]:
    """(type, id, refers to, headers, block) of the metadata and the conversion record of one response.

    Both refer to the response by its id, target and date; they name each other. The metadata block keeps the status
    line, the source headers and the payload digest (given or computed), next to title, language and outlinks.
    """
    page = payload.decode("utf-8", "replace")
    digest = payload_digest or sha1(payload)
    text = plain_text(page).encode("utf-8", "surrogatepass")
    names = {kind: record_id(kind, record, digest) for kind in ("metadata", "conversion")}
    title, lang = title_of(page), next(attributes(page, _HTML, _LANG), None)
    fields: list[tuple[str, str | None]] = [
        ("http-status", status), *[(f"source-header-{n.lower()}", v) for n, v in source_fields(source_headers)],
        ("payload-digest", digest), ("payload-length", str(len(payload))), ("text-digest", sha1(text)),
        ("title", html.unescape(title) if title is not None else None), ("languages-declared", lang.lower() if lang else None),
    ]
    for link in attributes(page, _A, _HREF):
        target = html.unescape(link).strip()
        try:
            fields.append(("outlink", f"{urljoin(uri or '', target)} L a/@href"))
        except ValueError:
            fields.append(("outlink", f"{target} L a/@href"))
    blocks = {"metadata": warc_headers(fields).encode("utf-8", "surrogatepass"), "conversion": text}
    kinds = {"metadata": "application/warc-fields", "conversion": "text/plain; charset=utf-8"}
    out = []
    for kind, other in (("metadata", "conversion"), ("conversion", "metadata")):
        headers = warc_headers([
            ("WARC-Type", kind), ("WARC-Record-ID", names[kind]), ("WARC-Date", date), ("WARC-Target-URI", uri),
            ("WARC-Refers-To", record), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date),
            ("WARC-Concurrent-To", names[other]), ("WARC-Source-Payload-Digest", digest),
            ("WARC-Block-Digest", sha1(blocks[kind])), ("Content-Type", kinds[kind]), ("Content-Length", str(len(blocks[kind]))),
        ])
        out.append((kind, names[kind], record, headers, blocks[kind]))
    return out


def source_fields(headers: str) -> list[tuple[str, str]]:
    """Names and values of HTTP header lines; lines without a colon are left out."""
    return [(n.strip(), v.strip()) for n, c, v in (line.partition(":") for line in headers.splitlines()) if c and n.strip()]


_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
    ("target_uri", pa.string()), ("headers", pa.string()), ("block", pa.binary()), ("block_digest", pa.string()),
    ("payload_digest", pa.string()),
])
_DDL = ("page_id long, record_type string, record_id string, refers_to string, target_uri string, headers string, "
        "block binary, block_digest string, payload_digest string")  # fmt: skip


def build_derivatives(responses: DataFrame) -> DataFrame:
    """Two records for each row of ``responses``, with headers, block and digests ready to be written.

    ``responses`` has page_id, record_id, target_uri, date, status, source_headers (lines), payload (binary) and
    payload_digest; other columns are ignored. A null payload is empty, null headers are none, a null date is DATE, a
    null id is derived from the other values, a null digest is computed, a null target is left out. Rows that are
    alike give records that are alike. The time for a page grows with its length, whatever it holds: tags that never
    end are text. Each page is handled by itself, so nothing is shuffled; an empty table gives
    an empty result.
    """

    def built(rows: Iterable[tuple]) -> Iterator[tuple]:
        for page_id, record, uri, date, status, headers, payload, digest in rows:
            payload = payload or b""
            digest = digest or sha1(payload)
            record = record or record_id("response", str(page_id), uri or "", digest)
            for kind, name, refers, lines, block in derive(record, uri, date or DATE, status or "", headers or "", payload, digest):
                yield page_id, kind, name, refers, uri, lines, block, sha1(block), digest

    columns = ["page_id", "record_id", "target_uri", "date", "status", "source_headers", "payload", "payload_digest"]
    return map_rows(responses.select(*columns), built, _SCHEMA, _DDL, lambda row: 1000 + len(row[6]))


def page_responses(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as successful responses in the form that ``build_derivatives`` takes."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    text = F.lit(None).cast("string")
    headers = F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(payload).cast("string"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), text.alias("record_id"), F.col("url").cast("string").alias("target_uri"),
        F.lit(DATE).alias("date"), F.lit("HTTP/1.1 200 OK").alias("status"), headers.alias("source_headers"),
        payload.alias("payload"), text.alias("payload_digest"),
    )
