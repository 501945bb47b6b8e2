"""Metadata and plain-text conversion records derived from response records of raw artifacts."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.line_dedup import host_of

VERSION = "WARC/1.1"
#: Elements that are no text, and those after which a line ends (fixed values).
_HIDDEN = "script|style|noscript|template|svg"
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
_COMMENT = r"<!--.*?(?:-->|\Z)"
#: A head ends before the first text or element that cannot stand in one: its own end tag and that of the page's start are optional.
_HEAD = (
    rf"<head(?=[\s/>])[^>]*>(?:\s+|{_COMMENT}|"
    + "|".join(rf"<{name}\b[^>]*>.*?(?:</{name}\s*>|\Z)" for name in ("title", "script", "style", "noscript", "template"))
    + r"|</?(?:meta|link|base|basefont|bgsound)\b[^>]*>|<[!?][^>]*>)*+(?:</head\s*>)?"
)
_HEAD_AT = re.compile(_HEAD, re.DOTALL | re.IGNORECASE)
_HIDDEN_AT = re.compile(rf"<({_HIDDEN})\b", re.IGNORECASE)
_NAME_AT = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)\b")
_CLOSE_OF = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in [*_HIDDEN.split("|"), "title"]}
_TITLE = re.compile(r"<title\b[^>]*>", re.IGNORECASE)
_ANCHOR = re.compile(r"<a\b", re.IGNORECASE)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_HREF_AT = re.compile(r"\bhref\s*=", re.IGNORECASE)
_STOP = re.compile("[>\"']")
_SPACE = re.compile(r"[^\S\n]+")


class _Markup:
    """One forward pass over a page: where each piece of markup ends and what stands for it in the text.

    Time is linear in the page whatever it holds: a tag that is never closed is left as it stands, and the quotes that led its search to
    the end of the page are remembered, so no search goes there twice.
    """

    def __init__(self, page: str):
        self._page, self._dead = page, set()
        self._last_close = page.rfind(">")
        self._last_stop = max(self._last_close, page.rfind('"'), page.rfind("'"))

    def _tag_end(self, at: int) -> int:
        """The place behind the closing bracket of a tag, which stands outside quotes; -1 if there is none."""
        trail = []
        while at <= self._last_stop:
            stop = _STOP.search(self._page, at)
            if stop.group() == ">":
                return stop.end()
            trail.append(stop.start())
            close = -1 if stop.start() in self._dead else self._page.find(stop.group(), stop.end())
            if close < 0:
                break
            at = close + 1
        self._dead.update(trail)
        return -1

    def at(self, i: int) -> tuple[int, str] | None:
        """End and replacement of the markup that begins with the bracket at ``i``; None if that is plain text."""
        page = self._page
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            return (len(page) if end < 0 else end + 3), " "
        if i > self._last_close:
            return None
        if head := _HEAD_AT.match(page, i):
            return head.end(), " "
        if hidden := _HIDDEN_AT.match(page, i):
            name = hidden[1].lower()
            if name == "svg" and (end := self._tag_end(hidden.end())) > 0 and page[end - 2] == "/":
                return end, " "
            close = _CLOSE_OF[name].search(page, page.index(">", hidden.end()) + 1)
            return (close.end() if close else len(page)), " "
        if name := _NAME_AT.match(page, i):
            end = self._tag_end(name.end())
            return (end, "\n" if name[1].lower() in _BLOCKS else "") if end > 0 else None
        if page[i + 1 : i + 2] in ("!", "?"):
            return page.index(">", i + 2) + 1, " "
        return None


def plain_text(page: str) -> str:
    """The visible text of a page: one line per block element, entities resolved, runs of blanks made one."""
    markup, shown, done = _Markup(page), [], 0
    at = page.find("<")
    while at >= 0:
        if found := markup.at(at):
            shown += [page[done:at], found[1]]
            done = found[0]
        at = page.find("<", done if found else at + 1)
    shown.append(page[done:])
    lines = (_SPACE.sub(" ", line).strip() for line in html.unescape("".join(shown)).split("\n"))
    return "\n".join(line for line in lines if line)


def title_of(page: str) -> str | None:
    """What stands in the first title element that is closed."""
    begin = _TITLE.search(page)
    close = begin and _CLOSE_OF["title"].search(page, begin.end())
    return page[begin.end() : close.start()] if close else None


def outlinks(page: str, base: str) -> list[str]:
    """Link targets in order, each once, made absolute; a target that is no URL is kept as written."""
    found, hrefs, done, next_close, broken = [], [m.start() for m in _HREF_AT.finditer(page)], 0, -1, set()
    for anchor in _ANCHOR.finditer(page):
        if anchor.start() < done:
            continue
        if next_close < anchor.end():
            next_close = page.find(">", anchor.end())
            next_close = len(page) if next_close < 0 else next_close
        for n in range(bisect_left(hrefs, anchor.end()), len(hrefs)):
            if hrefs[n] > next_close:
                break
            if hrefs[n] in broken:
                continue
            m = _HREF.match(page, hrefs[n])
            if m is None:
                broken.add(hrefs[n])
            else:
                done = m.end()
                target = html.unescape(next(g for g in m.groups() if g is not None)).strip()
                try:
                    found.append(urljoin(base, target))
                except ValueError:
                    found.append(target)
                break
    return list(dict.fromkeys(" ".join(f.split()) for f in found))


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same id for the same parts, so a derived record is the same after a lost task."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(31).join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=5)}>"


def _clean(value: str) -> str:
    """A header value cannot hold line ends."""
    return " ".join(value.split())


def serialized(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {_clean(v)}" for k, v in headers if v), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


_FIELDS = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, content_length long, block string"


def response_records(artifacts: DataFrame) -> DataFrame:
    """Response records of raw artifacts: ``artifact_id``, ``record_id``, ``target_uri``, ``warc_date``, ``http_headers``,
    ``payload_digest``, ``block_digest``, ``body``.

    ``artifacts`` has ``artifact_id``, ``logical_label`` (the target), ``media_type``, ``created_at_utc`` (UTC text) and ``body`` (text). The block is an
    HTTP response of these headers and the body; its digests are SHA-1 in base 32, of the block and of the payload.
    """
    id_type = artifacts.schema["artifact_id"].dataType.simpleString()
    names = ("artifact_id", "record_id", "target_uri", "warc_date", "http_headers", "payload_digest", "block_digest", "body")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for artifact_id, label, media, date, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (body or "").encode("utf-8", "surrogatepass")
                headers = f"HTTP/1.1 200 OK\r\nContent-Type: {_clean(media or 'application/octet-stream')}\r\nContent-Length: {len(payload)}\r\n\r\n"
                digest = sha1_label(payload)
                made = record_id("response", str(artifact_id), label or "", date or "", digest)
                rows.append((artifact_id, made, label or "", date or "", headers, digest, sha1_label(headers.encode() + payload), body or ""))
            types = (batch.column(0).type, *[pa.string()] * 7)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=list(names))

    read = artifacts.select("artifact_id", "logical_label", "media_type", "created_at_utc", "body")
    return read.mapInArrow(build, f"artifact_id {id_type}, " + ", ".join(f"{n} string" for n in names[1:]))


def derived_records(responses: DataFrame) -> DataFrame:
    """Two linked records per response: ``metadata`` (``application/warc-fields``) and ``conversion`` (``text/plain``).

    Columns: ``artifact_id``, ``warc_type``, ``record_id``, ``refers_to``, ``target_uri``, ``warc_date``, ``content_type``, ``block_digest``, ``payload_digest``,
    ``content_length``, ``block``. Both refer to the response's ``record_id`` and keep its target and date. The metadata block holds the source's
    HTTP headers line by line, its payload and block digests, the id of the conversion, the title, host and links. The
    conversion's ``payload_digest`` is that of the source payload, its ``block_digest`` that of the text. Ids depend on content alone.

    One pass, no shuffle, one page in memory at a time. Defined cases: a null or empty body gives an empty conversion and metadata
    without title or links; null labels, media types and dates are left out of the records; repeated rows give the same records again; a
    null id stays null; unclosed markup runs to the end of the page, but a head ends where a browser ends it; an empty table gives an empty table. Other columns are not read.
    """
    id_type = responses.schema["artifact_id"].dataType.simpleString()
    names = ["artifact_id", *(f.split()[0] for f in _FIELDS.split(", "))]

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for artifact_id, source, uri, date, headers, payload_digest, block_digest, body, host in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = plain_text(body)
                converted = text.encode("utf-8", "surrogatepass")
                conversion, metadata = record_id("conversion", source), record_id("metadata", source)
                title = title_of(body)
                fields = [("source-header", line) for line in headers.split("\r\n") if line]
                fields += [("source-payload-digest", payload_digest), ("source-block-digest", block_digest), ("conversion", conversion), ("host", host or "")]
                fields += [("title", plain_text(title))] if title is not None else []
                fields += [("outlink", link) for link in outlinks(body, uri)]
                block = "".join(f"{k}: {_clean(v)}\r\n" for k, v in fields if v)
                described = block.encode("utf-8", "surrogatepass")
                rows.append((artifact_id, "metadata", metadata, source, uri, date, "application/warc-fields", sha1_label(described), payload_digest, len(described), block))
                rows.append((artifact_id, "conversion", conversion, source, uri, date, "text/plain; charset=utf-8", sha1_label(converted), payload_digest, len(converted), text))
            types = (batch.column(0).type, *[pa.string()] * 8, pa.int64(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    read = responses.select("artifact_id", "record_id", "target_uri", "warc_date", "http_headers", "payload_digest", "block_digest", "body", host_of(F.col("target_uri")).alias("host"))
    return read.mapInArrow(derive, f"artifact_id {id_type}, {_FIELDS}")


def write_records(records: DataFrame, path: str) -> None:
    """The records as ``.warc`` text parts in ``path``: each part is a readable sequence of whole records."""

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, made, source, uri, date, content_type, digest, payload, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                headers = [("WARC-Type", kind), ("WARC-Record-ID", made), ("WARC-Refers-To", source), ("WARC-Target-URI", uri), ("WARC-Date", date)]
                headers += [("Content-Type", content_type), ("WARC-Block-Digest", digest), ("WARC-Payload-Digest", payload if kind == "metadata" else "")]
                whole = serialized([(k, v or "") for k, v in headers], block.encode("utf-8", "surrogatepass"))
                out.append(whole.decode("utf-8", "surrogatepass").removesuffix("\r\n\r\n"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    read = records.select("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "payload_digest", "block")
    read.mapInArrow(serialize, "value string").write.option("lineSep", "\r\n\r\n").text(path)
