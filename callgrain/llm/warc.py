"""WARC derivatives: responses to linked metadata and plain-text conversion records.

Each response gives two records.  The *metadata* record holds the page's title, language,
number of links, the source's headers and its payload digest; the *conversion* record holds
the text of the page.  Both name the response in ``WARC-Refers-To`` and keep its target URI
and date, so a derivative leads back to its source; the conversion also keeps the source's
payload digest beside its own.  Record ids are derived from the response's id and the kind
of record, so a rerun gives the same ids.

Text: comments, scripts, styles, templates and the head are dropped, tags of
blocks end a line, other tags vanish, character references are resolved, white space is
collapsed, empty lines go.

Edge cases: a null page is an empty payload and gives an empty text; a null URI leaves its
header out; rows that repeat give repeated records with equal ids; markup that never closes
ends at the end of the page, but a head before its first text or element of a body; a quote in
a tag without a partner is a plain character; reading takes time in proportion to a page's
length; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import uuid
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.llm.common import slices, table

#: The date that responses without one get.
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6f9619ff-8b86-d011-b42d-00c04fc964ff")

#: Elements whose content is no text, and elements that end a line.
DROPPED = "script style template noscript head"
BLOCKS = "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul"

#: What a head may hold; one without an end tag ends before anything else.
IN_HEAD = "title script style template noscript meta link base"

_BLOCKS, _RAW = frozenset(BLOCKS.split()), frozenset(DROPPED.split()) - {"head"}
_HEAD_ELEMENTS = frozenset(IN_HEAD.split())
#: A tag's opening and name; longer names are other elements.
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("[>\"']")
_SPACE = re.compile(r"\s*")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*DROPPED.split(), "title")}
_LANG = re.compile(r"(?<![\w-])lang\s*=\s*[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"(?<![\w-])href\s*=", re.I)


class Page:
    """One pass over a page's markup: its text in pieces, title, language and number of links.

    Each character is looked at a bounded number of times: a scan that finds nothing to the
    end of the page is not made again.
    """

    def __init__(self, page: str):
        self.page, self.pieces = page, []
        self.title: str | None = None
        self.lang: str | None = None
        self.links = 0
        self.missing: set[str] = set()
        self._run(0, len(page), True)

    def text(self) -> str:
        """A line for each block with text."""
        text = entities.unescape("".join(self.pieces))
        return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)

    def _find(self, what: str, at: int) -> int:
        """Place of a text from ``at`` on; -1, and not looked for again, if it does not come."""
        found = -1 if what in self.missing else self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def _end(self, name: str, at: int) -> re.Match | None:
        """The next end tag of an element, if there is one."""
        m = None if name in self.missing else _ENDS[name].search(self.page, at)
        if m is None:
            self.missing.add(name)
        return m

    def _tag_end(self, at: int) -> int:
        """What follows a tag: its ``>`` outside quotes, or the end; a quote without a partner is a plain character."""
        while (m := _SPECIAL.search(self.page, at)) is not None:
            if m[0] == ">":
                return m.end()
            partner = self._find(m[0], m.end())
            at = partner + 1 if partner >= 0 else m.end()
        return len(self.page)

    def _comment(self, at: int) -> int:
        end = self._find("-->", at + 4)
        return end + 3 if end >= 0 else len(self.page)

    def _note(self, name: str, begin: int, end: int) -> None:
        """Keep what the metadata wants of a start tag."""
        if name == "a":
            self.links += _HREF.search(self.page, begin, end) is not None
        elif name == "html" and self.lang is None:
            self.lang = m[1] if (m := _LANG.search(self.page, begin, end)) else None
        elif name == "title" and self.title is None and (m := self._end("title", end)):
            self.title = " ".join(entities.unescape(self.page[end : m.start()]).split())

    def _open_head(self, at: int) -> int:
        """The end of a head without an end tag."""
        while True:
            at = _SPACE.match(self.page, at).end()
            if self.page.startswith("<!--", at):
                at = self._comment(at)
                continue
            m = _NAME.match(self.page, at)
            name = m[2].lower() if m else ""
            if m is None or m[1] or name not in _HEAD_ELEMENTS:
                return at
            end = self._tag_end(m.end())
            self._note(name, m.end(), end)
            if name in _ENDS:
                closed = self._end(name, end)
                if closed is None:
                    return at
                end = closed.end()
            at = end

    def _run(self, at: int, stop: int, visible: bool) -> None:
        page, emit = self.page, self.pieces.append if visible else lambda x: None
        while at < stop:
            begin = page.find("<", at, stop)
            emit(page[at : begin if begin >= 0 else stop])
            if begin < 0:
                return
            if page.startswith("<!--", begin):
                at = self._comment(begin)
                continue
            m = _NAME.match(page, begin)
            if m is None:
                end = self._find(">", begin) if page[begin + 1 : begin + 2] in ("!", "?") else -1
                if end < 0:
                    emit("<")
                at = end + 1 if end >= 0 else begin + 1
                continue
            name, end = m[2].lower(), self._tag_end(m.end())
            if not m[1]:
                self._note(name, m.end(), end)
                if name in _RAW:
                    closed = self._end(name, end)
                    at = closed.end() if closed else len(page)
                    continue
                if name == "head" and visible:
                    closed = self._end("head", end)
                    if closed:
                        self._run(end, closed.start(), False)
                    at = closed.end() if closed else self._open_head(end)
                    continue
            if name in _BLOCKS:
                emit("\n")
            at = end


def plain_text(page: str | None) -> str:
    """Text of a page, a line for each block with text."""
    return Page(page or "").text()


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(map(str, parts)))}>"


def record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    head = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def derive(response_id: str, uri: str | None, date: str, headers: str, page: str | None):
    """``(kind, id, refers to, URI, source digest, block digest, text, record)`` of the two derivatives of a response."""
    payload = (page or "").encode()
    source = digest(payload)
    uri = re.sub(r"[\r\n]+", " ", uri) if uri is not None else None
    common = [("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Refers-To", response_id)]
    read = Page(page or "")
    lines = [("title", read.title), ("language", read.lang), ("outlinks", str(read.links)), ("source-payload-digest", source), ("source-length", str(len(payload)))]
    for line in headers.split("\r\n"):
        name, colon, value = line.partition(":")
        lines.append((f"source-header-{name.strip().lower()}", value.strip()) if colon else ("source-status", line.strip() or None))
    meta = "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None).encode()
    text = read.text().encode()
    out = []
    for kind, block, kinds in (("metadata", meta, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
        me, sha = record_id(response_id, kind), digest(block)
        extra = [("WARC-Source-Payload-Digest", source)] if kind == "conversion" else []
        whole = record(kind, [("WARC-Record-ID", me), *common, ("WARC-Block-Digest", sha), *extra, ("Content-Type", kinds)], block)
        out.append((kind, me, response_id, uri, source, sha, text.decode() if kind == "conversion" else None, whole))
    return out


RECORDS = "page_id {}, record_type string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, text string, record binary"


def _derive(batches):
    names = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "text", "record"]
    for part in slices(batches, 200):
        ids, rows = [], []
        for i, (rid, uri, date, headers, page) in enumerate(zip(*(part.column(c).to_pylist() for c in range(1, 6)), strict=True)):
            found = derive(rid, uri, date, headers, page)
            ids += [i] * len(found)
            rows += found
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds = [pa.string()] * 7 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


def responses(pages: DataFrame) -> DataFrame:
    """Pages as responses: ``page_id, response_id, uri, date, headers, html`` (native).

    Ids follow from page_id and URL.  Pages bring no HTTP headers of their own, so each gets
    those that a server would derive from it: length and tag of its payload, and a date that
    goes by its id (``DATE`` without one).
    """
    h = F.md5(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    part = lambda a, n: F.substring(h, a, n)
    rid = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))
    html = F.coalesce("html", F.lit(""))
    at = F.timestamp_seconds(F.lit(int(datetime.fromisoformat(DATE).timestamp())) + F.coalesce(F.pmod(F.col("page_id").cast("long"), F.lit(10**8)), F.lit(0)))
    said = [
        F.lit("HTTP/1.1 200 OK"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string")),
        F.concat(F.lit('ETag: "'), F.md5(html), F.lit('"')),
    ]
    date = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return pages.select("page_id", rid.alias("response_id"), F.col("url").alias("uri"), date.alias("date"), F.concat_ws("\r\n", *said).alias("headers"), "html")


def response_record(response_id: str, uri: str | None, date: str, headers: str, page: str | None) -> bytes:
    """The response record that both derivatives of a page refer to."""
    payload = (page or "").encode()
    block = headers.encode() + b"\r\n\r\n" + payload
    uri = re.sub(r"[\r\n]+", " ", uri) if uri is not None else None
    fields = [("WARC-Record-ID", response_id), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http;msgtype=response")]
    return record("response", fields, block)


def _records(batches):
    for batch in slices(batches, 200):
        rows = [response_record(*r) for r in zip(*(batch.column(c).to_pylist() for c in range(1, 6)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["page_id", "record_id", "record"])


def response_records(found: DataFrame) -> DataFrame:
    """``page_id, record_id, record`` of every response (columns as of :func:`responses`)."""
    rows = found.select("page_id", "response_id", "uri", "date", "headers", "html")
    return rows.mapInArrow(_records, f"page_id {found.schema['page_id'].dataType.simpleString()}, record_id string, record binary")


def derivatives(found: DataFrame) -> DataFrame:
    """The two records of every response (columns as of :func:`responses`); one pass, no shuffle."""
    return found.select("page_id", "response_id", "uri", "date", "headers", "html").mapInArrow(_derive, RECORDS.format(found.schema["page_id"].dataType.simpleString()))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest form of both records of every page."""
    rows = derivatives(responses(table(spark, sf_dir, "pages")))
    return rows.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", F.octet_length("record").cast("long").alias("record_length"), F.sha2("record", 256).alias("record_sha256"))


QUERIES = {"op10_warc_derivatives": op10_warc_derivatives}
ORACLE_SQL: dict[str, str] = {}
