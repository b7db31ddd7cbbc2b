"""WARC records and their derivatives.

`responses` wraps pages as response records (an HTTP head and the page). `derive` builds
from each response a metadata record and a plain-text conversion record; both name the
response in WARC-Refers-To, with its target and date, and the metadata block keeps its
HTTP head and payload digest. `save` and `load` write and read the file format.

Record ids are name-based UUIDs of what they name, so that a task that runs again makes
the same records. Each record is made from one row: nothing shuffles.

Markup is read in one pass, in time linear in the page whatever it holds: every search goes on
from where the last one ended, and none is tried again once it has failed.

Defined results: a null html is an empty page; a null url gives a record without
WARC-Target-URI; repeated rows give repeated records; other columns aren't looked at;
an empty table gives no rows; html is read whole, whatever its length or nesting.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DATE = "2024-01-01T00:00:00Z"  # pages carry none; a parameter
SPACE_ID = uuid.UUID("6f1c1f0e-6a61-5b0e-9a35-7d9f6ab2c001")
RECORD = "page_id long, record_id string, warc_type string, target_uri string, refers_to string, warc_date string, content_type string, payload_digest string, block_digest string, content_length long, block binary"
NAMES = [x.split()[0] for x in RECORD.split(", ")]
TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

#: Elements whose text isn't shown; of those in RAW nothing inside is markup.
HIDDEN, RAW = {"script", "style", "template", "noscript", "head"}, {"script", "style"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre",
    "section", "table", "td", "th", "tr", "ul",
}
_NAME = re.compile(r"/?([a-zA-Z]\w*)", re.A)
_CLOSE = {n: re.compile(rf"(?ai)</{n}\s*>") for n in (*HIDDEN, "title")}
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([\w-]+)")
_HREF = re.compile(r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_CHARSET = re.compile(rb"(?i)charset\s*=\s*[\"']?\s*([\w.:-]{1,40})")


@dataclass
class Page:
    """What a page shows and says of itself. text: a line for each block with text, white space collapsed, entities decoded."""

    text: str = ""
    title: str | None = None
    language: str | None = None
    links: tuple[str, ...] = ()


def read_page(page: str) -> Page:
    """Comments, scripts and styles are skipped whole, to the end of the page if they aren't closed; a `<` that no `>` follows is text."""
    out, links, found, at, hidden = [], [], Page(), 0, None  # hidden: the element whose end the text waits for
    last = page.rfind(">")
    titled = False
    while (i := page.find("<", at)) >= 0 and i < last:
        if hidden is None:
            out.append(page[at:i].replace("\n", " "))
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = end + 3 if end >= 0 else len(page)
            if hidden is None:
                out.append(" ")
            continue
        name = _NAME.match(page, i + 1)
        if name is None and page[i + 1 : i + 2] != "!":
            if hidden is None:
                out.append("<")
            at = i + 1
            continue
        end = page.find(">", i + 1)
        at = end + 1
        if name is None:
            continue
        tag, closing = name[1].lower(), page[i + 1] == "/"
        if hidden is not None:
            if closing and tag == hidden and not page[name.end() : end].strip():
                hidden = None
                continue
        elif tag in HIDDEN and not closing:
            out.append(" ")
            if tag not in RAW:
                hidden = tag
        if closing:
            if hidden is None and tag in BLOCKS:
                out.append("\n")
            continue
        if tag in RAW:
            close = _CLOSE[tag].search(page, at)
            at = close.end() if close else len(page)
        elif tag == "title" and not titled:
            titled = True  # the first one counts, if it is closed
            close = _CLOSE[tag].search(page, at)
            found.title = _BLANKS.sub(" ", entities.unescape(page[at : close.start()]).replace("\n", " ")).strip() if close else None
        elif tag == "a":
            if href := _HREF.search(page, name.end(), end):
                links.append(entities.unescape(next(filter(None, href.groups()), "")))
        elif tag == "html" and found.language is None:
            lang = _LANG.search(page, name.end(), end)
            found.language = lang[1] if lang else None
        if hidden is None and tag in BLOCKS:
            out.append("\n")
    if hidden is None and at < len(page):
        out.append(page[at:].replace("\n", " "))
    lines = (_BLANKS.sub(" ", x).strip() for x in entities.unescape("".join(out)).split("\n"))
    found.text, found.links = "\n".join(x for x in lines if x), tuple(links)
    return found


def plain_text(page: str) -> str:
    return read_page(page).text


def decoded(head: str, body: bytes) -> str:
    """The page by the charset of its HTTP head, or else of its first two thousand bytes, or else UTF-8; bytes that don't fit are replaced."""
    for said in (next((h.encode() for h in head.split("\r\n") if h.lower().startswith("content-type:")), b""), body[:2048]):
        if named := _CHARSET.search(said):
            try:
                return body.decode(codecs.lookup(named[1].decode()).name, "replace")
            except (LookupError, UnicodeError):
                continue
    return body.decode("utf-8", "replace")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, chr(0).join(parts))}>"


def _head(body: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[x.split()[1]]) for c, x in zip(zip(*rows, strict=True), RECORD.split(", "), strict=True)], NAMES)


def _rows(df: DataFrame, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                rows = [r for x in b.slice(at, 200).to_pylist() for r in make(x)]
                if rows:
                    yield _batch(rows)

    return df.mapInArrow(run, RECORD)


def responses(pages: DataFrame, date: str | Column = DATE) -> DataFrame:
    """pages with page_id, url, html -> response records. date: when they were fetched, one for all or a column of pages."""

    def make(x: dict) -> list[tuple]:
        body = (x["html"] or "").encode()
        block = _head(body) + body
        payload = digest(body)
        i = record_id("response", str(x["page_id"]), x["url"] or "", payload)
        return [(x["page_id"], i, "response", x["url"], None, x["_date"], "application/http; msgtype=response", payload, digest(block), len(block), block)]

    return _rows(pages.select("page_id", "url", "html", (F.lit(date) if isinstance(date, str) else date).cast("string").alias("_date")), make)


def derive(records: DataFrame) -> DataFrame:
    """Response records -> a metadata and a conversion record of each. Other types give nothing."""

    def make(x: dict) -> list[tuple]:
        head, _, body = x["block"].partition(b"\r\n\r\n")
        head = head.decode("latin-1")
        page = read_page(decoded(head, body))
        text = page.text.encode()
        fields = [("refers-to-target-uri", x["target_uri"]), ("refers-to-date", x["warc_date"]), ("source-payload-digest", x["payload_digest"]), ("source-block-digest", x["block_digest"])]
        fields += [("source-" + k.strip().lower(), v.strip()) for k, _, v in (h.partition(":") for h in head.split("\r\n")[1:])]
        fields += [("source-status", head.split("\r\n")[0]), ("conversion", record_id("conversion", x["record_id"])), ("title", page.title), ("language", page.language)]
        fields += [("outlink", u) for u in page.links]
        block = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v is not None).encode()
        common = (x["target_uri"], x["record_id"], x["warc_date"])
        return [
            (x["page_id"], record_id("metadata", x["record_id"]), "metadata", *common, "application/warc-fields", x["payload_digest"], digest(block), len(block), block),
            (x["page_id"], record_id("conversion", x["record_id"]), "conversion", *common, "text/plain; charset=utf-8", x["payload_digest"], digest(text), len(text), text),
        ]

    return _rows(records.where(F.col("warc_type") == "response").select(*NAMES), make)


#: Our column of each named header field. The source's payload digest is not one of a derivative's own fields.
FIELDS = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "warc_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))


def save(records: DataFrame, path: str, gzip: bool = False) -> None:
    """WARC/1.1 files, one a partition, through Spark's writer."""
    lines = [F.lit("WARC/1.1")] + [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}: "), F.regexp_replace(F.col(c).cast("string"), r"[\r\n]", " "))) for k, c in FIELDS] + [F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"))]
    head = F.concat(F.array_join(F.array_compact(F.array(*lines)), "\r\n"), F.lit("\r\n\r\n"))
    records.select(F.concat(head.cast("binary"), F.col("block")).cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(path, compression="gzip" if gzip else "none")


def _inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, piece by piece; gzip members one after the other."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + step] for at in range(0, len(data), step))
        return
    at, member = 0, zlib.decompressobj(31)
    while at < len(data):
        piece = data[at : at + step]
        at += len(piece)
        while piece:
            yield member.decompress(piece)
            piece = member.unused_data
            if piece:
                member = zlib.decompressobj(31)


def _records(data: bytes) -> Iterator[tuple]:
    """A file's records in order. Of what is unpacked only the record at hand is held."""
    held, row, size = bytearray(), None, 0
    for piece in _inflated(data):
        held += piece
        at = 0
        while True:
            if row is None:
                start = held.find(b"WARC/1.", at)
                end = held.find(b"\r\n\r\n", start) if start >= 0 else -1
                if end < 0:
                    break
                named = dict(h.split(": ", 1) for h in held[start:end].decode().split("\r\n")[1:])
                at, size = end + 4, int(named["Content-Length"])
                row = {c: named.get(k) for k, c in FIELDS} | {"page_id": int(named["X-Page-Id"]) if "X-Page-Id" in named else None, "content_length": size}
            if len(held) - at < size:
                break
            row["block"] = bytes(held[at : at + size])
            yield tuple(row[n] for n in NAMES)
            at, row = at + size, None
        del held[:at]
    if row is not None:
        raise ValueError(f"the record {row['record_id']} is cut off")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files under path. A file, of 2 GB at most as it lies there, is read by one task, which unpacks it record by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                rows, size = [], 0
                for r in _records(raw.as_py()):
                    rows.append(r)
                    size += len(r[-1])
                    if size > 1 << 22:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derive(responses(table(spark, sf_dir, "pages")))
    return found.withColumn("block", F.col("block").cast("string"))


QUERIES = {"op6_warc_derivatives": op6_warc_derivatives}
SQL: dict[str, str] = {}
