"""WARC derivative builder: response records to linked metadata and plain-text conversion records.

For each page a response record is framed (its HTTP block, digests and a record id that depends only on page, address
and content); from it follow
- a metadata record: JSON with the record's and the HTTP headers, title, links and digests, and
- a conversion record: the page's plain text,
both of which name the response by WARC-Refers-To and WARC-Refers-To-Target-URI, and the warcinfo
record of their derivative file by WARC-Warcinfo-ID. Every page is built on its own in one pass, with
no exchange. Pages are stored without their HTTP status and headers, so these are constructed (200, type and
length). ``write_warc`` stores records as gzip members, one file a task, and ``read_warc`` streams such
files back, one record at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import arrow_map, column, materialize, new_path

#: Pages have no capture time; derivatives carry the one their caller gives.
CAPTURED = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122 name space for URLs

RECORD = (
    "page_id long, record_type string, record_id string, refers_to string, warcinfo_id string, target_uri string, warc_date string, "
    "content_type string, block_digest string, payload_digest string, content_length long, block string"
)
_NAMES = [c.split()[0] for c in RECORD.split(", ")]
_TYPES = [pa.int64() if c.split()[1] == "long" else pa.string() for c in RECORD.split(", ")]

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9]*\b")
_STOP = re.compile(r"[>\"']")
#: Elements whose content isn't text.
_HIDDEN = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template")}
_END_TITLE = re.compile(r"</title\s*>", re.I)
#: Elements that begin a new line of text.
_BLOCK = frozenset(
    "address article aside blockquote br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html body head title li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
_HREF = re.compile(r"\b(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_LANG = re.compile(r"[\w-]+")
_GAPS = re.compile(r"[ \t\r\f\v ]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(parts))}>"


class Tag(NamedTuple):
    """A tag, comment or hidden element of a page: where it lies, its name (empty for comments) and what follows the name."""

    start: int
    end: int
    name: str
    rest: str
    hidden: bool


def tags(page: str) -> Iterator[Tag]:
    """The markup of a page in order, in one pass over it.

    A tag ends at the first ``>`` outside quotes; a quote that is never closed is no quote. Once a tag has no such end,
    quotes count no more, and without any further ``>`` the rest of the page is text, so nothing is read twice.
    """
    at, quotes = 0, True
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield Tag(at, end, "", "", False)
            at = end
            continue
        named = _NAME.match(page, at + 1)
        if not named and page[at + 1 : at + 2] not in ("!", "?"):
            at += 1
            continue
        first = page.find(">", at + 1)
        if first < 0:
            return
        close = first
        if named and quotes:
            close = _tag_end(page, named.end())
            if close < 0:
                close, quotes = first, False
        name = named.group().lower() if named else ""
        if name in _HIDDEN:
            over = _HIDDEN[name].search(page, first + 1)
            end = over.end() if over else len(page)
            yield Tag(at, end, name, page[named.end() : first], True)
        else:
            end = close + 1
            yield Tag(at, end, name, page[named.end() : close] if named else "", False)
        at = end


def _tag_end(page: str, at: int) -> int:
    while stop := _STOP.search(page, at):
        if stop.group() == ">":
            return stop.start()
        closed = page.find(stop.group(), stop.end())
        at = stop.end() if closed < 0 else closed + 1
    return -1


def plain_text(page: str, markup: list[Tag] | None = None) -> str:
    """The text a reader sees: no scripts, styles or comments, block elements on lines of their own.

    ``markup`` is what ``tags`` gives for the page, here and below, where it is at hand.
    """
    parts, at = [], 0
    for tag in tags(page) if markup is None else markup:
        parts += [page[at : tag.start], " " if tag.hidden else "\n" if tag.name.lstrip("/") in _BLOCK else ""]
        at = tag.end
    parts.append(page[at:])
    lines = (_GAPS.sub(" ", x).strip() for x in entities.unescape("".join(parts)).split("\n"))
    return "\n".join(x for x in lines if x)


def links(page: str, base: str, markup: list[Tag] | None = None) -> list[dict[str, str]]:
    """Addresses that tags of the page name, in order, made absolute."""
    out = []
    for tag in tags(page) if markup is None else markup:
        if tag.rest and not tag.hidden:
            for a in _HREF.finditer(tag.rest):
                value = entities.unescape(next(g for g in a.groups()[1:] if g is not None))
                try:
                    url = urljoin(base, value)
                except ValueError:
                    url = value
                out.append({"path": f"{tag.name.upper()}@/{a.group(1).lower()}", "url": url})
    return out


def title(page: str, markup: list[Tag] | None = None) -> str | None:
    """The text of the first title element, if it is closed."""
    for tag in tags(page) if markup is None else markup:
        if tag.name == "title":
            over = _END_TITLE.search(page, tag.end)
            return plain_text(page[tag.end : over.start()]) if over else None
    return None


def language(page: str, markup: list[Tag] | None = None) -> str | None:
    """The lang (or xml:lang) attribute of the first html tag, or else of the first tag that has one, wherever in the page it is."""
    first = None
    for tag in tags(page) if markup is None else markup:
        if tag.hidden or not tag.rest or tag.name.startswith("/") or first and tag.name != "html":
            continue
        found = next((a for a in _ATTRIBUTE.finditer(tag.rest) if a.group(1).lower() in ("lang", "xml:lang")), None)
        value = _LANG.match(next((g for g in found.groups()[1:] if g is not None), "")) if found else None
        if value and tag.name == "html":
            return value.group()
        first = first or (value.group() if value else None)
    return first


def http_block(page: str) -> tuple[bytes, bytes, dict[str, str]]:
    """The HTTP message of a stored page: whole block, payload and headers.

    Pages are stored without status and headers, so both are constructed: 200, the type and the length of the page.
    """
    payload = page.encode("utf-8", "surrogatepass")
    headers = {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))}
    head = "HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    return head.encode() + payload, payload, headers


def derive(page_id: int | None, url: str | None, page: str | None, captured: str = CAPTURED, file: str = "corpus") -> list[tuple]:
    """The response, metadata and conversion rows of one page."""
    url, page = url or "", page or ""
    block, payload, headers = http_block(page)
    block_digest, payload_digest = digest(block), digest(payload)
    source = record_id("response", str(page_id), url, payload_digest)
    info = record_id("warcinfo", file, captured)
    markup = list(tags(page))
    found = {
        "WARC-Header-Metadata": {"WARC-Type": "response", "WARC-Record-ID": source, "WARC-Target-URI": url, "WARC-Date": captured, "WARC-Block-Digest": block_digest, "WARC-Payload-Digest": payload_digest, "Content-Length": str(len(block))},
        "HTTP-Response-Metadata": {"Status": 200, "Headers": headers, "Entity-Digest": payload_digest, "Entity-Length": len(payload)},
        "HTML-Metadata": {"Title": title(page, markup), "Language": language(page, markup), "Links": links(page, url, markup)},
    }
    text, meta = plain_text(page, markup), json.dumps(found, ensure_ascii=False, separators=(",", ":"))
    rows = [(page_id, "response", source, None, info, url, captured, "application/http; msgtype=response", block_digest, payload_digest, len(block), None)]
    for kind, mime, body in (("metadata", "application/json", meta), ("conversion", "text/plain", text)):
        data = body.encode("utf-8", "surrogatepass")
        rows.append((page_id, kind, record_id(kind, source), source, info, url, captured, mime, digest(data), digest(data), len(data), body))
    return rows


def build_derivatives(pages: DataFrame, captured: str = CAPTURED, file: str = "corpus") -> DataFrame:
    """Three rows for each page (page_id, url, html): its response, metadata and conversion record.

    The response row carries headers and digests, not the page again. A null page is an empty one, a null address the
    empty address; repeated rows give equal records; an empty table gives none. A very long page is scanned in one pass over its markup. Other
    columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, texts = (column(batch, c) for c in ("page_id", "url", "html"))
            for i in range(0, len(ids), 256):
                rows = [r for x in zip(ids[i : i + 256], urls[i : i + 256], texts[i : i + 256], strict=True) for r in derive(*x, captured, file)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    return arrow_map(pages.select("page_id", "url", "html"), run, RECORD)


def frame_record(row: dict) -> bytes:
    """One WARC/1.0 record as a gzip member of its own; a block that doesn't have its digest is refused."""
    block = (row["block"] or "").encode("utf-8", "surrogatepass")
    if digest(block) != row["block_digest"]:
        raise ValueError(f"the block of {row['record_id']} isn't the one its digest is of")
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["warc_date"]),
        ("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Refers-To-Target-URI", row["target_uri"] if row["refers_to"] else None), ("WARC-Warcinfo-ID", row["warcinfo_id"]),
        ("WARC-Block-Digest", row["block_digest"]), ("Content-Type", row["content_type"]), ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return gzip.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", 6, mtime=0)


def info_record(name: str, kind: str, date: str) -> dict:
    """The warcinfo record that heads a file; its id follows from the file's name."""
    block = f"software: probity\r\nformat: WARC File Format 1.0\r\nfilename: {name}\r\ndescription: {kind} records derived from stored pages\r\n"
    return {
        "record_type": "warcinfo", "record_id": record_id("warcinfo", name), "warc_date": date, "target_uri": None, "refers_to": None, "warcinfo_id": None,
        "block": block, "block_digest": digest(block.encode()), "content_type": "application/warc-fields",
    }


def write_warc(records: DataFrame, kind: str, folder: str | None = None) -> DataFrame:
    """Write all ``kind`` records (metadata or conversion); returns the manifest: file, records, folder.

    Each file begins with a warcinfo record of its own, which its other records name; the count is of those others. Response rows
    carry no block (see ``build_derivatives``), so they can't be written from it.
    """
    if kind == "response":
        raise ValueError("response rows carry headers and digests only; write metadata or conversion records")
    folder = folder or new_path(records.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        name, n, out = f"{kind}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    info = info_record(name, kind, row["warc_date"])
                    out.write(frame_record(info))
                out.write(frame_record(row | {"warcinfo_id": info["record_id"]}))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    manifest = materialize(arrow_map(records.where(F.col("record_type") == kind), run, "file string, records long"), "warc-manifest")
    return manifest.withColumn("folder", F.lit(folder))


def parse_warc(source: BinaryIO, piece: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in a file of gzip members, read ``piece`` bytes at a time; one record is held."""
    member, raw, data = zlib.decompressobj(31), [], b""
    while data or (data := source.read(piece)):
        raw.append(member.decompress(data))
        data = member.unused_data
        if member.eof:
            head, _, rest = b"".join(raw).partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
            yield headers, rest[: int(headers["Content-Length"])]
            member, raw = zlib.decompressobj(31), []
    if raw and any(raw):
        raise ValueError("the file ends inside a record")


_BACK = "record_id string, record_type string, refers_to string, target_uri string, block string"


def read_warc(manifest: DataFrame) -> DataFrame:
    """record_id, record_type, refers_to, target_uri, block of all records but the files' own in the manifest's files, one task a file at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for folder, name in zip(column(batch, "folder"), column(batch, "file"), strict=True):
                store, base = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for h, block in parse_warc(f):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        rows.append((h["WARC-Record-ID"], h["WARC-Type"], h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), block.decode("utf-8", "surrogatepass")))
                        held += len(block)
                        if len(rows) == 1024 or held > 1 << 25:
                            yield _back(rows)
                            rows, held = [], 0
                if rows:
                    yield _back(rows)

    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(manifest.select("folder", "file").repartition(files, "file"), run, _BACK)


def _back(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in _BACK.split(", ")])
