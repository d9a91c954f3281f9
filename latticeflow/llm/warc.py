"""WARC derivatives: linked metadata and plain-text conversion records of response records.

Each response yields a ``metadata`` record (JSON: the source's WARC and HTTP headers, title, meta tags and links) and
a ``conversion`` record (UTF-8 plain text). Both name the response in ``WARC-Refers-To`` and keep its target URI, date
and payload digest; each has a block digest of its own. Record ids are name-based, so that a repeated or recovered
run gives the same records. Nothing is shuffled.

Defined results: a null or empty block gives records with empty text; a null URI, date or header map is left out of
the headers; a block without an HTTP head is all payload; chunked, gzip and deflate payloads are undone for the text and
the links, other codings are not; bytes that the charset doesn't know become U+FFFD; repeated
rows give repeated records with equal ids; an empty table gives an empty result; other columns are ignored.
Of files: header names go by their lower case (kept as the standard writes them); lines that go on with a blank belong to
the one before; a record that ends before its length, or within its head, is kept as far as it goes and has
``WARC-Truncated: length`` added; one with a length that goes over the next ones takes them in; a record with no length or
one that isn't a number ends where the next one begins; what is no record at all is skipped.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import cut, map_batches, map_rows, struct_of

RESPONSES = "page_id long, record_id string, target_uri string, warc_date string, headers map<string,string>, block binary"
RECORDS = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, headers map<string,string>, block string"

_PARTS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg)\b(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*|[!?])((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][-a-zA-Z0-9:_]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Elements that begin and end a line. Fixed values.
_BLOCKS = frozenset("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src"}
#: The header names that the module reads, as the standard writes them, by lower case. Fixed values.
_NAMES = {x.lower(): x for x in "WARC-Type WARC-Record-ID WARC-Date WARC-Target-URI WARC-Payload-Digest WARC-Block-Digest WARC-Refers-To WARC-Concurrent-To WARC-Truncated Content-Length Content-Type".split()}
#: What a record begins with, and what says so of the rest.
_MARK, _VERSION = "WARC/", re.compile(rb"[0-9]+\.[0-9]+\r?\n(?=[!-9;-~]+[ \t]*:)")
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")


def digest(data: bytes) -> str:
    return f"sha1:{base64.b32encode(hashlib.sha1(data).digest()).decode()}"


def name_of(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {source}')}>"


def http_parts(block: bytes) -> tuple[str, dict[str, str | list[str]], bytes]:
    """Status line, headers (lower-case names; a list of the values of a name that comes again) and payload."""
    if not block.startswith(b"HTTP/"):
        return "", {}, block
    head, payload = _head(block)
    first, _, lines = head.partition("\n")
    every: dict[str, list[str]] = {}
    for name, value in _fields(lines):
        every.setdefault(name.lower(), []).append(value)
    return first.rstrip("\r"), {k: v[0] if len(v) == 1 else v for k, v in every.items()}, payload


def _head(data: bytes) -> tuple[str, bytes]:
    """The lines up to the first empty one, and what follows it."""
    end = _HEAD_END.search(data)
    return (data[: end.start()].decode("utf-8", "replace"), data[end.end() :]) if end else (data.decode("utf-8", "replace"), b"")


def _fields(lines: str) -> Iterator[tuple[str, str]]:
    """Names and values of header lines; lines without a colon are skipped."""
    for line in re.sub(r"\r?\n[ \t]+", " ", lines).splitlines():
        name, colon, value = line.partition(":")
        if colon and name.strip():
            yield name.strip(), value.strip()


def _values(headers: dict[str, str | list[str]], name: str) -> list[str]:
    found = headers.get(name, [])
    return [found] if isinstance(found, str) else found


def _unchunked(payload: bytes) -> bytes:
    """The data of a chunked payload; what isn't chunked, as crawlers often store it, stays."""
    out, at = [], 0
    while (end := payload.find(b"\r\n", at)) >= 0:
        size = payload[at:end].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            break
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(payload[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out) if out else payload


def _inflated(payload: bytes) -> bytes:
    """The content of a gzip or deflate payload, as far as it goes; what isn't one stays."""
    for bits in (47, -15):  # gzip or zlib by its head, then bare deflate
        out, rest = [], payload
        try:
            while rest:
                part = zlib.decompressobj(bits)
                out.append(part.decompress(rest))
                rest = part.unused_data if part.eof and bits == 47 else b""
        except zlib.error:
            pass
        if any(out):
            return b"".join(out)
    return payload


def content(payload: bytes, headers: dict[str, str | list[str]]) -> bytes:
    """The payload without its transfer and content codings (chunked, gzip, deflate)."""
    codings = [x.strip().lower() for name in ("content-encoding", "transfer-encoding") for v in _values(headers, name) for x in v.split(",")]
    for coding in reversed(codings):
        if coding == "chunked":
            payload = _unchunked(payload)
        elif coding in ("gzip", "x-gzip", "deflate"):
            payload = _inflated(payload)
    return payload


def decoded(payload: bytes, headers: dict[str, str | list[str]]) -> str:
    charset = re.search(r"charset=[\"']?([-\w]+)", ", ".join(_values(headers, "content-type")))
    payload = content(payload, headers)
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def extract(page: str) -> tuple[str, dict]:
    """The plain text of a page, and its title, meta tags and links."""
    pieces, found, at, title = [], {"title": "", "metas": [], "links": []}, 0, None
    for m in _PARTS.finditer(page):
        pieces.append(page[at : m.start()])
        at = m.end()
        close, name, attributes = m[2], (m[3] or m[1] or "").lower(), m[4]
        if name in _BLOCKS:
            pieces.append("\n")
        if name == "title":
            if close and title is not None:
                found["title"] = found["title"] or " ".join(html.unescape(page[title : m.start()]).split())
            title = None if close else m.end()
        if not close and (name in _LINKS or name == "meta"):
            raw = attributes if attributes is not None else m[0].partition(">")[0]
            own = {k.lower(): html.unescape("".join(v)) for k, *v in _ATTRIBUTE.findall(raw)}
            if name == "meta":
                found["metas"].append(own)
            elif _LINKS[name] in own:
                found["links"].append({"path": f"{name.upper()}@/{_LINKS[name]}", "url": own[_LINKS[name]]})
    pieces.append(page[at:])
    text = _SPACE.sub(" ", html.unescape("".join(pieces)))
    return _LINES.sub("\n", text).strip(), found


def responses_from_pages(pages: DataFrame, *, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records for a table of ``page_id``, ``url`` and ``html``, as a crawler would have stored them."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def make():
        def work(batch):
            out = {k: [] for k in ("page_id", "record_id", "target_uri", "warc_date", "headers", "block")}
            for page, url, text in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                payload = (text or "").encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                record = name_of("response", f"{page} {url}")
                head = {"WARC-Type": "response", "WARC-Record-ID": record, "WARC-Date": date, "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
                if url is not None:
                    head["WARC-Target-URI"] = url
                for k, v in (("page_id", page), ("record_id", record), ("target_uri", url), ("warc_date", date), ("headers", [*head.items()]), ("block", block)):
                    out[k].append(v)
            yield out

        return work

    return map_rows(rows, RESPONSES, make)


def derive(responses: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response."""
    given_columns = ("page_id", "record_id", "target_uri", "warc_date", "headers", "block")
    rows = responses.select(*given_columns)

    def make():
        names = [x.split(" ")[0] for x in re.split(r", (?!string>)", RECORDS)]

        def work(batch):
            out = {k: [] for k in names}
            for page, source, uri, date, given, block in zip(*(batch.column(c).to_pylist() for c in given_columns), strict=True):
                headers = {k: v for k, v in given or () if v is not None}
                status, http, payload = http_parts(block or b"")
                source = source or name_of("response", f"{page} {uri}")
                payload_digest = headers.get("WARC-Payload-Digest") or digest(payload)
                text, found = extract(decoded(payload, http))
                envelope = {"Envelope": {"WARC-Header-Metadata": headers, "Payload-Metadata": {"HTTP-Response-Metadata": {"Status": status, "Headers": http, "Payload-Digest": payload_digest, "HTML-Metadata": found}}}}
                for kind, media, content in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True)), ("conversion", "text/plain; charset=utf-8", text)):
                    raw = content.encode("utf-8", "replace")
                    own = {"WARC-Type": kind, "WARC-Record-ID": name_of(kind, source), "WARC-Refers-To": source, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": payload_digest, "WARC-Block-Digest": digest(raw), "Content-Type": media, "Content-Length": str(len(raw))}
                    row = (page, kind, own["WARC-Record-ID"], source, uri, date, media, len(raw), own["WARC-Block-Digest"], payload_digest, [(k, v) for k, v in own.items() if v is not None], raw.decode())
                    for k, v in zip(names, row, strict=True):
                        out[k].append(v)
            yield out

        return work

    return map_rows(rows, RECORDS, make)


def write_records(records: DataFrame, path: str, compression: str = "none") -> None:
    """``records`` as WARC files. A record ends with two line ends, which are the writer's line separator."""
    head = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\r\n")
    record = F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n\r\n"), F.coalesce("block", F.lit("")))
    records.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


class Records:
    """Puts records together from the pieces between marks; a mark within a line or a block joins what it parted."""

    def __init__(self) -> None:
        self.data = bytearray()
        self.open = False  # a record has begun
        self.headers: dict[str, str] | None = None  # once its head is complete
        self.size: int | None = None

    def add(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """What is complete now that ``piece`` follows a mark."""
        version = _VERSION.match(piece)
        short = self.size is not None and len(self.data) < self.size
        if self.open and (short or not version or not self.data.endswith(b"\n")):
            self.data += _MARK.encode() + piece
        else:
            yield from self.end()
            if not version:
                return
            self.open, self.data = True, bytearray(piece[version.end() :])
        if self.headers is None and (end := _HEAD_END.search(self.data)):
            self._read_head(bytes(self.data[: end.start()]))
            del self.data[: end.end()]

    def _read_head(self, head: bytes) -> None:
        self.headers = {}
        for name, value in _fields(head.decode("utf-8", "replace")):
            name = _NAMES.get(name.lower(), name)
            self.headers[name] = f"{self.headers[name]}, {value}" if name in self.headers else value
        length = self.headers.get("Content-Length", "").partition(",")[0].strip()
        self.size = int(length) if re.fullmatch("[0-9]{1,18}", length) else None

    def end(self, broken: bool = False) -> Iterator[tuple[dict[str, str], bytes]]:
        """The record at hand, which nothing follows."""
        if self.open:
            if self.headers is None:  # it broke off in its head
                self._read_head(bytes(self.data))
                self.data.clear()
                broken = True
            if broken or self.size is not None and len(self.data) < self.size:
                self.headers.setdefault("WARC-Truncated", "length")
            block = bytes(self.data)
            yield self.headers, (re.sub(rb"(\r?\n){1,2}\Z", b"", block) if self.size is None else block[: self.size])
        self.open, self.headers, self.data, self.size = False, None, bytearray(), None


def _unzipped(data: bytes) -> tuple[bytes, bool]:
    """The content of gzip members, as far as they go, and whether they end before their time."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            return b"".join(out), True
        if not member.eof:
            return b"".join(out), True
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out), False


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (the values of a repeated one joined by commas) and block of each record of a WARC file, plain or compressed."""
    broken = False
    if data[:2] == b"\x1f\x8b":
        data, broken = _unzipped(data)
    records = Records()
    for piece in data.split(_MARK.encode())[1:]:
        yield from records.add(piece)
    yield from records.end(broken)


def read_responses(spark: SparkSession, path: str, *, skip_broken_files: bool = False) -> DataFrame:
    """The response records of WARC files, with null ``page_id``.

    Spark's line reader reads them, with the mark of a record as the line's end: a compressed file (by its suffix) is
    inflated as it is read, a plain one falls into splits, and a task holds a batch of records. Names of folders that Spark
    skips (``_`` and ``.``) are skipped. A plain file whose record holds the mark right where a split ends yields that record
    truncated. A compressed file that breaks off fails the job; with ``skip_broken_files`` the records before the break stay
    (then a file that can't be read for any other reason is skipped too).
    """
    pieces = spark.read.option("ignoreCorruptFiles", skip_broken_files).text(path, lineSep=_MARK).select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("piece"))

    struct = struct_of(RESPONSES)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, file = Records(), None
        for batch in (part for whole in batches for part in cut(whole)):
            rows = []
            for name, piece in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if name != file:
                    rows += records.end()
                    file = name
                rows += records.add(piece or b"")
            yield _responses(rows, arrow)
        yield _responses([*records.end()], arrow)

    return map_batches(pieces, run, struct)


def _responses(records: list[tuple[dict[str, str], bytes]], arrow: pa.Schema) -> pa.RecordBatch:
    rows = [(h, b) for h, b in records if h.get("WARC-Type", "").lower() == "response"]
    columns = {
        "page_id": [None] * len(rows),
        "record_id": [h.get("WARC-Record-ID") for h, _ in rows],
        "target_uri": [h.get("WARC-Target-URI") for h, _ in rows],
        "warc_date": [h.get("WARC-Date") for h, _ in rows],
        "headers": [[*h.items()] for h, _ in rows],
        "block": [b for _, b in rows],
    }
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)
