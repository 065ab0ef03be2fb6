"""WARC derivatives: a metadata and a plain-text conversion record for each response.

Both refer to the response by its record id, repeat its target URI and date, and carry digests: of their own block, and of
the payload they were made from. The metadata block keeps the source's HTTP headers, and adds what the page says of itself
(title, language, charset, links). Record ids are name-based UUIDs of the response's id and the record's type, so a retried
or repeated run gives the same records.

Defined results: null HTML counts as an empty payload, and gives two records with an empty text; a null URI or date leaves its
header out; a null id is written as "null"; repeated pages give repeated records with the same ids; extra columns are
ignored. Chunked transfers and gzip or deflate codings are undone for text and links; digests are of the stored payload. Texts are
whole; bytes that aren't UTF-8 (nor the declared charset) become replacement characters.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from email.parser import BytesParser
from email.policy import compat32
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import map_batches, table

PIECE = 1 << 20
NAMESPACE = uuid.NAMESPACE_URL
CRAWLED = "2024-01-01T00:00:00Z"
RESPONSE = "page_id {key}, record_id string, target_uri string, date string, http_headers string, payload binary"
DERIVED = "page_id {key}, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_payload_digest string, block string"

# A tag stops at the next "<" outside quotes, so unclosed ones are cheap to give up.
TAG = re.compile(r"""<!--.*?-->|<(script|style|noscript|template|iframe|svg)\b(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>""", re.DOTALL | re.IGNORECASE)
HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.DOTALL | re.IGNORECASE)
LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", re.IGNORECASE)
CHARSET = re.compile(rb"""charset\s*=\s*["']?([A-Za-z0-9_.:-]+)""", re.IGNORECASE)
BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
SPACE = re.compile(r"[^\S\n]+")
BREAKS = re.compile(r" ?\n[ \n]*")


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def _unchunked(data: bytes) -> bytes:
    """The body of a chunked transfer; as it is if its first chunk isn't one, and up to the first that is broken."""
    out, at = [], 0
    while (line := data.find(b"\r\n", at)) >= 0:
        size = data[at:line].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            break
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(data[line + 2 : line + 2 + n])
        at = line + 4 + n
    return b"".join(out) or data


def entity(payload: bytes, headers: str) -> bytes:
    """What a payload stands for: without chunks and without compression, if its headers name these and they can be undone."""
    named = {k.strip().lower(): v.strip().lower() for k, _, v in (h.partition(":") for h in headers.splitlines())}
    if "chunked" in named.get("transfer-encoding", ""):
        payload = _unchunked(payload)
    for coding in reversed([c.strip() for c in named.get("content-encoding", "").split(",")]):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
            stream = zlib.decompressobj(bits)
            try:
                payload = stream.decompress(payload)
                break
            except zlib.error:
                continue
    return payload


def decode_payload(payload: bytes, headers: str) -> str:
    """By the charset of the headers or the page, else UTF-8."""
    payload = entity(payload, headers)
    found = CHARSET.search(headers.encode()) or CHARSET.search(payload, 0, 2048)
    try:
        return payload.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """Visible text; block elements break lines, scripts, styles and comments go."""
    mark = lambda m: "\n" if m[3] and m[3].lower() in BLOCKS else ("" if m[3] else " ")
    text = html.unescape(TAG.sub(mark, page.replace("\r\n", "\n").replace("\n", " ")))
    return BREAKS.sub("\n", SPACE.sub(" ", text)).strip()


def links(page: str, base: str | None) -> list[str]:
    found: dict[str, None] = {}
    for m in TAG.finditer(page):
        if m[3] in ("a", "A") and not m[2] and (h := HREF.search(m[4])):
            target = html.unescape(next(x for x in h.groups() if x is not None)).strip()
            if target and not target.lower().startswith("javascript:"):
                try:
                    found[urljoin(base or "", target)] = None
                except ValueError:  # a malformed address stays as written
                    found[target] = None
    return list(found)


def metadata_block(page: str, headers: str, uri: str | None) -> str:
    """``application/warc-fields`` about a response."""
    one_line = lambda x: " ".join(html.unescape(x).split())
    fields = [("source-header", h) for h in headers.splitlines() if h.strip()]
    if m := TITLE.search(page):
        fields.append(("title", one_line(m[1])))
    if m := LANG.search(page):
        fields.append(("language", m[1].lower()))
    fields += [("outlink", one_line(x)) for x in links(page, uri)]
    return "".join(f"{k}: {v}\r\n" for k, v in fields)


def page_responses(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", date: str = CRAWLED) -> DataFrame:
    """Response records of stored pages."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, uris = batch.column(0), batch.column(1).to_pylist()
        bodies = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
        names = [record_id(f"response:{i}:{u}") for i, u in zip(ids.to_pylist(), uris, strict=True)]
        heads = [f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(b)}\r\n" for b in bodies]
        yield pa.RecordBatch.from_pydict({"page_id": ids, "record_id": pa.array(names, pa.string()), "target_uri": pa.array(uris, pa.string()), "date": pa.array([date] * len(uris), pa.string()), "http_headers": pa.array(heads, pa.string()), "payload": pa.array(bodies, pa.binary())})

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(uri_col).cast("string"), html_col)
    return map_batches(rows, each, RESPONSE.format(key=rows.schema[0].dataType.simpleString()))


def derive(responses: DataFrame) -> DataFrame:
    """The metadata and conversion records of response records."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for r in batch.to_pylist():
            payload, headers = r["payload"] or b"", r["http_headers"] or ""
            page = decode_payload(payload, headers)
            source = sha1_digest(payload)
            for kind, mime, block in (("metadata", "application/warc-fields", metadata_block(page, headers, r["target_uri"])), ("conversion", "text/plain", plain_text(page))):
                data = block.encode("utf-8", "replace")
                rows.append((r["page_id"], kind, record_id(f"{kind}:{r['record_id']}"), r["record_id"], r["target_uri"], r["date"], mime, len(data), sha1_digest(data), source, data.decode()))
        columns = list(zip(*rows, strict=True))
        kinds = [batch.schema.field("page_id").type, *[pa.string()] * 6, pa.int64(), *[pa.string()] * 3]
        names = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "source_payload_digest", "block"]
        yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)})

    rows = responses.select("page_id", "record_id", "target_uri", "date", "http_headers", "payload")
    return map_batches(rows, each, DERIVED.format(key=rows.schema["page_id"].dataType.simpleString()))


def serialize(record: dict) -> bytes:
    """A derived record as WARC/1.1 bytes. Line ends and other control characters of a header's value are percent-encoded."""
    plain = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(v))
    data = record["block"].encode()
    head = [("WARC-Type", record["record_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Refers-To", record["refers_to"]), ("WARC-Target-URI", record["target_uri"]), ("WARC-Date", record["date"] or datetime(1970, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")), ("WARC-Block-Digest", record["block_digest"]), ("WARC-Source-Payload-Digest", record["source_payload_digest"]), ("Content-Type", record["content_type"]), ("Content-Length", len(data))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {plain(v)}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + data + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """One ``.warc.gz`` file a partition, a gzip member a record; rows ``path, records``. A retried task writes the same name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, n = f"derived-{TaskContext.get().partitionId():06d}.warc.gz", 0
        own = f"{root}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for record in batch.to_pylist():
                    out.write(gzip.compress(serialize(record), 6, mtime=0))
                    n += 1
        fs.move(own, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{name}"]), "records": pa.array([n], pa.int64())})

    return records.mapInArrow(run, "path string, records long")


def _expanded(data: bytes) -> Iterator[bytes]:
    """The bytes of a file, gzipped member by member or not, a piece at a time; a broken member ends them."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while at < len(data) and not member.eof:
            piece = data[at : at + PIECE]
            try:
                out = member.decompress(piece)
            except zlib.error:
                return
            at += len(piece) - len(member.unused_data)
            if out:
                yield out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a WARC file, gzipped or not; only one record is held at a time.

    A record starts where the one before ends; if none does, at the next line that starts like one. A cut-off record is the last,
    with what there is of it.
    """
    held, pieces = bytearray(), _expanded(data)

    def more() -> bool:
        held.extend(piece := next(pieces, b""))
        return bool(piece)

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        if len(held) < 5 and more():
            continue
        if not held.startswith(b"WARC/"):
            at = held.find(b"\nWARC/")
            del held[: at + 1 if at >= 0 else max(0, len(held) - 5)]
            if at < 0 and not more():
                return
            continue
        while (head := held.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        line = held.find(b"\r\n") + 2
        fields = {k.lower(): str(v).strip() for k, v in BytesParser(policy=compat32).parsebytes(bytes(held[line : head + 4]), headersonly=True).items()}
        length = fields.get("content-length", "")
        end = head + 4 + (int(length) if length.isdecimal() else 0)
        while len(held) < end and more():
            pass
        yield fields, bytes(held[head + 4 : end])
        del held[:end]


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, as ``derive`` takes them; ``page_id`` is the record id."""
    names = ["page_id", "record_id", "target_uri", "date", "http_headers", "payload"]

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array(c, pa.binary() if n == "payload" else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)})

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for content in batch.column(0):
            rows, size = [], 0
            for fields, block in parse(content.as_py()):
                if fields.get("warc-type") == "response":
                    head, _, payload = block.partition(b"\r\n\r\n")
                    rows.append((fields.get("warc-record-id"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), head.decode("latin-1"), payload))
                    size += len(payload)
                if size >= PIECE * 16:
                    yield rows_of(rows)
                    rows, size = [], 0
            if rows:
                yield rows_of(rows)

    return map_batches(spark.read.format("binaryFile").load(path).select("content"), each, RESPONSE.format(key="string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(page_responses(table(spark, sf_dir, "pages")))
