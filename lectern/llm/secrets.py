"""Secret scans with structural confirmation.

Base kinds are found by pattern: ``assign`` (a credential's name, a separator, a value), ``access`` (access key ids) and
``hex`` (long lower-case hex runs). Further kinds are reported only if their bytes parse:

* ``jwt``: three base64url segments, the first a JSON object with ``alg``, the second a JSON object (signed-token headers);
* ``der``: base64 or hex that decodes to an ASN.1 SEQUENCE whose nested lengths add up exactly, and that has the layout of
  a private or public key (version or algorithm, then integers, octets or bits);
* ``ssh``: base64 that decodes to length-prefixed fields, as many as the SSH key type that the first names has, or to an OpenSSH
  private key whose fields fill it;
* ``pem``: an armoured block whose label ends in KEY and whose body decodes to one of the two above, or has the headers of an
  encrypted key (cipher and vector) and whole blocks of that cipher;
* ``jwe``: five base64url segments, the first a JSON object with ``alg`` and ``enc``, with a vector and tag of valid lengths.

A key may start anywhere, after any prefix, and run over several lines: its first bytes say how long it is, and just that much is
decoded and parsed. Tokens are tried at the start of every segment. Texts without such starts cost one pass.

Defined results: null counts as empty; a text without secrets has zeros and an empty list; repeated rows are scanned each;
extra columns are ignored. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import map_batches, table

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "pem", "jwe")
BASE_KINDS = KINDS[:3]

LONG = re.compile(r"[A-Za-z0-9+/_.=-]{24,}")
# By lookahead, so that a token is tried at the start of every segment.
SEGMENT = r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{8,})\."
JWT = re.compile(SEGMENT + r"([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*))")
JWE = re.compile(SEGMENT + r"([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]{16,22})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]{16,43})(?![A-Za-z0-9_-]))")
# Base64 of a key's first bytes: a SEQUENCE, the length and first letters of an SSH key type, an OpenSSH private key.
START = re.compile(r"M(?=[A-P][A-Za-z0-9+/_-]{14})|A(?=AAA(?:[BC]3NzaC1|E2VjZHNh|GnNrLXNz|InNrLWVj))|b(?=3BlbnNzaC1rZXktdjEA)")
PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
BREAK = re.compile(r"[ \t]*\r?\n[ \t]*")
ANY_HEX = re.compile(r"[0-9a-f]{48,}|[0-9A-F]{48,}")
ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*KEY)-----")
HEADER = re.compile(r"([A-Za-z-]+):[ \t]*(.*)")
MAGIC = b"openssh-key-v1\0"

#: The longest SSH key looked for, in base64; longer ones are no keys.
SSH_CHARS = 1 << 16

# Fields of a public key by its type; bytes in a block by cipher.
SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3, b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4}
BLOCKS = {"AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16, "DES-CBC": 8, "DES-EDE3-CBC": 8}

INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def decode_base64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of consecutive elements that fill ``data`` exactly; None if any length doesn't."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > len(data) or data[at] == 0:
                return None
            n, at = int.from_bytes(data[at : at + size], "big"), at + size
            if n < 0x80:
                return None  # DER has the shortest form
        if at + n > len(data):
            return None
        items.append((tag, data[at : at + n]))
        at += n
    return items


def is_der_key(data: bytes | None) -> bool:
    if not data or data[0] != SEQUENCE:
        return False
    outer = der_items(data)
    inner = der_items(outer[0][1]) if outer and len(outer) == 1 else None
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _ in inner]
    algorithm = lambda x: x[0] == SEQUENCE and bool(i := der_items(x[1])) and i[0][0] == OID
    if tags[0] == SEQUENCE:  # public key (algorithm, bits) or an encrypted private key (algorithm, octets)
        return len(inner) == 2 and algorithm(inner[0]) and tags[1] in (BITS, OCTETS)
    if tags[0] != INTEGER or not inner[0][1]:
        return False
    if all(t == INTEGER for t in tags):  # RSA: modulus and exponent, or version and the eight numbers; DSA: six
        return len(tags) in (2, 6, 9) and max(len(c) for _, c in inner) >= 16
    if tags[1] == OCTETS:  # EC private key
        return inner[0][1] == b"\x01" and len(inner[1][1]) >= 16
    return len(tags) >= 3 and algorithm(inner[1]) and tags[2] == OCTETS  # PKCS 8


def _fields(data: bytes, at: int, n: int) -> tuple[list[bytes], int] | None:
    """``n`` length-prefixed fields from ``at``, and where they end."""
    found = []
    for _ in range(n):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        found.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return found, at


def is_ssh_key(data: bytes | None) -> bool:
    return bool(data) and ssh_size(data) == len(data)


def ssh_size(data: bytes) -> int:
    """The bytes of the SSH key that ``data`` starts with; 0 if it doesn't start with one."""
    if data.startswith(MAGIC):
        head = _fields(data, len(MAGIC), 3)  # cipher, derivation and its options, then the number of keys
        count = int.from_bytes(data[head[1] : head[1] + 4], "big") if head else 0
        keys = _fields(data, head[1] + 4, count + 1) if head and 1 <= count <= 16 else None
        return keys[1] if keys and all(is_ssh_key(k) for k in keys[0][:-1]) and keys[0][-1] else 0
    first = _fields(data, 0, 1)
    found = _fields(data, 0, SSH_FIELDS[first[0][0]]) if first and first[0][0] in SSH_FIELDS else None
    return found[1] if found and all(found[0]) else 0


def der_size(head: bytes) -> int:
    """The bytes of a SEQUENCE by its first bytes; 0 if it can't be a key."""
    if len(head) < 6 or head[0] != SEQUENCE:
        return 0
    size = head[1] & 0x7F if head[1] & 0x80 else 0
    if size > 3 or head[2 + size] not in (INTEGER, SEQUENCE):
        return 0
    return 2 + size + (int.from_bytes(head[2 : 2 + size], "big") if size else head[1])


def _json_object(segment: str) -> dict | None:
    data = decode_base64(segment)
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_jwt(header: str, payload: str) -> bool:
    head = _json_object(header)
    return head is not None and isinstance(head.get("alg"), str) and _json_object(payload) is not None


def is_jwe(parts: tuple[str, ...]) -> bool:
    head, (key, vector, body, tag) = _json_object(parts[0]), map(decode_base64, parts[1:])
    known = head is not None and isinstance(head.get("alg"), str) and isinstance(head.get("enc"), str)
    return known and key is not None and bool(body) and len(vector or b"") in (12, 16) and len(tag or b"") in (16, 24, 32)


def _wrapped(text: str, start: int, chars: int) -> tuple[str, int]:
    """Up to so many base64 characters from ``start``, over line ends, and where they end."""
    found, n = [], 0
    while n < chars and (piece := PIECE.match(text, start, start + chars - n)):
        found.append(piece[0])
        n, end = n + len(piece[0]), piece.end()
        gap = BREAK.match(text, end)
        if not gap:
            break
        start = gap.end()
    return "".join(found), end if found else start


def key_at(text: str, start: int) -> tuple[int, str] | None:
    """(end, kind) of the key whose base64 starts at ``start``: its own lengths say where it ends."""
    if text[start] == "M":
        need, kind = der_size(decode_base64(_wrapped(text, start, 12)[0]) or b""), "der"
    else:
        kind, need = "ssh", 0
        for chars in (64, 1 << 10, 1 << 13, SSH_CHARS):  # more of it, until its fields are there
            body, _ = _wrapped(text, start, chars)
            data = decode_base64(body[: len(body) - (len(body) % 4 == 1)]) or b""
            need = ssh_size(data)
            first = _fields(data, 0, 1)
            if need or len(body) < chars or not (data.startswith(MAGIC) or first and first[0][0] in SSH_FIELDS):
                break
    chars = -(-need * 4 // 3)
    body, end = _wrapped(text, start, chars) if need else ("", start)
    if not need or len(body) < chars or not (is_der_key if kind == "der" else is_ssh_key)(decode_base64(body)):
        return None
    while chars % 4 and text[end : end + 1] == "=":
        chars, end = chars + 1, end + 1
    return end, kind


def _armoured(text: str) -> Iterator[tuple[int, int]]:
    """Spans of armoured blocks whose body is a key."""
    marks = list(ARMOUR.finditer(text))
    for m, n in zip(marks, marks[1:], strict=False):
        if (m[1], n[1]) != ("BEGIN", "END") or m[2] != n[2]:
            continue
        headers, body = {}, []
        for line in map(str.strip, text[m.end() : n.start()].splitlines()):
            if h := HEADER.fullmatch(line):
                headers[h[1].lower()] = h[2]
            else:
                body.append(line)
        data = decode_base64("".join(body))
        cipher, _, vector = headers.get("dek-info", "").partition(",")
        block = BLOCKS.get(cipher.strip().upper(), 0) if headers.get("proc-type", "").replace(" ", "") == "4,ENCRYPTED" else 0
        if is_der_key(data) or is_ssh_key(data) or data and block and len(data) % block == 0 and re.fullmatch(rf"[0-9A-Fa-f]{{{2 * block}}}", vector.strip()):
            yield m.start(), n.end()


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    armoured = list(_armoured(text)) if "-----BEGIN " in text else []
    found += [(a, b, "pem") for a, b in armoured]
    keys: list[tuple[int, int]] = list(armoured)
    for run in LONG.finditer(text):
        at, part = run.start(), run.group()
        found += [(at + m.start(), at + m.end(), "hex") for m in HEX.finditer(part) if m.end() - m.start() >= 24]
        if "." in part:
            last = 0
            tokens = [(m.start(), m.end(3), "jwt") for m in JWT.finditer(part) if is_jwt(m[1], m[2])]
            tokens += [(m.start(), m.end(5), "jwe") for m in JWE.finditer(part) if is_jwe(m.groups())]
            for a, b, kind in sorted(tokens):
                if a >= last:
                    last = b
                    found.append((at + a, at + b, kind))
        for m in ANY_HEX.finditer(part):
            last = 0
            for s in re.finditer("30", m[0]):
                size = 2 * der_size(bytes.fromhex(m[0][s.start() : s.start() + 12])) if s.start() >= last and s.start() + 12 <= len(m[0]) else 0
                if size and s.start() + size <= len(m[0]) and is_der_key(bytes.fromhex(m[0][s.start() : s.start() + size])):
                    last = s.start() + size
                    keys.append((at + m.start() + s.start(), at + m.start() + last))
                    found.append((*keys[-1], "der"))
    last, keys = 0, sorted(keys)
    for m in START.finditer(text):
        i = bisect.bisect(keys, (m.start(), len(text)))
        if m.start() >= last and not (i and keys[i - 1][1] > m.start()) and (key := key_at(text, m.start())):
            last = key[0]
            found.append((m.start(), *key))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``id_col`` and ``found``, an array of (start, end, kind)."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(t.as_py() or "")] for t in batch.column(1)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "found": pa.array(found, kind)})

    rows = df.select(id_col, text_col)
    return map_batches(rows, each, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, found array<struct<start: long, end: long, kind: string>>")


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, lists and the digest of ``find_secrets`` rows."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [[(s["start"], s["end"], s["kind"]) for s in x] for x in batch.column(1).to_pylist()]
        count = lambda kind: pa.array([sum(s[2] == kind for s in r) for r in rows], pa.int64())
        base = [hashlib.sha256(listed([s for s in r if s[2] in BASE_KINDS]).encode()).hexdigest() for r in rows]
        yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"), "base_sha256": pa.array(base, pa.string()), "spans": pa.array(map(listed, rows), pa.string())})

    return map_batches(df, each, f"`{id_col}` {df.schema[0].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")))


def _sql_spans(kind: str, pattern: str, keep: str) -> str:
    """(doc_id, start, end, kind) of a pattern's matches: what stands between them says where they are. ``m`` is a match."""
    return f"""
SELECT doc_id, s AS start_, s + length(m) AS end_, '{kind}' AS kind, {KINDS.index(kind)} AS rank FROM (
  SELECT doc_id, unnest(found) AS m, unnest(list_transform(range(1, len(found) + 1), lambda i: CAST(list_sum(list_transform(between[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1 : i - 1], lambda x: length(x))), 0) AS BIGINT))) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS between FROM texts)
) WHERE {keep}"""


_SQL_NAME = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_SQL_LEAD = _SQL_NAME + """["'']?\\x20*[:=]\\x20*["'']?"""

#: The base kinds only. On the stored tables, which hold no others (as the tests check), these are all spans.
ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_sql_spans("assign", _SQL_LEAD + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(m, '^{_SQL_LEAD}', '')) >= 6")}
  UNION ALL {_sql_spans("access", "AKIA[A-Z0-9]+", "length(m) >= 20")}
  UNION ALL {_sql_spans("hex", "[0-9a-f]{24,}", "true")}),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, rank) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""
