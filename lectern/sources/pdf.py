"""Texts of a PDF's pages, for simple files: plain or deflated streams, fonts whose bytes are Latin letters.

Encrypted files, object streams and fonts with encodings of their own need a parser; it goes in as ``extract`` of ``read_pdfs``.
"""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj\b", re.DOTALL)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?[0-9.]+|[A-Za-z'\"*]+", re.DOTALL)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
GAP = -200  # thousandths of the font size, moved within a line, that stand for a space


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")
    body = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].endswith(b"\n") else ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.DOTALL)
    return body.decode("cp1252", "replace")


def _shown(content: bytes) -> str:
    """The text that a content stream shows, a line for each move to another one."""
    out, operands, within = [], [], False
    for token in TOKEN.findall(content):
        if token[:1] in b"(<":
            operands.append(_string(token))
        elif token in (b"[", b"]"):
            within = token == b"["
        elif token[:1] in b"-+.0123456789":
            number = float(token) if token.strip(b"+-.") else 0.0
            operands.append(" " if number < GAP else "") if within else operands.append(number)
        else:
            if token in (b"T*", b"'", b'"') or token in (b"Td", b"TD") and len(operands) > 1 and operands[-1] or token == b"BT":
                out.append("\n")
            if token in (b"Tj", b"TJ", b"'", b'"'):
                out.append("".join(x for x in operands if isinstance(x, str)))
            operands = []
    lines = "".join(out).split("\n")
    return "\n".join(x.rstrip() for x in lines).strip("\n")


def page_texts(data: bytes) -> list[str]:
    """The text of each page, in the order of the page tree; what isn't a PDF that this reads raises ``ValueError``."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise ValueError("not a PDF")
    if b"/Encrypt" in data:
        raise ValueError("encrypted PDF")
    objects = {int(m[1]): m[3] for m in OBJECT.finditer(data)}
    pages = [n for n, body in objects.items() if re.search(rb"/Type\s*/Page\b(?!s)", body)]
    if not pages:
        raise ValueError("no pages that can be read")
    order: list[int] = []

    def walk(n: int, depth: int = 0) -> None:
        kids = re.search(rb"/Kids\s*\[(.*?)\]", objects.get(n, b""), re.DOTALL)
        if n in pages:
            order.append(n)
        elif kids and depth < 50:
            for kid in REFERENCE.findall(kids[1]):
                walk(int(kid), depth + 1)

    for n, body in objects.items():
        if re.search(rb"/Type\s*/Pages\b", body) and b"/Parent" not in body:
            walk(n)
    texts = []
    for n in order or pages:
        contents = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", objects[n], re.DOTALL)
        parts = []
        for part in REFERENCE.findall(contents[1]) if contents else []:
            body = objects.get(int(part), b"")
            if stream := STREAM.search(body):
                parts.append(zlib.decompressobj().decompress(stream[1]) if b"FlateDecode" in body[: stream.start()] else stream[1])
        texts.append(_shown(b"\n".join(parts)))
    return texts
