"""Substring dedup: suffix automata of reference shards, streamed documents, maximal spans removed.

A word goes if a window of ``window`` consecutive words that covers it also starts in a document with a smaller id. Broadcasting
every automaton to every document costs shards times documents, the square of the input (the README has it measured), so both
are routed:

1. Documents are dealt to batches (a bounded number of bytes each) once; later steps reuse that exchange.
2. Each window is represented by the smallest hash among the short grams inside it (its anchor), so equal windows have equal
   anchors. Batches send their distinct anchors, as packed sorted arrays, to hash buckets, and learn which are repeated.
3. Windows with a repeated anchor are sent likewise, with the smallest id of the batch that has them. Their buckets return
   the smallest id of all: the window's source.
4. Maximal runs of windows for which a document is the source are its reference passages. They go to the reference shard
   of that document; maximal runs of windows with a smaller source go to the shard of that source, as queries. Equal
   queries of one batch travel as one, with the list of where they occur.
5. Each shard builds a suffix automaton over words of its passages, with the smallest id for each state, and streams its
   queries for matching statistics. A match of at least ``window`` words whose state has a smaller id is a window to remove.
   So hashes only propose; words decide. (Two different windows would have to share a 64-bit hash to hide a match.)
6. The spans return to the batches, which apply them to the documents.

A hot passage is one entry a batch in every exchange. Nothing is dropped, and nothing but the total size reaches the driver.

Defined results: null counts as no words; documents with a null id are never compared; rows repeated with one id are not smaller
than each other; windows are judged on the input, not on what is left; extra columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import table

WINDOW = 13
# Batches and buckets grow with the root of the input, from some hundred GB on, so that what one sends to another stays worth a row.
BATCH_BYTES, MOST_BATCH_BYTES = 8 << 20, 256 << 20
BUCKET_BITS = 8
BUCKET_WINDOWS, MOST_BUCKET_WINDOWS = 4_000_000, 64_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
PACKED = "bucket int, batch int, payload binary"


class Automaton:
    """Suffix automaton over sequences of words, with the smallest id of the documents each state occurs in."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def _state(self, length: int, link: int, moves: dict[bytes, int], least) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.least.append(least)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A copy of q for its suffixes as short as p's continuation."""
        nxt, link = self.next, self.link
        clone = self._state(self.length[p] + 1, link[q], dict(nxt[q]), None)
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        link[q] = clone
        return clone

    def add(self, words: Iterable[bytes], doc: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for word in words:
            q = nxt[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            else:
                new = self._state(length[last] + 1, 0, {}, None)
                p = last
                while p >= 0 and word not in nxt[p]:
                    nxt[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                last = new
            if least[last] is None or doc < least[last]:
                least[last] = doc

    def freeze(self) -> None:
        """Hand smallest ids up the suffix links."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up, own = self.link[v], self.least[v]
            if up > 0 and own is not None and (self.least[up] is None or own < self.least[up]):
                self.least[up] = own

    def windows(self, words: list[bytes], size: int) -> list[tuple[int, int]]:
        """(start, smallest id) of each window of ``size`` words that occurs."""
        nxt, link, length = self.next, self.link, self.length
        found, v, matched = [], 0, 0
        for i, word in enumerate(words):
            while v and word not in nxt[v]:
                v = link[v]
                matched = length[v]
            if (q := nxt[v].get(word)) is not None:
                v, matched = q, matched + 1
            while v and length[link[v]] >= size:
                v = link[v]
                matched = length[v]
            if matched >= size:
                found.append((i - size + 1, self.least[v]))
        return found


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for i in range(1, size):
        total = total * MULTIPLIER + hashes[i : i + n]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return total ^ (total >> np.uint64(29))


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window: the smallest hash among its grams of about half the size."""
    size = window // 2 + 1
    grams = gram_hashes(hashes, size)
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    least = grams[:n].copy()
    for i in range(1, window - size + 1):
        np.minimum(least, grams[i : i + n], out=least)
    return least


def _cut(values: np.ndarray, size: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _uncut(data: bytes, size: int, top: int, bits: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel() | np.uint64(top << (64 - bits))


def _sections(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def _split_sections(data: bytes, n: int) -> list[bytes]:
    sizes, at, out = struct.unpack_from(f"<{n}I", data), 4 * n, []
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out


def _by_bucket(values: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """(bucket, range) over sorted values, whose highest bits are the bucket."""
    tops = (values >> np.uint64(64 - bits)).astype(np.int64)
    found, starts = np.unique(tops, return_index=True)
    ends = [*starts[1:].tolist(), len(values)]
    return [(int(t), slice(int(a), b)) for t, a, b in zip(found, starts, ends, strict=True)]


def _table(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


_PACKED = [("bucket", pa.int32()), ("batch", pa.int32()), ("payload", pa.binary())]
_RETURNED = _PACKED[1:]
_SPANS = [("shard", pa.int32()), ("batch", pa.int32()), ("doc", pa.int64()), ("words", pa.binary()), ("places", pa.binary())]
_PLACE = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<i8"), ("end", "<i8")])


def _docs(t: pa.Table) -> Iterable[tuple[int, int, list[bytes]]]:
    """(id, text's key, words) of the documents of a batch that are compared."""
    for doc, text, key in zip(t["id"].to_pylist(), t["text"].cast(pa.binary()), t["key"].to_pylist(), strict=True):
        if doc is not None:
            yield doc, key, (text.as_py() or b"").split()


def _least_by(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the smallest document of each, and if it has several."""
    order = np.argsort(values, kind="stable")
    values, docs = values[order], docs[order]
    first = np.nonzero(np.concatenate([[True], values[1:] != values[:-1]]))[0] if len(values) else np.zeros(0, np.int64)
    if not len(first):
        return values, docs, np.zeros(0, bool)
    least = np.minimum.reduceat(docs, first)
    return values[first], least, least != np.maximum.reduceat(docs, first)


def _send_anchors(window: int, bits: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        values, docs = [], []
        for i, (_, _, words) in enumerate(_docs(t)):
            a = anchors(word_hashes(words), window)
            a = a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a  # the same one holds for neighbours
            values.append(a)
            docs.append(np.full(len(a), i))
        # Rows of one id, or of equal ids, are told apart later; here any second document makes an anchor repeated.
        found, _, several = _least_by(np.concatenate(values or [np.zeros(0, np.uint64)]), np.concatenate(docs or [np.zeros(0, np.int64)]))
        rows = [(b, key[0].as_py(), _sections(_cut(found[s], 7), np.packbits(several[s]).tobytes())) for b, s in _by_bucket(found, bits)]
        return _table(_PACKED, rows)

    return run


def _repeated_anchors(bits: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        top = key[0].as_py()
        own, flags = [], []
        for data in t["payload"]:
            cut, packed = _split_sections(data.as_py(), 2)
            own.append(_uncut(cut, 7, top, bits))
            flags.append(np.unpackbits(np.frombuffer(packed, np.uint8), count=len(own[-1])).view(bool))
        values, counts = np.unique(np.concatenate(own), return_counts=True)
        shared = values[counts > 1]
        rows = []
        for batch, v, f in zip(t["batch"].to_pylist(), own, flags, strict=True):
            back = v[f | np.isin(v, shared, assume_unique=True)]
            if len(back):
                rows.append((batch, struct.pack("<I", top) + _cut(back, 7)))
        return _table(_RETURNED, rows)

    return run


def _send_windows(window: int, bits: int):
    def run(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        if not r.num_rows or not t.num_rows:
            return _table(_PACKED, [])
        known = np.unique(np.concatenate([_uncut(d[4:], 7, struct.unpack_from("<I", d)[0], bits) for d in (x.as_py() for x in r["payload"])]))
        values, docs = [], []
        for doc, _, words in _docs(t):
            h = word_hashes(words)
            a = anchors(h, window)
            if len(a):
                at = np.minimum(np.searchsorted(known, a), len(known) - 1)
                w = gram_hashes(h, window)[known[at] == a]
                values.append(w)
                docs.append(np.full(len(w), doc, np.int64))
        found, least, several = _least_by(np.concatenate(values or [np.zeros(0, np.uint64)]), np.concatenate(docs or [np.zeros(0, np.int64)]))
        rows = []
        for b, s in _by_bucket(found, bits):
            names, at = np.unique(least[s], return_inverse=True)
            rows.append((b, key[0].as_py(), _sections(_cut(found[s], 7), np.packbits(several[s]).tobytes(), names.astype("<i8").tobytes(), at.astype("<u4").tobytes())))
        return _table(_PACKED, rows)

    return run


def _sources(bits: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        top = key[0].as_py()
        own, docs, flags = [], [], []
        for data in t["payload"]:
            cut, packed, names, at = _split_sections(data.as_py(), 4)
            own.append(_uncut(cut, 7, top, bits))
            docs.append(np.frombuffer(names, "<i8")[np.frombuffer(at, "<u4")])
            flags.append(np.unpackbits(np.frombuffer(packed, np.uint8), count=len(own[-1])).view(bool))
        values, least, several = _least_by(np.concatenate(own), np.concatenate(docs))
        rows = []
        for batch, v, f in zip(t["batch"].to_pylist(), own, flags, strict=True):
            at = np.searchsorted(values, v)
            back = f | several[at]
            if back.any():
                names, place = np.unique(least[at][back], return_inverse=True)
                rows.append((batch, struct.pack("<I", top) + _sections(_cut(v[back], 7), names.astype("<i8").tobytes(), place.astype("<u4").tobytes())))
        return _table(_RETURNED, rows)

    return run


def _shards(docs: np.ndarray, count: int) -> np.ndarray:
    mixed = docs.astype(np.int64).view(np.uint64) * MULTIPLIER
    return ((mixed >> np.uint64(33)) % np.uint64(count)).astype(np.int64)


def _runs(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(label, start, end) of maximal runs of one label that isn't negative."""
    if not len(labels):
        return []
    edges = np.nonzero(labels[1:] != labels[:-1])[0] + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(labels)]])
    keep = labels[starts] >= 0
    return list(zip(labels[starts][keep].tolist(), starts[keep].tolist(), ends[keep].tolist(), strict=True))


def _send_spans(window: int, bits: int, shards: int):
    def run(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        if not r.num_rows or not t.num_rows:
            return _table(_SPANS, [])
        own, docs = [], []
        for x in r["payload"]:
            d = x.as_py()
            cut, names, at = _split_sections(d[4:], 3)
            own.append(_uncut(cut, 7, struct.unpack_from("<I", d)[0], bits))
            docs.append(np.frombuffer(names, "<i8")[np.frombuffer(at, "<u4")])
        known, sources = np.concatenate(own), np.concatenate(docs)
        order = np.argsort(known)
        known, sources = known[order], sources[order]
        batch = key[0].as_py()
        references: set[tuple[int, int, bytes]] = set()
        queries: dict[tuple[int, bytes], list[tuple[int, int, int, int]]] = {}
        for doc, text_key, words in _docs(t):
            w = gram_hashes(word_hashes(words), window)
            if not len(w):
                continue
            at = np.minimum(np.searchsorted(known, w), len(known) - 1)
            hit, source = known[at] == w, sources[at]
            for _, a, b in _runs(np.where(hit & (source == doc), 0, -1)):
                references.add((int(_shards(np.array([doc]), shards)[0]), doc, b" ".join(words[a : b + window - 1])))
            for shard, a, b in _runs(np.where(hit & (source < doc), _shards(source, shards), -1)):
                queries.setdefault((shard, b" ".join(words[a : b + window - 1])), []).append((doc, text_key, a, b))
        rows = [(shard, batch, doc, words, None) for shard, doc, words in sorted(references)]
        rows += [(shard, batch, None, words, np.array(places, _PLACE).tobytes()) for (shard, words), places in queries.items()]
        return _table(_SPANS, rows)

    return run


def _match(window: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        automaton, queries = Automaton(), []
        for batch, doc, words, places in zip(t["batch"].to_pylist(), t["doc"].to_pylist(), t["words"], t["places"], strict=True):
            if doc is not None:
                automaton.add(words.as_py().split(b" "), doc)
            else:
                queries.append((batch, words, places))
        automaton.freeze()
        out: dict[int, list[np.ndarray]] = {}
        for batch, words, places in queries:
            found = automaton.windows(words.as_py().split(b" "), window)
            if not found:
                continue
            starts, least = np.array(found, np.int64).T
            where = np.frombuffer(places.as_py(), _PLACE)
            for place in where:
                held = starts[least < place["doc"]]
                if len(held):
                    edges = np.nonzero(np.diff(held) > 1)[0] + 1
                    spans = np.zeros(len(edges) + 1, _PLACE)
                    spans["doc"], spans["key"] = place["doc"], place["key"]
                    spans["start"] = place["start"] + held[np.concatenate([[0], edges])]
                    spans["end"] = place["start"] + held[np.concatenate([edges - 1, [len(held) - 1]])] + window
                    out.setdefault(batch, []).append(spans)
        return _table(_RETURNED, [(b, np.concatenate(s).tobytes()) for b, s in out.items()])

    return run


def _apply(id_type: pa.DataType, texts: bool):
    def run(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for data in r["payload"]:
            for doc, text_key, a, b in np.frombuffer(data.as_py(), _PLACE).tolist():
                spans.setdefault((doc, text_key), []).append((a, b))
        rows = []
        for doc, text, text_key in zip(t["id"].to_pylist(), t["text"].cast(pa.binary()), t["key"].to_pylist(), strict=True):
            words = (text.as_py() or b"").split()
            kept, at, removed = [], 0, []
            for a, b in sorted(spans.get((doc, text_key), ())):
                if b <= at:
                    continue
                kept += words[at : max(a, at)]
                if removed and removed[-1][1] >= a:
                    removed[-1][1] = b
                else:
                    removed.append([a, b])
                at = b
            kept += words[at:]
            left = b" ".join(kept)
            row = (doc, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest())
            rows.append((*row, left.decode(), json.dumps(removed)) if texts else row)
        schema = [("id", id_type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
        return _table(schema + [("kept", pa.string()), ("removed", pa.string())] * texts, rows)

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = False) -> DataFrame:
    """A row per document: ``id_col, n_words, n_removed, kept_sha256``; with ``texts`` also the kept text and the removed word spans (JSON).

    Ids are integers.
    """
    size = df.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    batches = max(48, -(-size // max(BATCH_BYTES, min(MOST_BATCH_BYTES, 20 * math.isqrt(size)))))
    bits = max(BUCKET_BITS, (size // 6 // max(BUCKET_WINDOWS, min(MOST_BUCKET_WINDOWS, 8 * math.isqrt(size // 6)))).bit_length())
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    by = rows.groupBy("batch")

    returned = "batch int, payload binary"
    repeated = by.applyInArrow(_send_anchors(window, bits), PACKED).groupBy("bucket").applyInArrow(_repeated_anchors(bits), returned)
    windows = by.cogroup(repeated.groupBy("batch")).applyInArrow(_send_windows(window, bits), PACKED)
    sources = windows.groupBy("bucket").applyInArrow(_sources(bits), returned)
    spans = by.cogroup(sources.groupBy("batch")).applyInArrow(_send_spans(window, bits, batches), "shard int, batch int, doc long, words binary, places binary")
    matched = spans.groupBy("shard").applyInArrow(_match(window), returned)
    out = by.cogroup(matched.groupBy("batch")).applyInArrow(_apply(pa.int64(), texts), "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, removed string" * texts)
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)
),
sources AS (SELECT words, min(doc_id) AS least FROM windows GROUP BY words),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS pos FROM windows JOIN sources USING (words) WHERE least < doc_id
),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE g.pos IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY e.pos) FILTER (WHERE g.pos IS NULL) AS left_
  FROM words e LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
