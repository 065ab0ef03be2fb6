"""Byte-level BPE encoding and decoding.

A pre-token's symbols form a doubly linked list. A heap holds (merge rank, position) for each adjacent pair that has a
merge. Popping gives the best merge, leftmost first; an entry is stale, and skipped, if the symbols it was pushed for are no
longer the ones at its position. Each merge relinks two neighbours and pushes at most two pairs: O(n log n) for n bytes
without a break. Decoding concatenates the vocabulary's byte strings.

Pre-tokens repeat, so each worker keeps the ids of those it has met, up to ``CACHE_WORDS`` short ones; it forgets them all
beyond that. The vocabulary file is a parameter, and travels to the executors as a broadcast of its (fixed) size.

Defined results: null and empty texts have no ids; repeated rows and ids are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import map_batches, table

CACHE_WORDS = 300_000
CACHE_CHARS = 64
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1

# The public pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file, to that byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _pair(left: int, right: int) -> int:
    return left << ID_BITS | right


class Bpe:
    """Encoder and decoder of a byte-level ``tokenizer.json``."""

    def __init__(self, spec: str):
        self.spec = spec
        data = json.loads(spec)
        alphabet = byte_alphabet()
        vocab: dict[str, int] = data["model"]["vocab"]
        added = {a["content"]: a["id"] for a in data.get("added_tokens", [])}
        self.byte_id = {b: vocab[c] for c, b in alphabet.items() if c in vocab}
        self.merges: dict[int, int] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.setdefault(_pair(vocab[left], vocab[right]), rank << ID_BITS | vocab[left + right])
        size = max([*vocab.values(), *added.values()], default=-1) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(alphabet[c] for c in token)
        for token, i in added.items():
            self.strings[i] = token.encode()
        self.added = added
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.find = regex.compile(PATTERN).findall
        self.cache: dict[str, bytes] = {}

    def merge_word(self, word: bytes) -> tuple[int, ...]:
        get, byte_id = self.merges.get, self.byte_id
        sym = [byte_id[b] for b in word]
        n = len(sym)
        if n == 1:
            return tuple(sym)
        # best[i]: the merge of the pair that starts at i (rank, then what it makes, in one number), or None.
        best = [get(p) for p in map(_pair, sym, sym[1:])]
        best.append(None)
        heap = [m * n + i for i, m in enumerate(best) if m is not None]
        heapq.heapify(heap)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            m, i = divmod(heappop(heap), n)
            if best[i] != m:
                continue  # stale
            made, j = m & ID_MASK, nxt[i]
            k = nxt[i] = nxt[j]
            sym[i], sym[j], best[j] = made, -1, None
            if k < n:
                prv[k] = i
                best[i] = m = get(made << ID_BITS | sym[k])
                if m is not None:
                    heappush(heap, m * n + i)
            else:
                best[i] = None
            h = prv[i]
            if h >= 0:
                best[h] = m = get(sym[h] << ID_BITS | made)
                if m is not None:
                    heappush(heap, m * n + h)
        return tuple([s for s in sym if s >= 0])

    def _word(self, word: str) -> bytes:
        ids = np.array(self.merge_word(word.encode()), "<u4").tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def encode_packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        packed: list[bytes] = []
        get, word = self.cache.get, self._word
        parts = self.added_split.split(text) if self.added_split and any(a in text for a in self.added) else [text]
        for part in parts:
            if part in self.added:
                packed.append(self.added[part].to_bytes(4, "little"))
            else:
                packed += [get(w) or word(w) for w in self.find(part)]
        return b"".join(packed)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


_model: Bpe | None = None


def worker_model(spec: str) -> Bpe:
    """The model of a vocabulary; built once in each worker."""
    global _model
    if _model is None or _model.spec != spec:
        _model = Bpe(spec)
    return _model


def encode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, ids: bool = True) -> DataFrame:
    """A row per document: ``id_col, n_tokens, ids_sha256, decoded_sha256``, with ``ids`` and the decoded text if asked for.

    ``vocabulary`` is the path, on the driver, of a byte-level tokenizer.json.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = worker_model(spec.value)
        n, coded, ids_sha, text_sha, decoded = [], [], [], [], []
        for text in batch.column(1):
            packed = model.encode_packed(text.as_py())
            raw = np.frombuffer(packed, "<u4")
            back = model.decode(raw.tolist())
            n.append(len(raw))
            ids_sha.append(hashlib.sha256(packed).hexdigest())
            text_sha.append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
            if ids:
                coded.append(raw.view("<i4"))
            if texts:
                decoded.append(back)
        columns = {id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
        if ids:
            columns["ids"] = pa.array(coded, pa.list_(pa.int32()))
        if texts:
            columns["decoded"] = pa.array(decoded, pa.string())
        yield pa.RecordBatch.from_pydict(columns)

    rows = df.select(id_col, text_col)
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(rows, each, schema + ", ids array<int>" * ids + ", decoded string" * texts)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary or default_vocabulary(), ids=False)
