"""Token-id files as wavelet matrices.

A shard file holds the ids of consecutive documents as succinct bit-planes, highest bit first. The elements with a zero bit come
before those with a one in the next plane. Each plane is stored in blocks of ``BLOCK`` bits, compressed each for itself, with a
rank directory (the ones of each block), so a lookup expands only the blocks that it touches. One file answers: the id at a
position (access), how often an id occurs in a range (rank), where its k-th occurrence is (select), and all of its occurrences.

Layout of a file, little-endian: ``LWMX``, version (u32), length of the header (u32), a JSON header (tokens, documents, bits of a
block, zeros by plane, sizes of the sections), then zstd sections: document ids (i64), their null marks (u8), ids per document
(u64), the directory (sizes of all blocks, then their ones, u32), and after them the blocks, plane by plane (bits from the lowest
of each byte).

``write_tokens`` sorts by document id over ranges, encodes, and cuts a file whenever it has ``shard_tokens`` ids, so memory is
bounded by that and the longest text. A retried task writes the same file again, and a file is moved into place whole. Files
go through Arrow's file systems (local, hdfs, s3, gs), and are read with Spark's binary file source.

Defined results: null and empty texts have only the end id; null document ids come first, repeated ids are ordered by text; extra
columns are ignored; an empty table gives no file and no row. Ids are integers; others are refused by the cast.
"""

from __future__ import annotations

import json
import os
import string
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import BATCH_ROWS, limit_batches, materialize, shared_path, small, table

MAGIC, VERSION = b"LWMX", 2
BLOCK = 1 << 18
SHARD_TOKENS = 1 << 21
CACHE_WORDS = 500_000
END_ID = 1


class Plane:
    """Bits in blocks that are loaded when they are needed, with the stored number of ones before each block."""

    def __init__(self, n: int, before: np.ndarray, load: Callable[[int], bytes]):
        self.n, self.before, self._load = n, before, load
        self.loaded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        raw = np.packbits(bits, bitorder="little").tobytes()
        blocks = [raw[i : i + BLOCK // 8] for i in range(0, len(raw), BLOCK // 8)] or [b""]
        counts = [int(np.bitwise_count(np.frombuffer(x, np.uint8)).sum()) for x in blocks]
        return cls(len(bits), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), blocks.__getitem__)

    def raw(self) -> bytes:
        return b"".join(map(self._load, range(len(self.before) - 1)))

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """64-bit words of a block, and the ones of it before each word."""
        if i not in self.loaded:
            words = np.zeros(BLOCK // 64 + 1, "<u8")
            raw = np.frombuffer(self._load(i), np.uint8) if i < len(self.before) - 1 else np.zeros(0, np.uint8)
            words.view(np.uint8)[: len(raw)] = raw
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.loaded[i] = words, before
        return self.loaded[i]

    def ranked(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each position (0 at the end), and the ones before it."""
        bit, ones, block = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at // BLOCK
        for i in np.unique(block).tolist():
            here = slice(None) if block[0] == block[-1] == i and (block == i).all() else np.nonzero(block == i)[0]
            words, before = self.block(i)
            place = at[here] - i * BLOCK
            word, shift = words[place >> 6], (place & 63).astype(np.uint64)
            bit[here] = word >> shift & np.uint64(1)
            ones[here] = self.before[i] + before[place >> 6] + np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
        return bit, ones

    def find(self, k: np.ndarray, one: int) -> np.ndarray:
        """The position of each k-th one, or zero."""
        starts = np.arange(len(self.before)) * BLOCK
        counts = self.before if one else starts - self.before
        block = np.searchsorted(counts[:-1], k, side="right") - 1
        out = np.zeros(len(k), np.int64)
        for i in np.unique(block).tolist():
            here = np.nonzero(block == i)[0]
            words, before = self.block(i)
            held, rest = before if one else np.arange(len(before)) * 64 - before, k[here] - counts[i]
            word = np.searchsorted(held, rest, side="right") - 1
            bits = np.unpackbits(words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") == one
            out[here] = i * BLOCK + word * 64 + (bits.cumsum(axis=1) >= (rest - held[word])[:, None] + 1).argmax(axis=1)
        return out


def _least_type(width: int) -> type:
    return np.uint16 if width <= 16 else np.uint32


class WaveletMatrix:
    """Rank, select and access over a sequence of non-negative integers. Each loads only the blocks that it needs."""

    def __init__(self, planes: list[Plane], zeros: list[int], n: int):
        self.n, self.zeros, self.planes = n, zeros, planes

    @classmethod
    def build(cls, values: np.ndarray, width: int | None = None) -> WaveletMatrix:
        values = np.asarray(values, np.uint32)
        width = max(1, int(values.max(initial=0)).bit_length()) if width is None else width
        values = values.astype(_least_type(width), copy=False)
        planes, zeros = [], []
        for level in range(width - 1, -1, -1):
            bits = values & values.dtype.type(1 << level) != 0
            planes.append(Plane.of(bits))
            low = values.compress(~bits)  # several times as fast as an index of booleans
            zeros.append(len(low))
            values = np.concatenate([low, values.compress(bits)])
        return cls(planes, zeros, len(values))

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at positions."""
        at = np.asarray(at, np.int64)
        value = np.zeros(len(at), np.uint32)
        for plane, zero in zip(self.planes, self.zeros, strict=True):
            bit, ones = plane.ranked(at)
            value = value << np.uint32(1) | bit.astype(np.uint32)
            at = np.where(bit == 1, zero + ones, at - ones)
        return value

    def values(self) -> np.ndarray:
        """All values: the planes undone from the last one up, which is access at every position at once."""
        value = np.zeros(self.n, _least_type(len(self.zeros)))
        for i in range(len(self.zeros) - 1, -1, -1):
            bits = np.unpackbits(np.frombuffer(self.planes[i].raw(), np.uint8), count=self.n, bitorder="little").view(bool)
            value[self.zeros[i] :] |= value.dtype.type(1 << (len(self.zeros) - 1 - i))
            above = np.empty_like(value)
            above[np.flatnonzero(~bits)] = value[: self.zeros[i]]
            above[np.flatnonzero(bits)] = value[self.zeros[i] :]
            value = above
        return value.astype(np.uint32)

    def _places(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Where positions come to stand below the last plane, on the path of ``symbol``."""
        at = np.asarray(at, np.int64)
        for level, (plane, zero) in enumerate(zip(self.planes, self.zeros, strict=True)):
            _, ones = plane.ranked(at)
            at = zero + ones if symbol >> (len(self.zeros) - 1 - level) & 1 else at - ones
        return at

    def counts(self, symbol: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs in each of some ranges (ends exclusive)."""
        if symbol < 0 or symbol >> len(self.zeros):
            return np.zeros(len(starts), np.int64)
        ends = np.minimum(np.asarray(ends, np.int64), self.n)
        return np.maximum(0, self._places(symbol, ends) - self._places(symbol, np.minimum(starts, ends)))

    def rank(self, symbol: int, start: int, end: int) -> int:
        return int(self.counts(symbol, np.array([start]), np.array([end]))[0])

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th occurrences (from 0); they must exist."""
        k = np.asarray(k, np.int64)
        if not len(k):
            return k
        at = self._places(symbol, np.zeros(1, np.int64)) + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = symbol >> (len(self.zeros) - 1 - level) & 1
            at = self.planes[level].find(at - self.zeros[level] if one else at, one)
        return at

    def occurrences(self, symbol: int) -> np.ndarray:
        """All positions of ``symbol``, in order."""
        return self.select(symbol, np.arange(self.rank(symbol, 0, self.n)))


def pack(doc_ids: list[int | None], counts: list[int], tokens: np.ndarray) -> bytes:
    """The bytes of a shard file."""
    matrix = WaveletMatrix.build(tokens)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    ids = np.array([0 if i is None else i for i in doc_ids], "<i8")
    blocks = [squeeze(plane._load(i)) for plane in matrix.planes for i in range(len(plane.before) - 1)]
    ones = np.concatenate([np.diff(plane.before) for plane in matrix.planes])
    directory = np.array([[len(x) for x in blocks], ones], "<u4").tobytes()
    sections = [squeeze(x) for x in (ids.tobytes(), bytes(i is None for i in doc_ids), np.array(counts, "<u8").tobytes(), directory)]
    header = json.dumps({"tokens": len(tokens), "documents": len(doc_ids), "block": BLOCK, "zeros": matrix.zeros, "sections": [len(s) for s in sections]}).encode()
    return MAGIC + struct.pack("<II", VERSION, len(header)) + header + b"".join(sections) + b"".join(blocks)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, ids per document, and the matrix of a shard file, whose blocks are expanded when they are needed."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    version, size = struct.unpack("<II", data[4:12])
    header = json.loads(data[12 : 12 + size])
    if version != VERSION or header["block"] != BLOCK:
        raise ValueError(f"token file of version {version}, blocks of {header.get('block')}")
    at, parts = 12 + size, []
    expand = zstandard.ZstdDecompressor().decompress
    for n in header["sections"]:
        parts.append(expand(data[at : at + n]))
        at += n
    ids = [None if null else i for i, null in zip(np.frombuffer(parts[0], "<i8").tolist(), parts[1], strict=True)]
    sizes, ones = np.frombuffer(parts[3], "<u4").astype(np.int64).reshape(2, len(header["zeros"]), -1)
    ends = at + np.cumsum(sizes.ravel()).reshape(sizes.shape)
    planes = []
    for size, end, own in zip(sizes, ends, ones, strict=True):
        load = lambda i, size=size, end=end: expand(data[end[i] - size[i] : end[i]])
        planes.append(Plane(header["tokens"], np.concatenate([[0], np.cumsum(own)]), load))
    return ids, np.frombuffer(parts[2], "<u8").astype(np.int64), WaveletMatrix(planes, header["zeros"], header["tokens"])


class Encoder:
    """Ids of whole texts, with the library's tokenizer on each distinct piece.

    Texts are cut at ASCII white space, where this kind of vocabulary always breaks, and lower-cased before (it does so itself)
    unless they may hold a special token. A piece of Latin letters with ASCII marks after them is two words. Words of letters are
    encoded many at a time by the same model without the normalizer and the pattern, which do nothing to them; a word ends
    where an id has the suffix of word ends. All else, and all of a vocabulary without such a suffix, is encoded alone. Pieces
    are kept in two generations of at most ``CACHE_WORDS``, so frequent ones stay known.
    """

    BLOCK = 500
    #: The bytes of ASCII letters and of U+00C0 to U+017F; of the latter, those that are signs, or one that becomes two characters.
    LETTERS = bytes([*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5, *range(0x80, 0xC0)])
    NO_LETTERS = [c.encode() for c in "\u00d7\u00f7\u0130"]
    MARKS = string.punctuation.encode()

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        parts = json.loads(spec)
        suffix = parts["model"].get("end_of_word_suffix")
        self.plain = None
        if suffix:
            split = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
            self.plain = Tokenizer.from_str(json.dumps(parts | {"added_tokens": [], "normalizer": None, "pre_tokenizer": split, "post_processor": None, "truncation": None, "padding": None}))
            vocabulary = parts["model"]["vocab"]
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _latin(self, word: bytes) -> bool:
        return not word.translate(None, self.LETTERS) and not any(c in word for c in self.NO_LETTERS)

    def _learn_alone(self, pieces: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        self.known.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(pieces, found, strict=True))

    def _learn_words(self, words: list[bytes]) -> None:
        """Words of letters."""
        for i in range(0, len(words), self.BLOCK):
            block = words[i : i + self.BLOCK]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(block).decode().lower()], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(ends) == len(block):
                raw = ids.tobytes()
                self.known.update((w, raw[i:j]) for w, i, j in zip(block, [0, *ends], ends))  # noqa: B905
            else:  # a byte that the vocabulary lacks
                self._learn_alone(block)

    def _learn(self, pieces: list[bytes]) -> None:
        known, old = self.known, self.old
        if len(known) + len(pieces) > CACHE_WORDS:
            self.old, self.known = old, known = known, {}
        words, others, marked = set(), set(), []
        for p in pieces:
            if (ids := old.get(p)) is not None:
                known[p] = ids
                continue
            word = p.rstrip(self.MARKS)
            if self.plain is None or not word or not (word.isalpha() or self._latin(word)):
                others.add(p)
            elif len(word) == len(p):
                words.add(p)
            else:
                mark = p[len(word) :]
                marked.append((p, word, mark))
                for part, new in ((word, words), (mark, others)):
                    if part not in known:
                        if (ids := old.get(part)) is not None:
                            known[part] = ids
                        else:
                            new.add(part)
        self._learn_words(list(words))
        self._learn_alone(list(others))
        known.update((p, known[word] + known[mark]) for p, word, mark in marked)

    def encode_batch(self, texts: list[bytes]) -> list[memoryview]:
        """The ids of each text as little-endian unsigned 32-bit integers. Each distinct piece is looked up once."""
        lists = pc.ascii_split_whitespace(pa.array([t if b"<|" in t else t.lower() for t in texts], pa.large_string()))
        found = lists.flatten().dictionary_encode()
        one = pa.ListArray.from_arrays([0, len(found.dictionary)], found.dictionary.cast(pa.large_binary()))
        pieces = pc.binary_join(one, pa.scalar(b" ", pa.large_binary()))[0].as_py().split(b" ")
        ids = list(map(self.known.get, pieces))
        new = [p for p, i in zip(pieces, ids, strict=True) if i is None]
        if new:
            self._learn(new)
            ids = [self.known[p] if i is None else i for p, i in zip(pieces, ids, strict=True)]
        tokens = pa.array(ids, pa.large_binary()).take(found.indices)
        _, offsets, data = tokens.buffers()
        ends = np.frombuffer(offsets, np.int64)[lists.offsets.to_numpy()].tolist()
        raw = memoryview(data or b"")
        return [raw[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


_encoder: tuple[str, Encoder] | None = None


def worker_encoder(spec: str) -> Encoder:
    """The encoder of a vocabulary; built once in each worker."""
    global _encoder
    if _encoder is None or _encoder[0] != spec:
        _encoder = spec, Encoder(spec)
    return _encoder[1]


def _save(folder: str, name: str, data: bytes) -> str:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    own = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, f"{root}/{name}")
    return f"{folder}/{name}"


def write_tokens(df: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write shard files into ``folder``; a row per file: ``part, file, path, tokens``, in the order of the ids."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(spec.value)
        part, files = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4")
        ids: list[int | None] = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal files, total
            path = _save(folder, f"tokens-{part:06d}-{files:06d}.lwm", pack(ids, counts, np.concatenate(held)))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([files], pa.int32()), "path": pa.array([path]), "tokens": pa.array([total], pa.int64())})
            files, total = files + 1, 0
            for x in (ids, counts, held):
                x.clear()
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(at, BATCH_ROWS)
                texts = [t or b"" for t in rows.column(1).cast(pa.binary()).to_pylist()]
                for doc_id, found in zip(rows.column(0).to_pylist(), encoder.encode_batch(texts), strict=True):
                    ids.append(doc_id)
                    held += (np.frombuffer(found, "<u4"), end)
                    counts.append(len(held[-2]) + 1)
                    total += counts[-1]
                    if total >= shard_tokens:
                        yield flush()
        if ids:
            yield flush()

    limit_batches(df.sparkSession)
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).mkdirs(target)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return materialize(ordered.mapInArrow(run, "part int, file int, path string, tokens long"), "token-index")


def read_tokens(index: DataFrame, folder: str, id_col: str = "doc_id", ids: bool = False, end_id: int = END_ID) -> DataFrame:
    """A row per document from its files: ``id_col, start, n_tokens, ids_crc32, n_end, end_at`` and, if asked for, ``ids``.

    ``start`` counts the ids of all documents before it. ``n_end`` counts the end ids among its own (rank), ``end_at`` is where the
    last of them stands among all ids (select). A file whose documents are all wanted is undone as a whole.
    """
    spark = index.sparkSession
    parts = index.groupBy("part").agg(F.sum("tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per task, not per file
    starts = index.join(F.broadcast(parts), "part").select(F.element_at(F.split("path", "/"), -1).alias("name"), (F.col("before") + F.sum("tokens").over(Window.partitionBy("part").orderBy("file")) - F.col("tokens")).alias("start"))
    starts = materialize(starts, "token-starts")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.lwm").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, start in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                doc_ids, counts, matrix = unpack(content.as_py())
                tokens = matrix.values().astype("<u4")
                ends = np.cumsum(counts)
                docs = [tokens[e - c : e] for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                n_end = matrix.counts(end_id, ends - counts, ends)
                end_at = matrix.select(end_id, np.cumsum(n_end) - 1)
                columns = {id_col: pa.array(doc_ids, pa.int64()), "start": pa.array(start + ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64()), "n_end": pa.array(n_end), "end_at": pa.array(start + end_at)}
                if ids:
                    columns["ids"] = pa.array([d.astype(np.int32) for d in docs], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return files.join(small(starts), "name").select("content", "start").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long, n_end long, end_at long" + ", ids array<int>" * ids)


def occurrences(files: DataFrame, token: int) -> DataFrame:
    """``doc_id, position`` of each occurrence of an id, straight from rows (``content``) of token files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                doc_ids, counts, matrix = unpack(content.as_py())
                at = matrix.occurrences(token)
                ends = np.cumsum(counts)
                doc = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_ids[d] for d in doc], pa.int64()), "position": pa.array(at - (ends - counts)[doc], pa.int64())})

    return files.select("content").mapInArrow(run, "doc_id long, position long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    folder = shared_path(spark, "tokens")
    index = write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary or default_vocabulary())
    return read_tokens(index, folder)
