"""Language identification by prediction by partial matching.

Each language has a context tree over case-folded bytes, of orders 0 to ``ORDER``: counts of what followed each context in its
training texts. A symbol's probability under a context is its share of (occurrences + distinct symbols); the rest is the
escape probability, spread over the symbols not seen there in proportion to the next shorter context (full exclusion). Order
-1 is uniform over the 256 bytes. So each context's probabilities sum to one, and the code length of a text is the sum over
its bytes of the negative binary logarithm, under statistics that are frozen after training. The shortest code wins; of
equal ones, the language that sorts first. Code lengths of symbols are kept as 32-bit floats and summed as 64-bit ones.

The trees are sparse: for each order, the grams that occur in any of a block of ``LANGS`` languages, in a hash table, with a
row of code lengths. What a longer context does to a symbol it hasn't seen is one factor, whatever the symbol, so a gram that
is in no tree costs its context's escape and the length of the gram without its first byte. Order and alphabet are the same
for any number of languages. The counts travel as a broadcast; each worker builds its tables from them once. Both grow with
the languages and the size of their samples, not with the corpus.

Training counts come from some ``SAMPLE_DOCS`` documents of each language, chosen by a hash of the id (a documented
bound on what a classifier is fitted on; rows that repeat an id are chosen together); those are counted whole, on the
executors. Every document is scored whole.

Defined results: ``und`` with score 0 for null texts and texts without a letter, or if nothing was learned; null ids are
not learned from, and count as not held out; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import map_batches, table

ORDER = 4
SAMPLE_DOCS = 400
LANGS = 8
START = b"\n" * ORDER
LETTER = regex.compile(r"\p{L}")
BLOCK = 1 << 18
EMPTY = np.uint64(2**64 - 1)


def sampled(df: DataFrame, key: Column, size: int, *by: str) -> DataFrame:
    """Some ``size`` rows for each value of ``by``, chosen by a hash of ``key``."""
    counts = {tuple(r[:-1]): r[-1] for r in df.groupBy(*by).count().collect()} if by else {(): df.count()}
    draw = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 31)) / (1 << 31)
    keep = F.lit(False)
    for values, n in counts.items():
        same = F.lit(True)
        for name, value in zip(by, values, strict=True):
            same = same & (F.col(name) == F.lit(value))
        keep = keep | (same & (draw < size / n))
    return df.where(keep)


def grams(text: bytes) -> np.ndarray:
    """Each byte of the case-folded text with the ``ORDER`` bytes before it, as a number."""
    b = np.frombuffer(START + text.lower(), np.uint8)
    out = np.zeros(len(b) - ORDER, np.uint64)
    for i in range(ORDER + 1):
        out = out << np.uint64(8) | b[i : len(b) - ORDER + i]
    return out


def _summed(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(gram, return_inverse=True)
    return found, np.bincount(at, n, len(found))


def count_grams(df: DataFrame, lang_col: str, text_col: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Grams and their occurrences, by language, over all rows of a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if text := text.as_py():
                    texts.setdefault(lang, []).append(grams(text))
            for lang, found in texts.items():
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                if lang in held:
                    gram, n = _summed(np.concatenate([held[lang][0], gram]), np.concatenate([held[lang][1], n]))
                held[lang] = gram, n
        for lang, (gram, n) in held.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), pa.string()), "gram": pa.array(gram.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    rows = df.select(lang_col, text_col).mapInArrow(run, "lang string, gram long, n long")
    summed = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, gram, n = np.array(summed["lang"].to_pylist(), object), summed["gram"].to_numpy().astype(np.uint64), summed["n"].to_numpy()
    return {lang: (gram[langs == lang], n[langs == lang]) for lang in sorted(set(langs))}


class Index:
    """Rows of distinct numbers: a hash table with linear probing, for whole arrays at a time."""

    def __init__(self, numbers: np.ndarray):
        bits = max(4, int(len(numbers)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.full(1 << bits, EMPTY), np.zeros(1 << bits, np.int32)
        left, slot = np.arange(len(numbers)), self._slots(numbers)
        while len(left):
            free = self.keys[slot] == EMPTY
            at, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            self.keys[at], self.rows[at] = numbers[put], put
            rest = self.keys[slot] != numbers[left]
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slots(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """The row of each number; -1 where it isn't there."""
        slot = self._slots(numbers)
        keys = self.keys[slot]
        out = np.where(keys == numbers, self.rows[slot], -1)
        left = np.nonzero((keys != numbers) & (keys != EMPTY))[0]
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            keys = self.keys[slot]
            out[left] = np.where(keys == numbers[left], self.rows[slot], -1)
            rest = (keys != numbers[left]) & (keys != EMPTY)
            left, slot = left[rest], slot[rest]
        return out


class Trees:
    """The context trees of a few languages side by side."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.width = len(counts)
        self.orders: list[tuple[Index, np.ndarray, Index, np.ndarray]] = []
        below: list[tuple[np.ndarray, np.ndarray]] = []  # grams and probabilities of the next shorter order, by language
        for order in range(ORDER + 1):
            own, escapes = [], []
            for i, (gram, n) in enumerate(counts):
                gram, n = _summed(gram & np.uint64(256 ** (order + 1) - 1), n)
                contexts, row = np.unique(gram >> np.uint64(8), return_inverse=True)
                total, distinct = np.bincount(row, n, len(contexts)), np.bincount(row, minlength=len(contexts))
                shorter = np.full(len(gram), 1 / 256) if not order else below[i][1][np.searchsorted(below[i][0], gram & np.uint64(256**order - 1))]
                left = np.maximum(1 - np.bincount(row, shorter, len(contexts)), 2.0**-40)  # against rounding
                escape = np.where(distinct < 256, distinct, 0)
                own.append((gram, n / (total + escape)[row]))
                escapes.append((contexts, np.log2(np.divide(left * (total + escape), escape, out=np.ones(len(contexts)), where=escape > 0))))
            below = own
            known, contexts = (np.unique(np.concatenate([x[0] for x in t])) if t else np.zeros(0, np.uint64) for t in (own, escapes))
            out = np.zeros((len(contexts), self.width), np.float32)
            for i, (c, bits) in enumerate(escapes):
                out[np.searchsorted(contexts, c), i] = bits
            # Languages that haven't seen a gram that another has: by way of the shorter orders, which are built already.
            rest = known & np.uint64(256**order - 1)
            lengths = (self.bits(rest) if order else np.full((len(known), self.width), 8, np.float32)) + out[np.searchsorted(contexts, known >> np.uint64(8))]
            for i, (gram, p) in enumerate(own):
                lengths[np.searchsorted(known, gram), i] = -np.log2(p)
            self.orders.append((Index(known), lengths, Index(contexts), out))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """A row of code lengths, one by language, for the last byte of each gram after those before it."""
        total = np.zeros((len(gram), self.width), np.float32)
        left = np.arange(len(gram))
        for order in range(len(self.orders) - 1, -1, -1):
            known, lengths, contexts, escapes = self.orders[order]
            gram = gram & np.uint64(256 ** (order + 1) - 1)
            at = known.find(gram)
            hit = at >= 0
            total[left[hit]] += lengths[at[hit]]
            left, gram = left[~hit], gram[~hit]
            at = contexts.find(gram >> np.uint64(8))
            total[left[at >= 0]] += escapes[at[at >= 0]]
        total[left] += 8
        return total


class Ppm:
    """Frozen code lengths by language. It travels as its counts; each worker builds the trees when it first needs them."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self._counts = [(counts[x][0].astype("<u8"), counts[x][1].astype("<u4")) for x in self.langs]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "trees"}

    @cached_property
    def trees(self) -> list[Trees]:
        return [Trees(self._counts[i : i + LANGS]) for i in range(0, len(self.langs), LANGS)]

    def bits(self, gram: np.ndarray) -> np.ndarray:
        return np.concatenate([t.bits(gram) for t in self.trees], axis=1)

    def code_lengths(self, text: bytes) -> np.ndarray:
        """Bits of ``text`` under each language."""
        gram, total = grams(text), np.zeros(len(self.langs))
        for at in range(0, len(gram), BLOCK):
            total += self.bits(gram[at : at + BLOCK]).sum(axis=0, dtype=np.float64)
        return total


def learn(df: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int = SAMPLE_DOCS) -> Ppm:
    rows = df.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"))
    return Ppm(count_grams(sampled(rows, F.col("__id"), sample_docs, "__lang"), "__lang", "__text"))


def predict(df: DataFrame, model: Ppm, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``id_col, lang_pred, score`` (the language's share of likelihood) and ``bits``, its code length."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ppm: Ppm = held.value
        langs, scores, bits = [], [], []
        for text in batch.column(1):
            text = text.as_py()
            if not text or not ppm.langs or not LETTER.search(text):
                langs.append("und")
                scores.append(0.0)
                bits.append(None)
                continue
            length = ppm.code_lengths(text.encode())
            best = int(length.argmin())
            langs.append(ppm.langs[best])
            scores.append(float(1 / np.exp2(np.maximum(length[best] - length, -1000)).sum()))
            bits.append(float(length[best]))
        yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "bits": pa.array(bits, pa.float64())})

    rows = df.select(id_col, text_col)
    return map_batches(rows, each, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, lang_pred string, score double, bits double")


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out("doc_id", 4, 2)), "doc_id", "text", "lang")
    return predict(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
