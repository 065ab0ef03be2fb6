"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees of one fixed depth are grown level by level from gradient histograms over quantile bins, and kept as flat arrays
(feature, threshold, leaf), so that a batch of documents walks all trees at once in numpy.

It is fitted on the driver, on the statistics of at most ``SAMPLE_DOCS`` labelled documents with the smallest hashes of their
ids (a documented bound; only their statistics reach the driver). Every document is scored on its whole text.

Defined results: null counts as empty, and gets a score like any text; without labels of both kinds the score is the share of
label 1, or 0.5 without labels; null ids are scored but never learned from; rows repeated with one id are scored each, and
count once for a label (with the least of their statistics); extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import map_batches, table
from lectern.llm.langid import held_out

SAMPLE_DOCS = 12_000
BINS = 64

FEATURES = ("bytes", "words", "word_length", "upper", "lower", "digits", "marks", "high", "lines", "entropy", "distinct_words", "repeated_next", "top_word", "marked_words", "doubled_marks", "longest_word", "repeated_lines", "upper_words", "lone_marks", "line_ends")

_CLASS = np.zeros(256, np.uint8)  # 0 white space and control, then upper, lower, digit, mark, high
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 5 if _b > 127 else 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit() else 4 if _c.isprintable() and _c != " " else 0
_MARKS = bytes(b for b in range(256) if _CLASS[b] == 4)


def statistics(text: bytes) -> list[float]:
    """``FEATURES`` of one document."""
    n = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, counts, minlength=6) / n
    share = counts[counts > 0] / n
    words = text.split()
    w = max(1, len(words))
    tally = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    marked = [x for x in words if x[-1] in _MARKS]
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), sum(map(len, words)) / w, *kinds[1:].tolist(), len(lines) / w, float(-(share * np.log2(share)).sum()),
        len(tally) / w, sum(map(bytes.__eq__, words, words[1:])) / w, max(tally.values(), default=0) / w, len(marked) / w,
        sum(len(x) > 1 and x[-2] in _MARKS for x in marked) / w, float(max(map(len, words), default=0)), 1 - len(set(lines)) / max(1, len(lines)),
        sum(map(bytes.isupper, words)) / w, sum(len(x) == 1 for x in marked) / w, sum(x[-1] in b".!?" for x in lines) / max(1, len(lines)),
    ]


@dataclass
class Trees:
    """``feature`` and ``threshold`` are (trees, inner nodes) in level order, ``leaf`` (trees, leaves)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.leaf):
            tree, row = np.arange(len(self.leaf))[None, :], np.arange(len(x))[:, None]
            inner = self.feature.shape[1]
            node = np.zeros((len(x), len(self.leaf)), np.int64)
            while node.size and node[0, 0] < inner:
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            total += self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Boosted trees for the log loss. Deterministic for rows in a given order."""
    inner, features = 2**depth - 1, x.shape[1] if len(x) else 0
    share = y.mean() if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Trees(float(np.log(p / (1 - p))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(features)], axis=1)
    base = float(np.log(share / (1 - share)))
    raw = np.full(len(y), base)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-6)
            for f in range(features):
                if not len(cuts[f]):
                    continue
                cell = at * BINS + binned[:, f]
                gl = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hl = np.bincount(cell, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least) | (ht - hl < least)] = -1
                gain[:, len(cuts[f]) :] = -1
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                for i in np.nonzero(top > best)[0]:
                    best[i] = top[i]
                    feature[t, first + i], threshold[t, first + i] = f, cuts[f][k[i]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[t, node]] > threshold[t, node])
        gs, hs = np.bincount(node - inner, g, inner + 1), np.bincount(node - inner, h, inner + 1)
        leaf[t] = -rate * gs / (hs + l2)
        raw += leaf[t][node - inner]
    return Trees(base, feature, threshold, leaf)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Trees:
    """Fit on the labelled documents among ``docs``; labels are 0 or 1, others are left out."""
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__label_id"), F.col(label_col).cast("double").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("__label_id", F.lit(11)), "__label_id", "__label").limit(sample_docs)
    rows = docs.select(F.col(id_col).alias("__id"), text_col).join(F.broadcast(chosen), F.col("__id") == F.col("__label_id")).select("__id", "__label", text_col)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [statistics(t.as_py() or b"") for t in batch.column(2).cast(pa.binary())]
        yield pa.RecordBatch.from_pydict({"id": batch.column(0).cast(pa.string()), "label": batch.column(1), "x": pa.array(found, pa.list_(pa.float64()))})

    # One row for an id and label, however often it is repeated: so the bound holds for what the driver gets.
    sample = map_batches(rows, each, "id string, label double, x array<double>").groupBy("id", "label").agg(F.min("x").alias("x"))
    sample = sample.toPandas().sort_values(["id", "label"])
    x = np.array([list(v) for v in sample["x"]], float).reshape(-1, len(FEATURES))
    return fit(x, sample["label"].to_numpy(float))


def score(df: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``id_col, score``."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "score": pa.array(_scores(held.value, batch.column(1)))})

    rows = df.select(id_col, text_col)
    return map_batches(rows, each, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double")


def _scores(model: Trees, texts: pa.Array) -> np.ndarray:
    return model.score(np.array([statistics(t.as_py() or b"") for t in texts.cast(pa.binary())]))


def accepted(docs: DataFrame, model: Trees, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose score is at least ``least``. No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pc.greater_equal(pa.array(_scores(held.value, batch.column(at))), least))

    return map_batches(docs, each, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)))
    out = score(docs, model)
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
