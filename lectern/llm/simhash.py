"""SimHash near-duplicates: Golay-code keys, pigeonhole over segments, join and verify.

Documents that share a fingerprint are one node. Each node gives some 170 keys (see ``golay``); two nodes within 4 bits share
at least one. Keys are pre-aggregated to the smallest and largest node of each bucket; buckets of one node go. Then:

1. every member of a bucket is compared with those two, which joins dense groups at a cost linear in their size;
2. connected components of these links give labels; buckets whose members all have one label are done;
3. in the others, members with different labels are joined on the key and compared. No pair is skipped, so no link between
   different components is lost; pairs within one component are never built.

Components are found by contraction in the shared folder; nothing but counts reaches the driver.

With ``similarity``, links are pairs of at least that Jaccard similarity of their shingle sets. Keys only propose pairs; each is
decided on the whole shingle sets of both texts:

1. Looser Golay keys (one block of a fingerprint equal, a segment within 2 bits) give each fingerprint one other to try: the
   closest that is the first of a bucket it is in. That joins near-identical texts at a cost linear in their number.
2. Fingerprints of pairs near 0.8 differ in some 10 of 64 bits, so many such pairs share no key. Prefixes make up for those,
   exactly: in any order of all shingles, two sets of n and m shingles with similarity s or more share one of their first
   ``n - ceil(s n) + 1`` and ``m - ceil(s m) + 1``. The order is by the count in a sample of the documents, rare ones first; the
   sample bears on the cost only. Buckets of one label go; each node tries the most central node it meets, which
   joins what is left of dense groups; then members of a bucket with different labels are joined unless their sizes and the
   places of the shared shingle rule out the similarity, and compared by their prefixes. No link is lost.

Defined results: null and blank texts have fingerprint zero and are alike; a text of fewer words than a shingle is one shingle;
null ids belong to a group but never name it, unless all its ids are null; repeated rows and ids are rows each; an empty
table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import golay
from lectern.llm.common import discard, map_batches, materialize, small, table, without_texts
from lectern.llm.graph import components

SEED = 42
Texts = Callable[[DataFrame], DataFrame]
#: Keys of a fingerprint, some: by ``golay.keys`` and ``golay.loose_keys``.
KEYS, LOOSE_KEYS = 170, 40
#: Loose keys propose fingerprints that differ in no more than so many bits; prefixes find what they don't.
FAR = 16
#: Keys that one task makes.
TASK_KEYS = 2_000_000
#: The share of documents in which shingles are counted for the order of prefixes, and how many of the most frequent are told apart.
SAMPLE_SHARE, COMMON = 1 / 8, 1_000_000


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words, repeats included."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = len(words) - size + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)]), ">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        block = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _common(df: DataFrame, id_col: str, text_col: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes that several documents of a sample share, the ``COMMON`` most frequent of them, sorted, and their counts."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [np.unique(shingle_hashes(text.as_py() or b"", size).view(np.int64)) for text in batch.column(0).cast(pa.binary())]
        hashes, n = np.unique(np.concatenate(sets), return_counts=True)
        yield pa.RecordBatch.from_pydict({"h": pa.array(hashes), "n": pa.array(n.astype(np.int64))})

    chosen = df.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) < int(SAMPLE_SHARE * (1 << 30))).select(text_col)
    found = materialize(map_batches(chosen, each, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "common")
    least, total = 2, 0
    for r in found.groupBy("n").count().orderBy(F.desc("n")).collect():  # a row for each count
        total += r["count"]
        if total > COMMON:
            least = r["n"] + 1
            break
    rows = found.where(F.col("n") >= least).toArrow()
    discard(found)
    hashes, counts = rows["h"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a set, the rarest first, of which any set that is similar enough has one among its own such."""
    seen = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        seen = np.where(common[at] == hashes, counts[at], 0)
    size = len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1
    return hashes[np.lexsort((hashes, seen))[:size]]


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float | None = None) -> DataFrame:
    """A row per document: ``__id, f0`` and, with ``similarity``, ``key``, a hash of its text, ``node``, one of its shingle set,
    ``n``, the size of the set, and ``prefix``, its first shingles in the order of prefixes."""
    common = None if similarity is None else df.sparkSession.sparkContext.broadcast(_common(df, id_col, text_col, shingle))

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        prints, sets, sizes, prefixes = [], [], [], []
        for text in batch.column(1).cast(pa.binary()):
            hashes = shingle_hashes(text.as_py() or b"", shingle)
            prints.append(fingerprint(hashes))
            if similarity is not None:
                each_once = np.unique(hashes.view(np.int64))
                sets.append(xxhash.xxh64_intdigest(each_once.tobytes(), SEED))
                sizes.append(len(each_once))
                prefixes.append(_prefix(each_once, *common.value, similarity))
        columns = {"__id": batch.column(0), "f0": pa.array(np.array(prints, np.uint64).view(np.int64))}
        if similarity is not None:
            columns |= {"key": batch.column(2), "node": pa.array(np.array(sets, np.uint64).view(np.int64)), "n": pa.array(sizes, pa.int32()), "prefix": pa.array(prefixes, pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_pydict(columns)

    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), _text_key(text_col).alias("key"))
    schema = f"__id {rows.schema[0].dataType.simpleString()}, f0 long" + ", key long, node long, n int, prefix array<long>" * (similarity is not None)
    return map_batches(rows, each, schema)


def _spread(nodes: DataFrame, keys: int) -> DataFrame:
    """``nodes``, materialized, in as many partitions as their keys need."""
    return nodes.repartition(max(1, -(-nodes.count() * keys // TASK_KEYS)))


def _keys(nodes: DataFrame, loose: bool, ends: bool = False) -> DataFrame:
    """(key, node) for every key of every node, a fingerprint; with ``ends`` (key, lo, hi), a row for each key of a block of nodes.

    Rows come in the order of the nodes, so that those of one node, which stand together, compress well.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nodes = batch.column(0).to_numpy()
        row, key = (golay.loose_keys if loose else golay.keys)(nodes.view(np.uint64))
        order = np.argsort(row, kind="stable")
        key, node = key[order], nodes[row[order]]
        if ends:
            order = np.argsort(key, kind="stable")
            first = np.nonzero(np.diff(key[order], prepend=-1))[0]
            back = np.argsort(order[first])
            lo, hi = (f.reduceat(node[order], first)[back] for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[order][first][back]), "lo": pa.array(lo), "hi": pa.array(hi)})
        else:
            yield pa.RecordBatch.from_pydict({"key": pa.array(key), "node": pa.array(node)})

    return map_batches(nodes, each, "key long, lo long, hi long" if ends else "key long, node long")


def _shared(ends: DataFrame) -> DataFrame:
    """(key, lo, hi) of the keys that several nodes have. ``ends`` are pre-aggregated already: Spark would sort them by key for little."""
    return ends.repartition("key").groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _alike(pairs: DataFrame, texts: Texts, shingle: int, similarity: float) -> DataFrame:
    """The (a, b) whose whole shingle sets are similar enough; only the texts of ``pairs`` are moved."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def shingles(node: int, text: bytes | None) -> np.ndarray:
            if node not in known:
                if len(known) >= 64:
                    known.clear()
                known[node] = np.unique(shingle_hashes(text or b"", shingle))
            return known[node]

        good = []
        a, b, x, y = (batch.column(c) for c in ("a", "b", "x", "y"))
        for i in range(batch.num_rows):
            p, q = shingles(a[i].as_py(), x[i].cast(pa.binary()).as_py()), shingles(b[i].as_py(), y[i].cast(pa.binary()).as_py())
            shared = len(np.intersect1d(p, q, assume_unique=True))
            good.append(shared >= (len(p) + len(q) - shared) * similarity)
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = materialize(pairs, "pairs")
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    held = materialize(texts(small(ends)), "texts")
    x, y = held.toDF("a", "x"), held.toDF("b", "y")
    out = materialize(map_batches(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), each, "a long, b long"), "alike")
    discard(pairs, ends, held)
    return out


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.toDF("__n", "__root")
    return rows.join(named, F.col("node") == F.col("__n"), "left").withColumn("label", F.coalesce("__root", "node")).drop("__n", "__root")


def _proposed(nodes: DataFrame) -> DataFrame:
    """(a, b): for each node, one other of the same fingerprint, or of the closest that is the first of a bucket it is in."""
    prints = materialize(nodes.groupBy("f0").agg(F.min("node").alias("rep")), "fingerprints")
    spread = _spread(prints.select("f0"), LOOSE_KEYS)
    buckets = materialize(_shared(_keys(spread, True, ends=True)), "buckets")
    bits = F.bit_count(F.col("node").bitwiseXOR(F.col("lo")))
    members = _keys(spread, True).join(small(buckets), "key").where(bits.between(1, FAR))
    close = members.groupBy("node").agg(F.min_by("lo", F.struct(bits, "lo")).alias("lo"))
    x, y = prints.toDF("node", "a"), prints.toDF("lo", "b")
    same = nodes.select("node", "f0").join(prints, "f0").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    out = materialize(close.join(x, "node").join(y, "lo").select("a", "b").union(same), "proposed")
    discard(prints, buckets)
    return out


def _token_ends(rows: DataFrame) -> DataFrame:
    """(key, lo, hi): the smallest and largest label of a shingle among a block of prefixes, in their order."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        prefix = batch.column(1)
        key = prefix.flatten().to_numpy()
        label = np.repeat(batch.column(0).to_numpy(), prefix.value_lengths().to_numpy())
        order = np.argsort(key, kind="stable")
        first = np.nonzero(np.concatenate([[True], np.diff(key[order]) != 0]))[0] if len(key) else np.zeros(0, np.int64)
        back = np.argsort(order[first])
        lo, hi = (f.reduceat(label[order], first)[back] if len(key) else label for f in (np.minimum, np.maximum))
        yield pa.RecordBatch.from_pydict({"key": pa.array(key[order][first][back]), "lo": pa.array(lo), "hi": pa.array(hi)})

    return map_batches(rows.select("label", "prefix"), each, "key long, lo long, hi long")


def _similar(nodes: DataFrame, prefixes: DataFrame, texts: Texts, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of the nodes that have others of at least the similarity. ``prefixes`` (``node, n, prefix``) may repeat."""
    labels = components(_alike(_proposed(nodes), texts, shingle, similarity))

    named = _labelled(prefixes.select("node", "prefix"), small(labels))
    shared = materialize(_shared(_token_ends(named)).select("key"), "shared")
    tokens = prefixes.select("node", F.posexplode("prefix").alias("at", "key")).join(small(shared), "key").dropDuplicates(["key", "node"])
    tokens = materialize(_labelled(tokens.join(nodes.select("node", "n"), "node"), small(labels)), "tokens")

    # Each node tries the most central node of the buckets it is in, the one it meets most often: that joins dense groups.
    sizes = tokens.groupBy("key").agg(F.count("*").alias("c"))
    central = tokens.select("key", "node", "n").join(sizes, "key").groupBy("node").agg((F.sum("c") / (F.first("n") + 5)).alias("central"))
    first = tokens.select("key", "node").join(central, "node").groupBy("key").agg(F.max_by("node", F.struct("central", "node")).alias("b"))
    tried = tokens.join(first, "key").where("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("count"), F.first("n").alias("n"))
    tried = tried.where(F.col("count") >= 1 + F.col("n") * (1 - similarity) * similarity / (1 + similarity) / 2)  # half of what a pair of equal sizes shares
    labels = components(labels.union(_alike(tried.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b")), texts, shingle, similarity)))

    labelled = materialize(_labelled(tokens.drop("label"), labels), "labelled")
    discard(shared, tokens)
    # One of the buckets with the same members is enough: the first in the order, which has the smallest places.
    held = F.struct(F.count("*").alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("all"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), held.alias("held"), F.sum("at").alias("places")).where("x <> y")
    mixed = mixed.groupBy("held").agg(F.min_by("key", "places").alias("key")).select("key")
    open_rows = materialize(labelled.join(mixed, "key", "left_semi"), "open")
    x, y = _prefixed(open_rows, "x_"), _prefixed(open_rows, "y_")
    least = lambda n, m: (n + m) * (similarity / (1 + similarity)) - 1e-6  # noqa: E731  what two similar sets share
    # At the first shingle that two sets share, no more than what follows it in both can be shared.
    most = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    pairs = x.join(y, (F.col("x_key") == F.col("y_key")) & (F.col("x_label") < F.col("y_label")) & (most >= least(F.col("x_n"), F.col("y_n"))))
    pairs = materialize(pairs.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct(), "candidates")
    # All they share is in both prefixes, or after the prefix that ends first.
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    sets = materialize(prefixes.join(small(ends), "node", "left_semi").dropDuplicates(["node"]), "sets")
    p, q = sets.toDF("a", "n", "p"), sets.toDF("b", "m", "q")
    shared = F.size(F.array_intersect("p", "q")) + F.greatest(F.col("n") - F.size("p"), F.col("m") - F.size("q"))
    pairs = pairs.join(p, "a").join(q, "b").where(shared >= least(F.col("n"), F.col("m"))).select("a", "b")
    more = _alike(pairs, texts, shingle, similarity)
    discard(labelled, open_rows, ends, sets)
    return labels if more.isEmpty() else components(labels.union(more))


def _within(nodes: DataFrame) -> DataFrame:
    """(node, root) of the nodes, which are fingerprints, that have others within ``MAX_BITS``."""
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= golay.MAX_BITS
    spread = _spread(nodes.select("f0"), KEYS)
    buckets = materialize(_shared(_keys(spread, False, ends=True)), "buckets")
    members = materialize(_keys(spread, False).join(small(buckets), "key"), "members")
    stars = members.select(F.col("node").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).where((F.col("a") != F.col("b")) & near("a", "b"))
    labels = components(stars)

    labelled = materialize(_labelled(members.select("key", "node"), labels), "labelled")
    discard(buckets, members)
    # Neighbours share many keys, so many buckets have the same members; one of each such set is enough.
    held = F.struct(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("all"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), held.alias("held")).where("x <> y").groupBy("held").agg(F.min("key").alias("key")).select("key")
    open_rows = materialize(labelled.join(mixed, "key", "left_semi"), "open")
    x, y = _prefixed(open_rows, "x_"), _prefixed(open_rows, "y_")
    pairs = x.join(y, (F.col("x_key") == F.col("y_key")) & (F.col("x_label") < F.col("y_label")) & near("x_node", "y_node")).select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()
    more = materialize(pairs, "links")
    discard(labelled, open_rows)
    return labels if more.isEmpty() else components(labels.union(more))


def _grouped(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float | None) -> DataFrame:
    """``__id, f0, component_id`` of each row, and with ``similarity`` the ``key`` of its text."""
    docs = materialize(fingerprints(df, id_col, text_col, shingle, similarity), "prints")
    if similarity is None:
        docs = docs.withColumn("node", F.col("f0"))
        nodes = materialize(docs.groupBy("node").agg(F.min("__id").alias("least_id"), F.min("f0").alias("f0")), "nodes")
        roots = _within(nodes)
    else:
        nodes = materialize(docs.groupBy("node").agg(F.min("__id").alias("least_id"), F.min("f0").alias("f0"), F.min("n").alias("n")), "nodes")

        def texts(ends: DataFrame) -> DataFrame:
            """(node, text): read again from the documents, by id and a hash of the text, one for each node."""
            where = small(materialize(docs.join(ends, "node", "left_semi").dropDuplicates(["node"]).select("node", F.col("__id").alias("__at"), "key"), "where"))
            rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), F.col(text_col).alias("__text"))
            # Not a bare equality, which would make the hash one of the join's keys, and every text hashed.
            found = rows.join(where, F.col("__id").eqNullSafe(F.col("__at")) & F.coalesce(_text_key("__text") == F.col("key"), F.lit(False)))
            return found.select("node", "text").dropDuplicates(["node"])

        roots = _similar(nodes, docs.select("node", "n", "prefix"), texts, shingle, similarity)
    roots = materialize(roots, "roots")
    named = roots.join(nodes.select("node", "least_id"), "node").groupBy("root").agg(F.min("least_id").alias("component_id"))
    groups = roots.join(named, "root").select("node", "component_id")
    groups = nodes.select("node", "least_id").join(groups, "node", "left").select("node", F.coalesce("component_id", "least_id").alias("component_id"))
    return docs.join(groups, "node").select("__id", "f0", "component_id", *(["key"] if similarity is not None else []))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float | None = 0.8) -> DataFrame:
    """A row per document: ``id_col, fingerprint`` (16 hex digits) and ``component_id``, the smallest id of its group.

    ``similarity`` None: links are fingerprints at most 4 bits apart. Every link is found either way.
    """
    out = _grouped(df, id_col, text_col, shingle, similarity)
    return out.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. Rows of a repeated id are judged each by its own
    text; those of them that are in one group, or that have no id, stay together."""
    gone = _grouped(docs, id_col, text_col, shingle, similarity).where("__id <> component_id OR __id IS NULL AND component_id IS NOT NULL")
    return without_texts(docs, gone.select("__id", "key"), id_col, _text_key(text_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, similarity=None)
