"""Verb tables: voice, polarity and lemma counts, filters and suggestions."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOICES, POLARITIES = ["active", "passive"], ["affirmative", "negated"]


def from_dependencies(tokens: DataFrame) -> DataFrame:
    """Verbs of parsed tokens (``pos``, ``lemma``, ``text``, ``idx``, ``children``: array of dependency labels), as a parser gives them."""
    has = lambda *labels: F.exists("children", lambda d: d.isin(*labels))
    voice = F.when(has("nsubjpass", "auxpass"), "passive").otherwise("active")
    polarity = F.when(has("neg"), "negated").otherwise("affirmative")
    return tokens.where(F.col("pos") == "VERB").select("doc_id", "sentence_idx", "sentence_text", F.col("text").alias("verb_text"), F.col("lemma").alias("verb_lemma"), F.col("pos").alias("verb_pos"), voice.alias("voice"), polarity.alias("polarity"), F.col("idx").alias("verb_idx_in_sentence"))


def summary(verbs: DataFrame) -> DataFrame:
    """Counts of each lemma by voice and by polarity, in one aggregate."""
    of = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    rows = verbs.groupBy("verb_lemma").agg(*[of("voice", v) for v in VOICES], *[of("polarity", v) for v in POLARITIES])
    return rows.withColumn("total", F.col("active") + F.col("passive")).orderBy(F.desc("total"), "verb_lemma")


def report(verbs: DataFrame) -> DataFrame:
    """Totals and the shares of passive and negated verbs; 0 without verbs."""
    return _report(verbs.withColumn("n", F.lit(1)))


def _report(rows: DataFrame) -> DataFrame:
    """``report`` of rows that stand for ``n`` verbs each."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    of = lambda c, v: total(F.when(F.col(c) == v, F.col("n")))
    n = total("n")
    share = lambda c, v: F.coalesce(F.bround(F.try_divide(of(c, v), n), 6), F.lit(0.0))
    counts = [of(c, v).alias(v) for c, values in (("voice", VOICES), ("polarity", POLARITIES)) for v in values]
    return rows.agg(n.alias("total_verbs"), F.count_distinct("verb_lemma").alias("lemmas"), F.count_distinct("doc_id").alias("documents"), *counts, share("voice", "passive").alias("passive_ratio"), share("polarity", "negated").alias("negated_ratio"))


def quadrants(verbs: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent lemmas of each voice and polarity, ties alphabetical, with the quadrant's total."""
    return _quadrants(verbs.groupBy("voice", "polarity", "verb_lemma").agg(F.count("*").alias("n")), n)


def _quadrants(counts: DataFrame, n: int) -> DataFrame:
    totals = counts.groupBy("voice", "polarity").agg(F.sum("n").alias("quadrant_total"))  # four rows
    rank = F.row_number().over(Window.partitionBy("voice", "polarity").orderBy(F.desc("n"), "verb_lemma"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).join(F.broadcast(totals), ["voice", "polarity"])


def full_report(verbs: DataFrame, n: int = 20) -> DataFrame:
    """One row: ``report`` with the count and the most frequent lemmas of each quadrant.

    Counts by document, lemma and quadrant are read for both, so they are persisted: verbs are found once.
    """
    counts = verbs.groupBy("doc_id", "voice", "polarity", "verb_lemma").agg(F.count("*").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    tops = _quadrants(counts.groupBy("voice", "polarity", "verb_lemma").agg(F.sum("n").alias("n")), n).groupBy("voice", "polarity", "quadrant_total").agg(F.array_sort(F.collect_list(F.struct("rank", "verb_lemma", "n"))).alias("top"))
    columns = []
    for v in VOICES:
        for p in POLARITIES:
            here = (F.col("voice") == v) & (F.col("polarity") == p)
            top = F.coalesce(F.first(F.when(here, F.col("top")), ignorenulls=True), F.array().cast("array<struct<rank:int,verb_lemma:string,n:bigint>>"))
            columns += [F.coalesce(F.max(F.when(here, F.col("quadrant_total"))), F.lit(0)).alias(f"{v}_{p}_count"), F.map_from_entries(F.transform(top, lambda x: F.struct(x["verb_lemma"], x["n"]))).alias(f"top_{v}_{p}_verbs")]
    return _report(counts).crossJoin(F.broadcast(tops.agg(*columns)))  # one row each


def select(verbs: DataFrame, lemma: str, voice: str | None = None, polarity: str | None = None) -> DataFrame:
    """Occurrences of a lemma (as written, case counts) of a voice and polarity."""
    held: Column = F.col("verb_lemma") == lemma
    for column, value in (("voice", voice), ("polarity", polarity)):
        held = held & (F.col(column) == value) if value else held
    return verbs.where(held)


def most_frequent(verbs: DataFrame, n: int = 50) -> DataFrame:
    return verbs.groupBy("verb_lemma").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "verb_lemma").limit(n)


def suggest(verbs: DataFrame, lemma: str, n: int = 5) -> DataFrame:
    """The most frequent lemmas with the same first three letters: for a lemma that isn't there."""
    return most_frequent(verbs.where(F.col("verb_lemma").startswith(lemma[:3])), n)
