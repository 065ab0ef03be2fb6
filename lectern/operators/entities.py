"""Entity tables: rules or a model, filters, and counts by sentence, document and text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapse
from lectern.operators.annotators import ENTITY_TYPES, model_entities, rule_entities

# Texts that are no entities.
NOISE = ["Ger", "Ger.", "Pol", "App", "Rev", "of", "the"]


def extract(sentences: DataFrame, min_confidence: float = 0.5, types: list[str] | None = None, model: Callable | None = None) -> DataFrame:
    """Entities of ``doc_id, sentence_idx, sentence_text`` rows. Dates have confidence 1 and pass whatever the threshold."""
    types = types or ENTITY_TYPES
    of = [t for t in types if t != "DATE"]
    found = rule_entities(sentences, bool(of) and model is None, "DATE" in types)
    if model:
        found = found.unionByName(model_entities(sentences, model))
    date = F.col("entity_type") == "DATE"
    name = F.col("entity_type").isin(*of or [""]) & (F.col("confidence") >= min_confidence) & ~F.contains("text", F.lit("##")) & (F.length("text") >= 2)
    return found.where((date & F.lit("DATE" in types) & (F.length(F.trim("text")) >= 2)) | (~date & name))


def _counts(entities: DataFrame, *keys: str, unique: bool = False) -> DataFrame:
    """Entities by type; with ``unique`` also distinct texts, counted from those of each key."""
    of = lambda t: F.col("entity_type") == t
    if not unique:
        return entities.groupBy(*keys).agg(*[F.count_if(of(t)).alias(t) for t in ENTITY_TYPES], F.count("*").alias("total_entities"))
    texts = entities.groupBy(*keys, "entity_type", "text").agg(F.count("*").alias("n"))
    counts = [F.coalesce(F.sum(F.when(of(t), F.col("n"))), F.lit(0)).alias(t) for t in ENTITY_TYPES]
    return texts.groupBy(*keys).agg(*counts, F.sum("n").alias("total_entities"), *[F.count_if(of(t)).alias(f"{t}_unique") for t in ENTITY_TYPES])


def by_sentence(entities: DataFrame, sentences: DataFrame) -> DataFrame:
    """Counts of every sentence, zeros where it has no entity."""
    counts = _counts(entities, "doc_id", "sentence_idx")
    rows = sentences.join(counts, ["doc_id", "sentence_idx"], "left").fillna(0, [*ENTITY_TYPES, "total_entities"])
    return rows.select("doc_id", "sentence_idx", *ENTITY_TYPES, "total_entities", "sentence_text")


def by_document(entities: DataFrame, sentences: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Counts and distinct texts of documents with entities, their sentences, and their name, place and date if known."""
    rows = _counts(entities, "doc_id", unique=True)
    rows = rows.join(sentences.groupBy("doc_id").agg(F.count("*").alias("sentence_count")), "doc_id", "left")
    if metadata is not None:
        keep = [c for c in ("name", "testimony_place", "testimony_date") if c in metadata.columns]
        rows = rows.join(metadata.select("doc_id", *keep), "doc_id", "left")
    return rows


def top_texts(entities: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent texts of each type; ties by first occurrence."""
    return _top_texts(_texts(entities), n)


def _texts(entities: DataFrame) -> DataFrame:
    """Texts of each document and type, their number, and the place of the first."""
    place = F.shiftleft(F.col("sentence_idx").cast("long"), 32) + F.col("start")
    return entities.groupBy("entity_type", "text", "doc_id").agg(F.count("*").alias("n"), F.min(place).alias("place"))


def _top_texts(texts: DataFrame, n: int) -> DataFrame:
    counts = texts.groupBy("entity_type", "text").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "place")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("entity_type").orderBy(F.desc("n"), "first", "text"))
    return counts.select("entity_type", "text", "n", rank.alias("rank")).where(F.col("rank") <= n)


def frequencies(entities: DataFrame, min_count: int = 2, exclude: list[str] | None = None, max_words: int | None = None, noise: bool = False) -> DataFrame:
    """``entity_type, text, n`` of normalised texts: what a word cloud is drawn from. Noise goes unless asked for."""
    text = collapse(F.col("text"))
    rows = entities.select("entity_type", text.alias("text")).where(~F.col("text").isin(*{*([] if noise else NOISE), *(exclude or [])}, ""))
    counts = rows.groupBy("entity_type", "text").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    if max_words is None:
        return counts
    rank = F.row_number().over(Window.partitionBy("entity_type").orderBy(F.desc("n"), "text"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= max_words).drop("rank")


def report(entities: DataFrame) -> DataFrame:
    """Entities, distinct texts and documents by type, and of all; from one count by document, type and text."""
    return _report(_texts(entities).drop("place"))


def _report(texts: DataFrame) -> DataFrame:
    of = lambda *kinds: texts.groupBy(*kinds).agg(F.sum("n").alias("entities"), F.count_distinct("entity_type", "text").alias("distinct_texts"), F.count_distinct("doc_id").alias("documents"))
    total = of().select(F.lit("ALL").alias("entity_type"), F.coalesce("entities", F.lit(0)).alias("entities"), "distinct_texts", "documents")
    return of("entity_type").unionByName(total)


def full_report(entities: DataFrame, sentences: DataFrame, top: int = 20) -> DataFrame:
    """One row: documents, sentences, entities and distinct texts by type, and the most frequent texts of each type.

    Counts by document and text are read for both tables, so they are persisted: entities are found once.
    """
    texts = _texts(entities).persist(StorageLevel.MEMORY_AND_DISK)
    by_type = _report(texts.drop("place")).where("entity_type <> 'ALL'").agg(F.coalesce(F.sum("entities"), F.lit(0)).alias("total_entities"), *[F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", c)))).alias(name) for c, name in (("entities", "entities_by_type"), ("distinct_texts", "unique_entities_by_type"))])
    ranked = _top_texts(texts, top).groupBy("entity_type").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text", "n"))), lambda x: F.struct(x["text"], x["n"]))).alias("texts"))
    tops = ranked.agg(F.map_from_entries(F.collect_list(F.struct("entity_type", "texts"))).alias("top_entities"))
    totals = sentences.agg(F.count_distinct("doc_id").alias("total_documents"), F.count("*").alias("total_sentences"))
    return totals.crossJoin(F.broadcast(by_type)).crossJoin(F.broadcast(tops))  # one row each
