"""Sentence tables and sentence search."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import has_any, has_phrase, rule_sentences, sentences


def text_column(df: DataFrame, *names: str, similar: bool = True) -> str:
    """The first of ``names`` (``testimony``) that is a column, else, with ``similar``, the first column that is named like a text."""
    found = [n for n in names or ("testimony",) if n in df.columns]
    if similar:
        found += [c for c in df.columns if c == "testimony_body" or "text" in c.lower() or "full" in c.lower()]
    if not found:
        raise ValueError(f"no text column among: {', '.join(df.columns)}")
    return found[0]


def with_ordinal(df: DataFrame, order: str = "doc_id", name: str = "ordinal") -> DataFrame:
    """A row's place from 0 in the order of a column, by ranges: no task holds more than one, only their counts meet."""
    rows = df.repartitionByRange(F.col(order).asc_nulls_first()).sortWithinPartitions(F.col(order).asc_nulls_first()).withColumn("__at", F.monotonically_increasing_id())
    rows = rows.withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)}).persist(StorageLevel.MEMORY_AND_DISK)
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row for each range
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def with_display_id(df: DataFrame, number: str = "testimony_number", missing: str = "unknown", order: str = "doc_id") -> DataFrame:
    """``display_id``: a document's number as text. ``missing`` where it has none; ``row`` there stands for ``row_`` and its ordinal.
    Without a column of numbers, the ordinal itself."""
    if number not in df.columns:
        return with_ordinal(df, order, "display_id").withColumn("display_id", F.col("display_id").cast("string"))
    known = F.coalesce(F.col(number).try_cast("double").try_cast("long").cast("string"), F.col(number).cast("string"))
    if missing != "row":
        return df.withColumn("display_id", F.coalesce(known, F.lit(missing)))
    return with_ordinal(df, order, "__row").withColumn("display_id", F.coalesce(known, F.concat(F.lit("row_"), F.col("__row").cast("string")))).drop("__row")


def sentence_table(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: bool = False) -> DataFrame:
    """``keep, sentence_idx, sentence``, ordinals from 0. ``rules``: by punctuation alone."""
    split = rule_sentences if rules else sentences
    return df.where(F.col(text).isNotNull()).select(*keep, F.posexplode(split(F.col(text))).alias("sentence_idx", "sentence"))


def first_documents(df: DataFrame, n: int, order: str = "doc_id") -> DataFrame:
    return df.orderBy(order).limit(n)


def with_value(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Case-insensitive equality; no filter without a value."""
    return df if value is None else df.where(F.lower(column) == value.lower())


def search_word(df: DataFrame, phrase: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), case_sensitive: bool = False, attribute: str | None = None, value: str | None = None) -> DataFrame:
    """Sentences that hold a whole word or phrase; documents without it are left out before they are split."""
    rows = with_value(df, attribute, value) if attribute else df
    rows = rows.where(has_phrase(F.col(text), phrase, case_sensitive))
    return sentence_table(rows, text, keep).where(has_phrase(F.col("sentence"), phrase, case_sensitive))


def search_terms(df: DataFrame, terms: list[str], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per sentence and term that it holds, in the order of the terms. Each term is one literal pattern, compiled once."""
    hits = F.array_compact(F.array(*[F.when(has_phrase(F.col("sentence"), t), F.lit(t)) for t in terms])) if terms else F.array().cast("array<string>")
    rows = sentence_table(df.where(has_any(F.col(text), terms)), text, keep).where(has_any(F.col("sentence"), terms))
    return rows.select(*keep, "sentence_idx", F.explode(hits).alias("matched_word"), "sentence")


def search_category(df: DataFrame, sheet_terms: DataFrame, category: str, **options) -> DataFrame:
    """``search_terms`` with the terms of a category. A sheet is made by hand, so its terms are few."""
    terms = [r.term for r in sheet_terms.where(F.col("category") == category).orderBy("position").collect()]
    return search_terms(df, terms, **options)


def sentences_per_document(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentence_count"))


def total_sentences(rows: DataFrame) -> DataFrame:
    """Sentences of a document by its last ordinal."""
    return rows.groupBy("doc_id").agg((F.max("sentence_idx") + 1).cast("long").alias("total_sentences"))


def sentence_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents, sentences, and their mean over all documents, those without sentences too."""
    n = F.coalesce(F.size(sentences(F.col(text))), F.lit(0))
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("sentences"), F.round(F.try_divide(F.sum(n), F.count("*")), 6).alias("mean_sentences"))
