"""Temporal pacing: classified date expressions, their place in a text, and profiles by document, section and position."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.temporal import CATEGORIES, MEANINGFUL, classify

HISTOGRAM_EDGES = [0, 1, 2, 3, 7, 14, 30, 60, 90, 180, 365, 730, 1825]


def classified(dates: DataFrame) -> DataFrame:
    """Rows of ``text`` with ``text_clean, category, duration_days``."""
    return classify(dates)


def with_position(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """``text_position``: the sentence's place in its document, 0 to 1; 0 in documents of one sentence or unknown length."""
    joined = rows.join(totals.select("doc_id", "total_sentences"), "doc_id", "left")
    n = F.col("total_sentences") - 1
    place = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("sentence_idx"), n)))).otherwise(F.lit(0.0))
    return joined.withColumn("text_position", place)


def meaningful(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("category") != "noise")


def _tally(rows: DataFrame, *keys: str, more: list[Column] | None = None) -> DataFrame:
    """Rows by category, ``k_day`` ..., their number, and the dominant category, in one aggregate.

    The most frequent category dominates; of equally frequent ones, the one that comes first in the text.
    """
    of = lambda c: F.col("category") == c
    place = F.shiftleft(F.col("sentence_idx").cast("long"), 32) + F.col("start")
    counts = [F.count_if(of(c)).alias(f"k_{c}") for c in MEANINGFUL]
    firsts = [F.min(F.when(of(c), place)).alias(f"at_{c}") for c in MEANINGFUL]
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n_expressions"), *counts, *firsts, *(more or []))
    ranked = F.array_compact(F.array(*[F.when(F.col(f"k_{c}") > 0, F.struct((-F.col(f"k_{c}")).alias("k"), F.col(f"at_{c}").alias("at"), F.lit(c).alias("category"))) for c in MEANINGFUL]))
    return stats.withColumn("dominant_category", F.array_min(ranked)["category"]).drop(*[f"at_{c}" for c in MEANINGFUL])


def _fractions() -> list[Column]:
    return [F.round(F.col(f"k_{c}") / F.col("n_expressions"), 6).alias(f"frac_{c}") for c in MEANINGFUL]


def by_document(rows: DataFrame) -> DataFrame:
    stats = _tally(meaningful(rows), "doc_id", more=[F.median("duration_days").alias("median_duration_days"), F.round(F.avg("duration_days"), 6).alias("mean_duration_days")])
    return stats.select("doc_id", "n_expressions", "median_duration_days", "mean_duration_days", *_fractions(), "dominant_category")


def with_bin(rows: DataFrame, bins: int, name: str, value: str = "text_position") -> DataFrame:
    """Equal-width, right-closed bins over the observed range; the one global aggregate is a single row.

    ``rows`` are read twice, for the range and for the bins, so they are persisted: what makes them runs once.
    """
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    ends = rows.agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    wider = F.when(F.col("lo_") == 0, F.lit(0.001)).otherwise(F.abs("lo_") * 0.001)
    ends = ends.select(F.when(F.col("lo_") == F.col("hi_"), F.col("lo_") - wider).otherwise(F.col("lo_")).alias("lo"), F.when(F.col("lo_") == F.col("hi_"), F.col("hi_") + wider).otherwise(F.col("hi_")).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    edges = [(F.lit(j) * step + F.col("lo") < F.col(value)).cast("int") for j in range(1, bins)]
    total = F.lit(0)
    for e in edges:
        total = total + e
    return rows.crossJoin(F.broadcast(ends)).withColumn(name, total).drop("lo", "hi")


def _compact(rows: DataFrame) -> DataFrame:
    return meaningful(rows).select("doc_id", "sentence_idx", "start", "category", "duration_days", "text_position")


def by_section(rows: DataFrame, sections: int = 3) -> DataFrame:
    rows = with_bin(_compact(rows), sections, "section")
    stats = _tally(rows, "doc_id", "section", more=[F.median("duration_days").alias("median_duration_days")])
    return stats.select("doc_id", "section", "n_expressions", "median_duration_days", *_fractions(), "dominant_category")


def by_position(rows: DataFrame, bins: int = 20) -> DataFrame:
    rows = with_bin(_compact(rows), bins, "position_bin")
    counts = lambda f: [f(c).alias(f"k_{c}") for c in MEANINGFUL]
    documents = rows.groupBy("position_bin", "doc_id").agg(F.count("*").alias("n"), *counts(lambda c: F.count_if(F.col("category") == c)))
    stats = documents.groupBy("position_bin").agg(F.sum("n").alias("n_expressions"), F.count("*").alias("n_documents"), *counts(lambda c: F.sum(f"k_{c}")))
    stats = stats.select("position_bin", "n_expressions", "n_documents", *_fractions())
    return stats.withColumn("position_mid", F.round((F.col("position_bin") + 0.5) / bins, 6)).orderBy("position_bin")


def section_means(sections: DataFrame) -> DataFrame:
    """Unweighted means of the fractions over documents' sections."""
    return sections.groupBy("section").agg(*[F.round(F.avg(f"frac_{c}"), 5).alias(f"frac_{c}") for c in MEANINGFUL])


def report(rows: DataFrame) -> DataFrame:
    """One row: totals, noise, and the counts and fractions of categories (noise in the denominator, rounded half to even)."""
    n = F.count("*")
    counts = [F.count_if(F.col("category") == c).alias(f"n_{c}") for c in CATEGORIES]
    fractions = [F.coalesce(F.bround(F.try_divide(F.count_if(F.col("category") == c), n), 3), F.lit(0.0)).alias(f"frac_{c}") for c in CATEGORIES]
    documents = F.count_distinct(F.when(F.col("category") != "noise", F.col("doc_id"))).alias("documents_with_expressions")
    return rows.agg(n.alias("total_date_entities"), F.count_if(F.col("category") != "noise").alias("meaningful_expressions"), documents, *counts, *fractions)


def full_report(rows: DataFrame, sections: int = 3) -> DataFrame:
    """One row: ``report`` with noise, the median of expressions by document, and the five categories that dominate most documents.

    All come from one count by document and category, which is persisted: expressions are classified once.
    """
    counted = _tally(rows, "doc_id", more=[F.count_if(F.col("category") == "noise").alias("k_noise")]).persist(StorageLevel.MEMORY_AND_DISK)
    total = F.coalesce(F.sum("n_expressions"), F.lit(0))
    found = F.col("n_expressions") > F.col("k_noise")
    share = lambda c: F.coalesce(F.bround(F.try_divide(F.sum(f"k_{c}"), F.sum("n_expressions")), 3), F.lit(0.0))
    n = lambda c: F.coalesce(F.sum(f"k_{c}"), F.lit(0))
    base = counted.agg(
        total.alias("total_date_entities"), (total - n("noise")).alias("meaningful_expressions"), n("noise").alias("noise_filtered"), share("noise").alias("noise_fraction"), F.count_if(found).alias("documents_with_expressions"), F.lit(sections).alias("n_sections"),
        F.struct(*[n(c).alias(c) for c in CATEGORIES]).alias("category_counts"), F.struct(*[share(c).alias(c) for c in CATEGORIES]).alias("category_fractions"),
        F.bround(F.median(F.when(found, F.col("n_expressions") - F.col("k_noise"))), 1).alias("median_expressions_per_doc"),
    )
    top = dominant_categories(counted.where(found)).agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("documents")).alias("k"), "dominant_category", "documents"))), lambda x: F.struct(x["dominant_category"], x["documents"]))).alias("corpus_dominant_categories"))
    return base.crossJoin(F.broadcast(top))  # one row each


def dominant_categories(documents: DataFrame, n: int = 5) -> DataFrame:
    return documents.groupBy("dominant_category").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "dominant_category").limit(n)


def duration_histogram(rows: DataFrame) -> DataFrame:
    """Positive durations of meaningful expressions: ``[edge, next)``, the last closed, longer ones left out; every bin has a row."""
    edges = HISTOGRAM_EDGES
    bins = rows.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    rows = meaningful(rows).select(F.explode(F.array("duration_days")).alias("duration_days"))  # found once, however often it is used
    d = F.col("duration_days")
    place = F.lit(-1)
    for e in edges[:-1]:
        place = place + (d >= e).cast("int")
    counted = rows.where((d > 0) & (d <= edges[-1])).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counted, "bin", "left").fillna(0, ["n"])


def top_documents(rows: DataFrame, documents: DataFrame, n: int = 10) -> DataFrame:
    """Meaningful rows of the documents with most expressions. ``rows`` may also be dates that aren't classified: then only those of
    these documents are, again."""
    top = documents.orderBy(F.desc("n_expressions"), "doc_id").limit(n).select("doc_id")
    rows = rows.join(F.broadcast(top), "doc_id", "left_semi")
    return meaningful(rows if "category" in rows.columns else classified(rows))
