"""Registry of the corpus-analytics queries: ``(spark, sf_dir) -> DataFrame`` by name, and their SQL in ``lectern.plans.oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.gender import gender
from lectern.functions.text import find
from lectern.operators import corpus, entities, metadata, pacing, search, topics, verbs
from lectern.operators.annotators import rule_verbs
from lectern.plans import oracle, samples
from lectern.sources import checkpoints, sinks
from lectern.sources.readers import as_corpus, category_terms, read_csv, read_pdfs, read_table, read_texts, read_words
from lectern.sources.scratch import shared_folder, stored

TOPICS = topics.TopicSettings()
K, KS = 4, [5, 10, 15, 20, 25]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _bow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.bag_of_words(_documents(spark, sf_dir))


def corpus_summary(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    rows = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.lit(1).alias("n_pages"), F.col("text").alias("full_text"), F.when(F.length("text") == 0, "empty").alias("error"))
    return corpus.corpus_summary(as_corpus(rows))


def filter_word_by_attr(spark, sf_dir):
    return search.search_word(_documents(spark, sf_dir), "la", keep=("doc_id", "lang"), attribute="lang", value="FR")


def _terms(spark) -> DataFrame:
    return category_terms(samples.sheet(spark))


def filter_category(spark, sf_dir):
    return search.search_category(_documents(spark, sf_dir), _terms(spark), "Nouns")


def category_hits_by_term(spark, sf_dir):
    hits = search.search_category(_documents(spark, sf_dir), _terms(spark), "Phrases")
    return hits.groupBy("matched_word").agg(F.count("*").alias("sentences"), F.count_distinct("doc_id").alias("documents"))


def _classified(spark, sf_dir) -> DataFrame:
    return pacing.classified(samples.dates(spark, sf_dir))


def _positioned(spark, sf_dir) -> DataFrame:
    return pacing.with_position(_classified(spark, sf_dir), search.total_sentences(samples.sentences(spark, sf_dir)))


def text_position(spark, sf_dir):
    return _positioned(spark, sf_dir).select("doc_id", "sentence_idx", "total_sentences", F.round("text_position", 9).alias("text_position"))


def pacing_top_docs(spark, sf_dir):
    rows = _classified(spark, sf_dir)
    return pacing.top_documents(samples.dates(spark, sf_dir), pacing.by_document(rows)).select("doc_id", "sentence_idx", "text_clean", "category")


def _entities(spark, sf_dir) -> DataFrame:
    return entities.extract(samples.annotated_sentences(spark, sf_dir))


def entities_by_document(spark, sf_dir):
    meta = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("name"), F.col("lang").alias("testimony_place"))
    return entities.by_document(_entities(spark, sf_dir), samples.annotated_sentences(spark, sf_dir), meta)


def _verbs(spark, sf_dir) -> DataFrame:
    return rule_verbs(samples.annotated_sentences(spark, sf_dir))


def _metadata(spark, sf_dir) -> DataFrame:
    return metadata.extract_metadata(samples.testimonies(spark, sf_dir))


def gender_classified(spark, sf_dir):
    return samples.names(spark, sf_dir).withColumn("gender", gender(F.col("name")))


def _tokens(spark, sf_dir) -> DataFrame:
    """Tokens by document, found once: what fits topics reads them again and again."""
    return stored(_bow(spark, sf_dir).select("doc_id", "tokens"), "tokens")


def _lda(spark, sf_dir) -> tuple[DataFrame, topics.TopicModel]:
    bow = _tokens(spark, sf_dir)
    return bow, topics.train(bow, K, TOPICS)


def lda_doc_topics(spark, sf_dir):
    bow, model = _lda(spark, sf_dir)
    return topics.document_topics(bow, model)


def lda_coherence(spark, sf_dir):
    _, scores = topics.select_k(_tokens(spark, sf_dir), KS, TOPICS)
    return spark.createDataFrame(scores, "k int, coherence double")


def text_files(spark, sf_dir):
    folder = shared_folder(spark, "texts")
    sinks.write_texts(_documents(spark, sf_dir), folder, text_col="text")
    return read_texts(spark, folder)


def pdf_corpus(spark, sf_dir):
    folder = shared_folder(spark, "pdfs")
    sinks.write_texts(samples.pdfs(spark, sf_dir), folder, ending="pdf")
    return read_pdfs(spark, folder)


def csv_projection(spark, sf_dir):
    path = shared_folder(spark, "csv")
    rows = _documents(spark, sf_dir).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"), "source")
    sinks.write_csv(rows, path, drop=("source",))
    return read_csv(spark, path, "doc_id long, lang string, text string", ["doc_id", "text"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def corpus_stored(spark, sf_dir):
    path = shared_folder(spark, "corpus")
    docs = _documents(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.lit(2).alias("n_pages"), F.col("text").alias("full_text"), F.lit(None).alias("error"))
    sinks.write_parquet(as_corpus(docs), path)
    return spark.read.parquet(path).drop("full_text")


def word_list(spark, sf_dir):
    path = shared_folder(spark, "words")
    spark.createDataFrame([(w,) for w in samples.WORD_LIST], "value string").coalesce(1).write.text(path)
    return read_words(spark, path)


def entities_resumed(spark, sf_dir):
    """The second call finds all blocks done; so does the third but one, which is made again."""
    path, rows = shared_folder(spark, "blocks"), samples.annotated_sentences(spark, sf_dir)
    checkpoints.resumable(rows, "doc_id", entities.extract, path, 3)
    checkpoints.clear(spark, f"{path}/block-3-1")
    return checkpoints.resumable(rows, "doc_id", entities.extract, path, 3)


def display_ids(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") * 2).alias("testimony_number"))
    return search.with_display_id(docs, missing="row").withColumnRenamed("display_id", "row_id").transform(search.with_display_id).select("doc_id", "row_id", "display_id")


def marker_positions(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return _documents(spark, sf_dir).select("doc_id", find(text, "THE", 5).cast("long").alias("any_case"), find(text, "the", 20, case_sensitive=True).cast("long").alias("exact"))


def rule_sentences(spark, sf_dir):
    return search.sentence_table(_documents(spark, sf_dir), rules=True)


def pacing_full_report(spark, sf_dir):
    rows = _classified(spark, sf_dir)
    full = pacing.full_report(rows, 3)
    return full.select("total_date_entities", "noise_filtered", "noise_fraction", "n_sections", "median_expressions_per_doc", F.col("category_counts.day").alias("n_day"), F.col("category_fractions.season").alias("frac_season"), F.size("corpus_dominant_categories").cast("long").alias("n_dominant"))


def verb_full_report(spark, sf_dir):
    full = verbs.full_report(_verbs(spark, sf_dir))
    tops = [F.element_at(f"top_{v}_{p}_verbs", F.lit("beat")).alias(f"beat_{v}_{p}") for v, p in (("passive", "affirmative"),)]
    return full.select("total_verbs", *[f"{v}_{p}_count" for v in verbs.VOICES for p in verbs.POLARITIES], *tops)


def ner_full_report(spark, sf_dir):
    found, rows = _entities(spark, sf_dir), samples.annotated_sentences(spark, sf_dir)
    full = entities.full_report(found, rows)
    return full.select("total_documents", "total_sentences", "total_entities", F.col("entities_by_type")["LOC"].alias("n_loc"), F.col("unique_entities_by_type")["PER"].alias("unique_per"), F.col("top_entities")["ORG"]["Gestapo"].alias("n_gestapo"))


HEADER = ["doc_id", "testimony_place", "testimony_date", "recorder", "recorder_role", "recorder_name", "testimony_number", "is_transcribed", "is_confidential"]
BIO = ["doc_id", "title", "name", "birth_date", "birthplace", "occupation", "religion", "nationality", "parents_forenames", "husband", "proof_of_identity", "last_residence_poland", "current_residence", "gender"]
INTERNMENT = ["doc_id", "arrest_place", "arrest_date", "prisoner_number", "triangle_color", "triangle_letter"]
SECTIONS = ["doc_id", "content_summary", "testimony_body", "interviewer_assessment", "warnings"]

QUERIES = {
    "filter_category": filter_category,
    "corpus_summary": corpus_summary,
    "doc_lengths": lambda s, d: corpus.lengths(_documents(s, d)),
    "sentences": lambda s, d: samples.sentences(s, d),
    "sentences_per_doc": lambda s, d: search.sentences_per_document(samples.sentences(s, d)),
    "sentence_counts_max": lambda s, d: search.total_sentences(samples.sentences(s, d)),
    "sentence_statistics": lambda s, d: search.sentence_statistics(_documents(s, d)),
    "filter_word": lambda s, d: search.search_word(_documents(s, d), "The"),
    "filter_phrase_case": lambda s, d: search.search_word(_documents(s, d), "of the", case_sensitive=True),
    "filter_word_by_attr": filter_word_by_attr,
    "category_terms": lambda s, d: _terms(s),
    "category_hits_by_term": category_hits_by_term,
    "clean_text": lambda s, d: corpus.cleaned(_documents(s, d)),
    "tokens": lambda s, d: _bow(s, d).select("doc_id", "tokens_text", F.col("token_count").cast("long").alias("token_count")),
    "token_summary": lambda s, d: corpus.token_summary(_bow(s, d)),
    "vocab_df_pruned": lambda s, d: corpus.vocabulary(_bow(s, d), keep=None),
    "temporal_classified": lambda s, d: _classified(s, d).drop("start"),
    "text_position": text_position,
    "pacing_by_document": lambda s, d: pacing.by_document(_classified(s, d)),
    "pacing_by_section": lambda s, d: pacing.by_section(_positioned(s, d)),
    "pacing_by_position": lambda s, d: pacing.by_position(_positioned(s, d)),
    "section_means": lambda s, d: pacing.section_means(pacing.by_section(_positioned(s, d))),
    "pacing_report": lambda s, d: pacing.report(_classified(s, d)),
    "pacing_dominant": lambda s, d: pacing.dominant_categories(pacing.by_document(_classified(s, d))),
    "duration_histogram": lambda s, d: pacing.duration_histogram(_classified(s, d)),
    "pacing_top_docs": pacing_top_docs,
    "entities": _entities,
    "entities_by_sentence": lambda s, d: entities.by_sentence(_entities(s, d), samples.annotated_sentences(s, d)),
    "entities_by_document": entities_by_document,
    "entity_top20": lambda s, d: entities.top_texts(_entities(s, d)),
    "entity_freq_min_count": lambda s, d: entities.frequencies(_entities(s, d), 2, exclude=["Gestapo"]),
    "entity_report": lambda s, d: entities.report(_entities(s, d)),
    "verbs": _verbs,
    "verb_summary": lambda s, d: verbs.summary(_verbs(s, d)),
    "verb_report": lambda s, d: verbs.report(_verbs(s, d)),
    "verb_quadrants": lambda s, d: verbs.quadrants(_verbs(s, d)),
    "verb_filter": lambda s, d: verbs.select(_verbs(s, d), "beat", "passive", "affirmative").select("doc_id", "sentence_idx", "verb_text", "verb_idx_in_sentence"),
    "verb_list": lambda s, d: verbs.most_frequent(_verbs(s, d)),
    "verb_suggest": lambda s, d: verbs.suggest(_verbs(s, d), "walt"),
    "gender_classified": gender_classified,
    "gender_counts": lambda s, d: corpus.value_counts(gender_classified(s, d), "gender", ["female", "male", "unknown"]),
    "header_fields": lambda s, d: _metadata(s, d).select(*HEADER),
    "bio_fields": lambda s, d: _metadata(s, d).select(*BIO),
    "internment_fields": lambda s, d: _metadata(s, d).select(*INTERNMENT),
    "sections": lambda s, d: _metadata(s, d).select(*SECTIONS),
    "metadata_fill_rates": lambda s, d: corpus.fill_rates(_metadata(s, d).select(*HEADER, *BIO[1:], *INTERNMENT[1:])),
    "section_closings": lambda s, d: metadata.with_sections(samples.closed_testimonies(s, d)).select("doc_id", "content_summary", "testimony_body", "interviewer_assessment", "warnings"),
    "section_warnings": lambda s, d: metadata.with_sections(samples.incomplete_testimonies(s, d)).select("doc_id", "warnings"),
    "text_files": text_files,
    "pdf_corpus": pdf_corpus,
    "csv_projection": csv_projection,
    "corpus_stored": corpus_stored,
    "word_list": word_list,
    "entities_resumed": entities_resumed,
    "display_ids": display_ids,
    "first_documents": lambda s, d: search.first_documents(_documents(s, d).select("doc_id", "lang"), 10),
    "cloud_words": lambda s, d: entities.frequencies(_entities(s, d), 2, max_words=5, noise=True),
    "marker_positions": marker_positions,
    "rule_sentences": rule_sentences,
    "verbs_from_parse": lambda s, d: verbs.from_dependencies(samples.parsed_tokens(s, d)),
    "pacing_full_report": pacing_full_report,
    "verb_full_report": verb_full_report,
    "ner_full_report": ner_full_report,
    "lda_doc_topics": lda_doc_topics,
    "lda_topic_words": lambda s, d: topics.topic_words(_lda(s, d)[1]),
    "lda_topic_counts": lambda s, d: topics.topic_counts(lda_doc_topics(s, d)),
    "lda_coherence": lda_coherence,
}

ORACLE_SQL = oracle.SQL
