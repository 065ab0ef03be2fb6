"""Command line: ``python -m lectern STAGE INPUT OUTPUT [options]``, one stage of the analysis from files to files.

Exit codes: 0 done (also without hits), 1 missing input or column, unknown lemma or category, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.operators import corpus, entities, metadata, pacing, search, topics, verbs
from lectern.operators.annotators import ENTITY_SCHEMA, rule_verbs
from lectern.sources import checkpoints, readers, sinks


class Refused(Exception):
    """What ends a stage with exit code 1."""


def _rows(spark: SparkSession, args, *names: str, similar: bool = False) -> tuple[DataFrame, str]:
    """The input's rows, of a gender if asked for, and their text column: the first of ``names``, or the one asked for."""
    df = spark.read.parquet(args.input)
    try:
        text = search.text_column(df, *([args.text_column] if args.text_column else names), similar=similar)
    except ValueError as e:
        raise Refused(e) from e
    if args.gender and "gender" not in df.columns:
        raise Refused("no gender column to filter by")
    return search.with_value(df, "gender", args.gender), text


def _limited(df: DataFrame, args) -> DataFrame:
    return search.first_documents(df, args.max_docs) if args.max_docs else df


def _filled(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.length(strip(F.col(text))) > 0)


def _sentences(df: DataFrame, text: str, doc_id: str = "doc_id") -> DataFrame:
    rows = search.sentence_table(_filled(df, text), text, (doc_id,), rules=True)
    return rows.select(F.col(doc_id).cast("string").alias("doc_id"), "sentence_idx", F.col("sentence").alias("sentence_text"))


def _hook(name: str):
    """The function that ``module:function`` names."""
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError, ValueError) as e:
        raise Refused(f"no function {name!r}: {e}") from e


def _written(rows: DataFrame, args, *names: str | None) -> None:
    """Search hits as a CSV named after the search, or to a remote sheet's tab; none, no file."""
    rows = rows.withColumnRenamed("display_id", "doc_id").cache()
    if rows.isEmpty():
        print("no sentence found")
    elif args.to_sheet:
        sinks.write_sheet(rows, _hook(args.to_sheet))
    else:
        sinks.write_csv(rows, f"{args.output}/{sinks.safe_name(*names)}.csv")


def run_pdf(spark, args):
    table = readers.read_pdfs(spark, args.input).cache()
    sinks.write_parquet(table, f"{args.output}/corpus.parquet")
    sinks.write_texts(table, sinks.as_uri(f"{args.output}/txt"))
    corpus.corpus_summary(table).show()


def run_metadata(spark, args):
    table = metadata.extract_metadata(readers.read_texts(spark, args.input)).cache()
    sinks.write_parquet(table, f"{args.output}/metadata.parquet")
    sinks.write_csv(table, f"{args.output}/metadata.csv", drop=metadata.LONG_TEXTS)
    corpus.fill_rates(table).show(100, False)
    table.select("doc_id", *metadata.LONG_TEXTS).show(args.samples)


def run_bow(spark, args):
    df, text = _rows(spark, args, "testimony_body")
    words = [r.word for r in readers.read_words(spark, args.stopwords).collect()] if args.stopwords else None
    table = corpus.bag_of_words(_limited(df, args), text, min_length=args.min_token_length, stopwords=words, keep_stopwords=args.keep_stopwords).cache()
    sinks.write_parquet(table, f"{args.output}/bow_corpus.parquet")
    corpus.token_summary(table).show()
    table.select(F.substring(text, 1, 200), F.substring("tokens_text", 1, 200)).show(args.samples, False)


def run_topics(spark, args):
    bow = spark.read.parquet(args.input).cache()
    settings = topics.TopicSettings(args.no_below, args.no_above, passes=args.passes, seed=args.seed)
    k, scores = topics.select_k(bow, args.k, settings)
    model = topics.train(bow, k, settings)
    model.save(args.output)
    sinks.write_parquet(topics.document_topics(bow, model), f"{args.output}/lda_topics.parquet")
    sinks.write_csv(spark.createDataFrame(scores, "k int, coherence double"), f"{args.output}/lda_coherence.csv")
    topics.topic_words(model).show(200, False)


def run_entities(spark, args):
    """Documents are counted off before blank ones go. With ``--checkpoint``, an interrupted run goes on where it was."""
    df, text = _rows(spark, args, "testimony_body")
    df = _limited(df, args)
    sentences = _sentences(df, text).cache()
    find = lambda rows: entities.extract(rows, args.min_confidence, args.types)
    found = checkpoints.resumable(sentences, "doc_id", find, args.checkpoint) if args.checkpoint else find(sentences).cache()
    sinks.write_csv(found, f"{args.output}/entities.csv")
    sinks.write_csv(entities.by_sentence(found, sentences), f"{args.output}/entities_by_sentence.csv")
    sinks.write_csv(entities.by_document(found, sentences, df.withColumn("doc_id", F.col("doc_id").cast("string"))), f"{args.output}/entities_by_document.csv")
    sinks.write_report(entities.full_report(found, sentences), f"{args.output}/ner_report.json")
    if args.checkpoint:
        checkpoints.clear(spark, args.checkpoint)


def run_clouds(spark, args):
    found = readers.read_csv(spark, f"{args.input}/entities.csv", ENTITY_SCHEMA)
    exclude = [e.strip() for e in (args.exclude or "").split(",") if e.strip()]
    sinks.write_csv(entities.frequencies(found, args.min_count, exclude, args.max_words, noise=args.no_default_exclude), f"{args.output}/cloud.csv")


def run_pacing(spark, args):
    found = readers.read_csv(spark, f"{args.input}/entities.csv", ENTITY_SCHEMA)
    sentences = readers.read_csv(spark, f"{args.input}/entities_by_sentence.csv", "doc_id string, sentence_idx int, PER long, LOC long, ORG long, DATE long, total_entities long, sentence_text string", ["doc_id", "sentence_idx"])
    rows = pacing.with_position(pacing.classified(found.where("entity_type = 'DATE'")), search.total_sentences(sentences)).cache()
    documents = pacing.by_document(rows)
    tables = {"classified_dates": rows, "pacing_by_document": documents, "pacing_by_section": pacing.by_section(rows, args.sections), "pacing_by_position": pacing.by_position(rows, args.bins)}
    for name, table in tables.items():
        sinks.write_parquet(table, f"{args.output}/{name}.parquet")
    sinks.write_report(pacing.full_report(rows, args.sections), f"{args.output}/pacing_report.json")


def run_verbs(spark, args):
    """Blank documents and other genders go before documents are counted off."""
    df, text = _rows(spark, args, "testimony", similar=True)
    df = search.with_display_id(_limited(_filled(df, text), args), missing="row")
    table = rule_verbs(_sentences(df, text, "display_id")).cache()
    sinks.write_parquet(table, f"{args.output}/verbs.parquet")
    sinks.write_csv(verbs.summary(table), f"{args.output}/verb_summary.csv")
    sinks.write_report(verbs.full_report(table), f"{args.output}/verb_report.json")


def run_verb_filter(spark, args):
    table = spark.read.parquet(args.input)
    if not args.lemma:
        verbs.most_frequent(table).show(50, False)
        return
    if verbs.select(table, args.lemma).isEmpty():
        near = [r.verb_lemma for r in verbs.suggest(table, args.lemma).collect()]
        raise Refused(f"no verb {args.lemma!r}; near it: {', '.join(near) or 'none'}")
    name = sinks.plain_name("_".join(x for x in (args.lemma, args.voice, args.polarity) if x))
    sinks.write_csv(verbs.select(table, args.lemma, args.voice, args.polarity), f"{args.output}/{name}.csv")


def run_search(spark, args):
    df, text = _rows(spark, args, "testimony_body", "testimony")
    if not args.phrase:
        raise Refused("search needs --phrase")
    df = search.with_display_id(df if "gender" in df.columns else df.withColumn("gender", F.lit("")))
    hits = search.search_word(df, args.phrase, text, ("display_id", "gender"), args.case_sensitive)
    _written(hits.select("display_id", "sentence_idx", "sentence", "gender"), args, args.phrase, args.gender)


def run_categories(spark, args):
    df, text = _rows(spark, args, "testimony_body", "testimony")
    sheet = readers.fetch_sheet(spark, _hook(args.from_sheet)) if args.from_sheet else readers.read_sheet(spark, args.sheet)
    terms = readers.category_terms(sheet)
    names = [r.category for r in terms.select("category").distinct().orderBy("category").collect()]
    if args.category not in names:
        raise Refused(f"no category {args.category!r}; there are: {', '.join(names)}")
    _written(search.search_category(search.with_display_id(df), terms, args.category, text=text, keep=("display_id",)), args, args.category, args.gender)


STAGES = {"pdf": run_pdf, "metadata": run_metadata, "bow": run_bow, "topics": run_topics, "entities": run_entities, "clouds": run_clouds, "pacing": run_pacing, "verbs": run_verbs, "verb-filter": run_verb_filter, "search": run_search, "categories": run_categories}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern", description=__doc__.splitlines()[0])
    p.add_argument("stage", choices=STAGES)
    p.add_argument("input")
    p.add_argument("output")
    for name in ("gender", "stopwords", "lemma", "phrase", "sheet", "category", "text-column", "checkpoint", "exclude", "from-sheet", "to-sheet"):
        p.add_argument(f"--{name}")
    p.add_argument("--voice", choices=verbs.VOICES)
    p.add_argument("--polarity", choices=verbs.POLARITIES)
    p.add_argument("--max-docs", type=int)
    p.add_argument("--min-token-length", type=int, default=2)
    p.add_argument("--keep-stopwords", action="store_true")
    p.add_argument("--case-sensitive", action="store_true")
    p.add_argument("--types", nargs="+", default=None)
    p.add_argument("--min-confidence", type=float, default=0.5)
    p.add_argument("--min-count", type=int, default=2)
    p.add_argument("--max-words", type=int, default=150)
    p.add_argument("--no-default-exclude", action="store_true")
    p.add_argument("--samples", type=int, default=3)
    p.add_argument("--sections", type=int, default=3)
    p.add_argument("--bins", type=int, default=20)
    p.add_argument("--k", type=int, nargs="+", default=[5, 10, 15, 20, 25])
    p.add_argument("--no-below", type=int, default=5)
    p.add_argument("--no-above", type=float, default=0.5)
    p.add_argument("--passes", type=int, default=15)
    p.add_argument("--seed", type=int, default=42)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lectern").getOrCreate()
    try:
        STAGES[args.stage](spark, args)
    except (Refused, AnalysisException) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
