"""Inputs that the queries build from the driver's tables, with what is known of them by construction.

The stored documents are invented prose without dates, people or testimonies. Each sentence is given one of a fixed
list of expressions, by its document and ordinal; testimonies are built around known field values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.search import sentence_table
from lectern.sources.readers import read_table

#: (text, category, days)
EXPRESSIONS = [
    ("1944", "calendar", None), ("1944-45", "calendar", None), ("1850", "noise", None), ("five days", "day", 5.0), ("a few days later", "day", 3.0), ("two weeks", "week", 14.0),
    ("three  months later", "month", 90.0), ("two and a half years", "year", 730.0), ("half a year", "year", 365.0), ("two hours", "day", 0.08), ("one night", "day", 1.0),
    ("10 to 12 days", "calendar", None), ("May", "calendar", None), ("5 May", "noise", None), ("12 May 1943", "calendar", None), ("days", "day", 1.0), ("years", "year", None),
    ("every morning", "habitual", None), ("the winter of 1944", "season", 90.0), ("20-year-old", "noise", None), ("three years old", "year", 1095.0), ("the next day", "day", 1.0),
    ("morning", "noise", None), ("all\nday", "habitual", None), ("ten weeks", "week", 70.0), ("six weeks later", "week", 42.0), ("Christmas", "season", 90.0), ("in March 1945", "calendar", None),
    ("weekly", "habitual", None),
]

PHRASES = [
    "they met Anna Kowalska in Lund on 12 May 1943 and were beaten there.", "the Red Cross did not help, but Jan Nowak walked to Malbork two weeks later.", "we never talked about Berlin in 1944.",
    "she was taken from Warszawa by Gestapo men, who hadn't asked Ewa Zielińska.", "he asked Ger, and saw Anna Kowalska near Lund.", "nobody came for three days.", "I do not know who told the Swedish Institute that we were hungry.",
    "they were not given bread, and many died in March 1945.",
]

#: (name, gender)
NAMES = [
    (None, "unknown"), ("", "unknown"), ("Name Unknown", "unknown"), ("[sic]", "unknown"), ("Mrs Nowak", "female"), ("Mr. Zaremba", "male"), ("Anna Kowalska", "female"), ("KOWALSKA Anna", "female"), ("Ruth Nowak", "female"),
    ("Kowalski Anna", "female"), ("Jan Nowak", "male"), ("Krzysztof Nowak", "male"), ("Krzysztof Zaremba", "female"), ("Kuba Nowak", "female"), ("Anna Adam", "male"), ("Nowak Zofia [sic]", "female"), ("Ms Halina Lis", "female"),
]

#: Wide sheet: Nouns, Phrases, Empty.
SHEET = [("The, THE , and", "of the", None), (" in,, of ", None, None), (None, "It, that thon", None), ("a.", "ing", None)]
SHEET_COLUMNS = ["Nouns", "Phrases", "Empty"]

TITLES = ["Ms", "Mr", "Mrs"]
PLACES = ["Lund", "Malmö", "Öreryd"]
JOBS = ["nurse", "farm worker", "student"]
COLOURS = ["red", "black"]
INTERVIEW = "The witness gives clear answers, and seems reliable in everything."


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_table(read_table(spark, sf_dir, "documents"))


def annotated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with a phrase each: ``doc_id`` as text, ``sentence_idx, sentence_text``."""
    text = F.concat(F.col("sentence"), F.lit(" "), _pick(PHRASES, F.col("doc_id") * 31 + F.col("sentence_idx")))
    return sentences(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "sentence_idx", text.alias("sentence_text"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One expression for each sentence."""
    return sentences(spark, sf_dir).select("doc_id", "sentence_idx", _pick([e[0] for e in EXPRESSIONS], F.col("doc_id") * 31 + F.col("sentence_idx")).alias("text"), F.lit(0).alias("start"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", _pick([n[0] for n in NAMES], F.col("doc_id")).alias("name"))


def sheet(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(SHEET)], ", ".join(f"{c} string" for c in SHEET_COLUMNS) + ", row long")


def testimonies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One testimony for each document, from values chosen by its id."""
    i = F.col("doc_id")
    n = i.cast("string")
    parts = [
        _pick(PLACES, i), ", ", (i % 28 + 1).cast("string"), " December 1945\nTestimony received by Institute Assistant Helena M", n, "\nRecord of witness testimony ", n, "\n\nHere stands ", _pick(TITLES, i), " Ewa N", n, " born on 7 May 19", (i % 30 + 10).cast("string"), " in ", _pick(PLACES, i + 1),
        ",\noccupation ", _pick(JOBS, i), " religion Catholic nationality Polish\nparents' forenames Jan and Maria last place of residence in Poland Łódź, current place of residence ", _pick(PLACES, i + 2), ".\nwho – having been cautioned about the truth – hereby declares as follows:\nI was arrested in ", _pick(PLACES, i),
        " on 3 June 1942 I was in a camp bearing the number ", n, " wearing a ", _pick(COLOURS, i), " coloured triangle with the letter 'P'. I stayed.\nAsked whether I have anything to add, I state as follows:\n1. Camp life of N", n, ".\n[stamp]\nPOLISH SOURCE INSTITUTE\nIN LUND\n[/stamp]\n1\nI remember the winter well, and number ", n,
        " too.\n12\nWe walked for days through the snow.\n\nRead, signed and accepted\nEwa N", n, "\nWitness\n", INTERVIEW,
    ]
    return read_table(spark, sf_dir, "documents").select(n.alias("doc_id"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))


#: Closing formulas by family, and if the assessment starts at their own line.
CLOSINGS = [
    ("Read, signed and accepted\nEwa N\nWitness\n", False), ("Read and signed\nEwa N\nWitness\n", False), ("After reading\nEwa N\nWitness\n", False), ("After interview\nEwa N\nWitness\n", False), ("Opinion: of the office\n", True), ("Commentary. Short\n", True),
    ("Comments by the office\n", True), ("My comments: few\n", True), ("Some remarks\n", True), ("The testimony was long.\n", True), ("The memoirs of this kind are known.\n", True),
]
VERDICT = "Clear answers were given in everything, and calmly."
MARKERS = ["Here stands", "who – having been cautioned about the truth –", "hereby declares as follows:", "Asked whether I have anything to add, I state as follows:", "[stamp]\nPOLISH SOURCE INSTITUTE\nIN LUND\n[/stamp]"]
WARNINGS = ["No 'Here stands' found", "No oath clause found", "No 'declares as follows' found", "No 'Asked whether' found", "No testimony body boundary found after 'Asked whether'"]


def closed_testimonies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Testimonies with each family of closings; every other one has a printer's line in place of a stamp."""
    i, n = F.col("doc_id"), F.col("doc_id").cast("string")
    mark = F.when(i % 2 == 1, "BLOM'S PRINTING, LUND\n1945\n").otherwise("[stamp]\nPOLISH SOURCE INSTITUTE\nIN LUND\n[/stamp]\n")
    text = F.concat(F.lit("Here stands Ms Ewa N born on 7 May 1910 who – having been cautioned – hereby declares as follows: I was.\nAsked whether, I state as follows:\n1. Life of N"), n, F.lit(".\n"), mark, F.lit("We walked for days, number "), n, F.lit(".\n\n"), _pick([c for c, _ in CLOSINGS], i), F.lit(VERDICT))
    return read_table(spark, sf_dir, "documents").select(n.alias("doc_id"), text.alias("text"))


def incomplete_testimonies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Testimonies without the marker of their turn, or with all."""
    i, n = F.col("doc_id"), F.col("doc_id").cast("string")
    parts = [F.when(i % (len(MARKERS) + 1) == k, "").otherwise(m + "\n") for k, m in enumerate(MARKERS)]
    return read_table(spark, sf_dir, "documents").select(n.alias("doc_id"), F.concat(*[x for p in parts for x in (p, F.lit("Some words.\n"))]).alias("text"))


def pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PDF of two pages for each document, its id on the first, its language on the second."""
    show = lambda c: F.concat(F.lit("<< >>\nstream\nBT ("), c, F.lit(") Tj ET\nendstream"))
    objects = [F.lit("<< /Type /Catalog /Pages 2 0 R >>"), F.lit("<< /Type /Pages /Count 2 /Kids [5 0 R 3 0 R] >>"), F.lit("<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"), show(F.coalesce("lang", F.lit("none"))), F.lit("<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>"), show(F.concat(F.lit("Document "), F.col("doc_id").cast("string")))]
    body = F.concat(F.lit("%PDF-1.4\n"), *[x for k, o in enumerate(objects) for x in (F.lit(f"{k + 1} 0 obj\n"), o, F.lit("\nendobj\n"))])
    return read_table(spark, sf_dir, "documents").select("doc_id", body.alias("full_text"))


PARSES = [("VERB", "nsubj", "neg"), ("VERB", "nsubjpass", "aux"), ("VERB", "auxpass", "neg"), ("NOUN", "neg", "det"), ("VERB", "dobj", "det")]


def parsed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parsed token for each document, its part of speech and its children's labels of a fixed list."""
    i = F.col("doc_id")
    return read_table(spark, sf_dir, "documents").select(i.cast("string").alias("doc_id"), F.lit(0).alias("sentence_idx"), F.lit("s").alias("sentence_text"), F.lit("said").alias("text"), F.lit("say").alias("lemma"), _pick([p[0] for p in PARSES], i).alias("pos"), F.lit(3).alias("idx"), F.array(_pick([p[1] for p in PARSES], i), _pick([p[2] for p in PARSES], i)).alias("children"))


WORD_LIST = ["# comment", " Camp ", "camp", "", "Gate", "łódź"]
