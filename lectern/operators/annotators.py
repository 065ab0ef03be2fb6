"""Annotators: what would need a trained model, behind small interfaces, with rule defaults.

A default is *not* equivalent to a model: it finds what its rules say. A model goes in as a function over pandas batches
(``mapInPandas``), loaded once for each worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import temporal

ENTITY_TYPES = ["PER", "LOC", "ORG", "DATE"]
ENTITY_SCHEMA = "text string, entity_type string, start int, end int, confidence double, sentence_idx int, doc_id string"

# A look at the first letter comes first, as it rules out most places at little cost.
NAME_SPAN = r"(?Ud)(?=\p{Lu})(?<=[\p{Ll},;] )\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*"
DATE_SPAN = (
    rf"(?Ud)(?<![A-Za-z])(?=[\dJFMASONDotfsne])\b(?:\d{{1,2}} (?:{temporal.MONTHS}) \d{{4}}|(?:{temporal.MONTHS}) \d{{4}}|(?:one|two|three|four|five|six|seven|eight|nine|ten|several|few|\d+) (?:day|week|month|year|night|hour)s?(?: later)?|19\d{{2}})\b"
)
ORG_WORDS = ["Committee", "Company", "Cross", "Gestapo", "Institute", "Police", "University"]
PLACE_LEADS = ["in", "at", "from", "to", "near"]

IRREGULAR = {"beaten": "beat", "taken": "take", "taught": "teach", "shot": "shoot", "sent": "send", "given": "give", "went": "go", "saw": "see", "came": "come", "knew": "know", "told": "tell", "gave": "give"}
BE = ["am", "are", "be", "been", "being", "is", "was", "were"]
NEGATORS = ["n't", "never", "not"]


def spans(rows: DataFrame, sentence: str, patterns: dict[str, str]) -> DataFrame:
    """``rows`` with a row for each match of each named pattern: ``kind, text, start``, offsets 0-based within the sentence.

    Matches are marked in the text, whose pieces then give them and their places; sentences without a match go at once.
    """
    marks = F.contains(sentence, F.lit("\x01")) | F.contains(sentence, F.lit("\x02"))
    plain = F.when(marks, F.translate(F.col(sentence), "\x01\x02", "  ")).otherwise(F.col(sentence))
    marked = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_replace(plain, p, "\x01$0\x02").alias("m")) for k, p in patterns.items()])
    found = rows.select("*", F.explode(marked).alias("s")).select("*", "s.kind", "s.m").where(F.contains("m", F.lit("\x01"))).drop("s")
    found = found.select("*", F.posexplode(F.split("m", "\x01", -1)).alias("i", "part")).where("i > 0")
    start = F.length(F.call_function("substring_index", F.col("m"), F.lit("\x01"), F.col("i"))) - 2 * (F.col("i") - 1)
    return found.select(*rows.columns, "kind", F.substring_index("part", "\x02", 1).alias("text"), start.alias("start"))


def rule_entities(sentences: DataFrame, names: bool = True, dates: bool = True) -> DataFrame:
    """Names and dates by rule, in one pass. Names are capitalised spans inside sentences: organisations by a word list, places by
    the preposition before, else persons, with confidence 0.9; dates have confidence 1."""
    patterns = {"NAME": NAME_SPAN} if names else {}
    if dates:
        patterns["DATE"] = DATE_SPAN
    rows = spans(sentences.select("doc_id", "sentence_idx", "sentence_text"), "sentence_text", patterns)
    lead = F.lower(F.substring_index(F.substring(F.col("sentence_text"), F.lit(1), F.col("start") - 1), " ", -1))
    organisation = F.col("text").rlike(r"(?Ud)\b(?:" + "|".join(ORG_WORDS) + r")\b")
    is_date = F.col("kind") == "DATE"
    kind = F.when(is_date, "DATE").when(organisation, "ORG").when(lead.isin(*PLACE_LEADS), "LOC").otherwise("PER")
    # Generated from an array of one: filters on the type would find it again.
    rows = rows.select("*", F.explode(F.array(kind)).alias("entity_type"))
    return rows.select("text", "entity_type", "start", (F.col("start") + F.length("text")).alias("end"), F.when(is_date, 1.0).otherwise(0.9).alias("confidence"), "sentence_idx", "doc_id")


def model_entities(sentences: DataFrame, load: Callable[[], Callable[[list[str]], list[list[dict]]]]) -> DataFrame:
    """Entities by a model: ``load()`` gives a function from sentences to lists of ``entity`` (also as B-PER), ``word``, ``start``, ``end``, ``score``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            rows = [(e["word"], e["entity"].split("-")[-1], e["start"], e["end"], float(e["score"]), i, d) for d, i, found in zip(b["doc_id"], b["sentence_idx"], model(list(b["sentence_text"])), strict=True) for e in found]
            yield pd.DataFrame(rows, columns=["text", "entity_type", "start", "end", "confidence", "sentence_idx", "doc_id"])

    return sentences.select("doc_id", "sentence_idx", "sentence_text").mapInPandas(run, ENTITY_SCHEMA)


def rule_lemma(word: Column) -> Column:
    """A verb's lemma by a small table and endings; other words are their own."""
    low = F.lower(word)
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair]), low)
    ending = F.when(low.rlike("..ied$"), F.regexp_replace(low, "ied$", "y")).when(low.rlike("[^e]ed$"), F.regexp_replace(low, "ed$", "")).otherwise(low)
    return F.coalesce(known, ending)


def rule_verbs(sentences: DataFrame) -> DataFrame:
    """Verbs by form: listed irregular forms and words in -ed (auxiliaries are no verbs here). Passive after a form of be within
    three tokens before; negated after a negator within three tokens before. Also after do not: the word that follows the negator."""
    text = F.col("sentence_text")
    apart = F.when(F.contains(text, F.lit("n't")) | F.contains(text, F.lit("n’t")), F.regexp_replace(text, "n['’]t\\b", " n't")).otherwise(text)
    words = F.regexp_extract_all(apart, F.lit(r"(?Ud)n't|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))
    # Generated once, then token by token, so that all tests are compiled; lambdas over arrays aren't.
    rows = sentences.select("doc_id", "sentence_idx", "sentence_text", F.explode(F.array(words)).alias("w"))
    rows = rows.select("*", F.posexplode("w").alias("i", "word"))
    word, i = F.col("word"), F.col("i")
    before = [F.when(i >= k, F.lower(F.get("w", i - k))) for k in (1, 2, 3)]
    among = lambda values: F.coalesce(before[0].isin(*values), F.lit(False)) | F.coalesce(before[1].isin(*values), F.lit(False)) | F.coalesce(before[2].isin(*values), F.lit(False))
    form = F.lower(word).isin(*IRREGULAR) | (word.endswith("ed") & word.rlike(r"(?Ud)^\p{L}{2,}[^e\P{L}]ed$"))
    bare = F.coalesce(before[0].isin(*NEGATORS), F.lit(False)) & word.rlike(r"(?Ud)^\p{Ll}{3,}$") & among(["do", "does", "did"])
    rows = rows.withColumn("form", form).where(F.col("form") | bare)
    voice = F.when(F.col("form") & among(BE), "passive").otherwise("active")
    polarity = F.when(among(NEGATORS), "negated").otherwise("affirmative")
    return rows.select("doc_id", "sentence_idx", "sentence_text", word.alias("verb_text"), rule_lemma(word).alias("verb_lemma"), F.lit("VERB").alias("verb_pos"), voice.alias("voice"), polarity.alias("polarity"), i.cast("int").alias("verb_idx_in_sentence"))
