"""Text primitives as Column expressions.

Patterns carry ``(?Ud)``: Unicode classes, and only a line feed ends a line, so that they read text as the reference semantics do.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()

#: A small function-word list for English; a fuller one is a parameter or a word-list file.
STOPWORDS = "a an and are as at be been but by for from had has have he her his i in is it its me my not of on or our she so that the their them they this to was we were which who will with you your".split()


def any_of(words: list[str]) -> str:
    """An alternation of literal words, longest first."""
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


def literal(term: str) -> str:
    """``term`` as a Java pattern that matches just itself."""
    return "".join("\\" + c if not c.isalnum() and not c.isspace() and ord(c) < 128 and c != "_" else c for c in term)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?Ud)^\s+|\s+\z", "")


def collapse(c: Column) -> Column:
    """White-space runs become one space; none at the ends."""
    return strip(F.regexp_replace(c, r"(?Ud)\s+", " "))


def _without_addresses(c: Column) -> Column:
    without_urls = F.when(F.contains(c, F.lit("://")), F.regexp_replace(c, r"(?Ud)https?://\S+", "")).otherwise(c)
    return F.when(F.contains(without_urls, F.lit("@")), F.regexp_replace(without_urls, r"(?Ud)\S+@\S+", "")).otherwise(without_urls)


def clean_text(c: Column) -> Column:
    """Collapse white space, drop web and mail addresses, strip. In that order: what an address leaves may be two spaces."""
    return strip(_without_addresses(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?Ud)\s+", " ")))


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, r"(?Ud)\s+"), lambda w: w != "")


def sentences(c: Column) -> Column:
    """Sentences by the boundary rule: final punctuation, white space, an ASCII capital. Stripped, without blanks; null gives none."""
    # Stripped as a whole: inside, a part ends at its punctuation and starts at a capital.
    return F.filter(F.split(strip(F.coalesce(c, F.lit(""))), r"(?Ud)(?<=[.!?])\s+(?=[A-Z])", -1), lambda s: s != "")


def rule_sentences(c: Column) -> Column:
    """Sentences by punctuation alone: a stand-in for a model's rule-based splitter, not the same as one."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?Ud)(?<=[.!?])[\"'”’)\]]?\s+", -1)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def has_phrase(c: Column, phrase: str, case_sensitive: bool = False) -> Column:
    """A whole-word literal match. A phrase that ends in punctuation needs a word character after it, as word boundaries do."""
    return c.rlike(("(?Ud)" if case_sensitive else "(?iUd)") + rf"\b{literal(phrase)}\b")


def has_any(c: Column, phrases: list[str]) -> Column:
    """Any of the phrases, as ``has_phrase`` finds them: one pattern, to leave out what holds none."""
    return c.rlike(rf"(?iUd)\b(?:{'|'.join(map(literal, phrases))})\b") if phrases else F.lit(False)


def find(c: Column, marker: str, start: Column | int = 0, case_sensitive: bool = False) -> Column:
    """0-based position of ``marker`` at or after ``start``; -1 if there is none."""
    fold = (lambda x: x) if case_sensitive else F.lower
    at = F.lit(start) if isinstance(start, int) else start
    return F.call_function("locate", fold(F.lit(marker)), fold(c), at + 1) - 1


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; null if there is none, or if the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def tokens(c: Column, min_length: int = 2, stopwords: list[str] | None = None, keep_stopwords: bool = False, lemma=None) -> Column:
    """Bag-of-words tokens of cleaned text: letters and inner marks, no numbers, no stopwords, lower-case lemmas.

    ``lemma`` maps a token Column to its lemma Column; by default a token is its own lemma. Custom stopwords match a
    token as written only. No token holds white space, so that stays as it is.
    """
    found = F.regexp_extract_all(_without_addresses(F.coalesce(c, F.lit(""))), F.lit(r"(?Ud)[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"), F.lit(0))
    custom = [w for w in stopwords or [] if w not in STOPWORDS]
    if lemma is None and not custom:
        # A token with a letter is no number, and the lower-case one stands for it in every list.
        left = NUMBER_WORDS if keep_stopwords else [*NUMBER_WORDS, *STOPWORDS]
        return F.filter(F.transform(F.filter(found, lambda w: F.length(w) >= min_length), F.lower), lambda w: (F.length(w) >= min_length) & ~w.isin(*left) & w.rlike(r"\p{L}"))

    def keep(w: Column) -> Column:
        numeric = w.rlike(r"(?Ud)^\p{N}+(?:[-'’]\p{N}+)*$") | F.lower(w).isin(*NUMBER_WORDS)
        stopped = F.lit(False) if keep_stopwords else F.lower(w).isin(*STOPWORDS) | (w.isin(*custom) if custom else F.lit(False))
        return ~numeric & (F.length(w) >= min_length) & ~stopped

    lemmas = F.transform(F.filter(found, keep), lambda w: F.lower(lemma(w) if lemma else w))
    return F.filter(lemmas, lambda w: (F.length(w) >= min_length) & w.rlike(r"(?Ud)\p{L}"))
