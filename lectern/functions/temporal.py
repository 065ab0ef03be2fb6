"""Temporal expressions: category and implied length in days, as one ordered CASE.

The rules are tried in the order of ``_rules``; the first that holds decides. Quirks of the reference semantics are kept by
default: ``half a year`` is a whole year, ``two and a half years`` is two, ``5 May`` is noise, ``10 to 12 days`` a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import collapse

CATEGORIES = ["day", "week", "month", "year", "habitual", "calendar", "season", "noise"]
MEANINGFUL = CATEGORIES[:-1]

# Number words, unit lengths and category defaults in days.
WORD_NUMBERS = {
    "one": 1, "a": 1, "an": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "half": 0.5, "couple": 2,
    "few": 3, "several": 4,
}
UNIT_DAYS = {"day": 1.0, "night": 1.0, "hour": 0.04, "week": 7.0, "month": 30.0, "year": 365.0}
DEFAULT_DAYS = {"day": 1.0, "week": 7.0, "month": 30.0, "year": 365.0, "season": 90.0}

# The vocabulary of the patterns.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
WEEKDAYS = "Sunday|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday"
SEASONS = "spring|summer|autumn|fall|winter"

I = "(?iUd)"  # noqa: E741
AGE = I + r"^(?:\d+-year-old|\d+ years? old|\w+-year-old)$"
FRACTION = I + r"^one-(?:quarter|half|third)$"
YEAR = r"(?Ud)^19\d{2}(?:[–\-]\d{1,2})?$"
LONG_NUMBER = r"(?Ud)^\d{4,}$"
OCR = r"(?Ud)^[\d\s+\[\]/\\]+$"
HABITUAL = I + rf"^(?:(?:daily|weekly|monthly|yearly|all\s+day|all-day|the\s+(?:entire|whole|working|full)\s+day|an\s+entire\s+day|(?:{WEEKDAYS})s?)$|(?:every|each)\b)"
LATER = I + r"^(\w+(?:\s+\w+)?)\s+(day|week|month|year)s?\s+later"
NEXT_DAY = I + r"^(?:the\s+(?:next|following|previous)\s+day|next\s+day|the\s+day\s+(?:before|after)|that\s+(?:day|evening|morning|night|afternoon)|(?:today|tomorrow|yesterday)$|the\s+(?:first|second|third|fourth|fifth|sixth|seventh|same|very)\s+day)"
SEASON = I + rf"^(?:(?:the\s+)?(?:{SEASONS})|Christmas|Easter|(?:early|late|mid-?)\s*(?:{SEASONS}))"
DATE_RANGE = I + rf"(?:{MONTHS}|\d{{1,2}})\s.*\bto\b"
MONTH_YEAR = I + rf"(?:{MONTHS})\s+\d{{4}}"
DAY_REFERENCE = I + r"^(?:(?:the\s+)?day|one\s+day|days|those\s+(?:\w+\s+)?days?|the\s+(?:final|last|first)\s+days?)$"
BARE_MONTH = I + rf"^(?:{MONTHS})$"
COUNTED = I + r"(\w+(?:\s+(?:and\s+)?(?:a\s+)?(?:half)?)?)\s+(day|week|month|year|night|hour)s?|(?:a|an|half\s+a)\s+(day|week|month|year|night|hour)"


def _span(unit: str) -> str:
    return I + rf"(?:\w+(?:\s+\w+)?)-{unit}$|^(?:\w+(?:\s+\w+)?)\s+{unit}s?$"


def _lookup(table: dict[str, float], key: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.try_element_at(F.create_map(*pairs), key)


def parse_number(c: Column) -> Column:
    """A number word or digits. In a phrase with ``half``, words are added up after every ``a`` was deleted, so ``half`` itself adds nothing; nothing at all counts one half."""
    text = F.lower(collapse(c))
    parts = F.split(F.regexp_replace(F.regexp_replace(text, "and", ""), "a", ""), r"(?Ud)\s+")
    total = F.aggregate(parts, F.lit(0.0), lambda sum_, w: sum_ + F.coalesce(_lookup(WORD_NUMBERS, w), F.lit(0.0)))
    halves = F.when(total > 0, total).otherwise(0.5)
    return F.coalesce(_lookup(WORD_NUMBERS, text), F.when(F.contains(text, F.lit("half")), halves).otherwise(text.try_cast("double")))


def _group(c: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def _days(text: Column, category: Column) -> Column:
    """Days that an expression of a category spans: number times unit, or the category's default."""
    low = F.lower(text)
    later = parse_number(_group(low, LATER, 1)) * _lookup(UNIT_DAYS, _group(low, LATER, 2))
    alone = _lookup(UNIT_DAYS, _group(low, COUNTED, 3))
    counted = F.coalesce(alone, parse_number(_group(low, COUNTED, 1)) * _lookup(UNIT_DAYS, _group(low, COUNTED, 2)))
    return F.coalesce(F.when(later != 0, later), F.when(counted != 0, counted), _lookup(DEFAULT_DAYS, category))


def _rule(t: Column) -> Column:
    """Struct of ``category`` and ``how`` its length is told: spelled out, by default, or not at all."""
    low = F.lower(t)
    later_unit, counted_unit = _group(low, LATER, 2), F.coalesce(_group(low, COUNTED, 2), _group(low, COUNTED, 3))

    def result(category: Column | str, how: str) -> Column:
        return F.struct((F.lit(category) if isinstance(category, str) else category).alias("category"), F.lit(how).alias("how"))

    noise, calendar, one_day = result("noise", ""), result("calendar", ""), result("day", "default")
    has = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(low, F.lit(words[0]))
    # A plain word that a pattern needs is looked for first: most rules then cost no pattern.
    rules = [
        ((has("old") & t.rlike(AGE)) | (has("one-") & t.rlike(FRACTION)) | (F.length(t) <= 1), noise),
        (t.rlike(YEAR), calendar),
        (t.rlike(LONG_NUMBER) | t.rlike(OCR), noise),
        (t.rlike(HABITUAL), result("habitual", "")),
        (has("later") & t.rlike(LATER), result(later_unit, "spelled")),
        (t.rlike(NEXT_DAY), one_day),
        (t.rlike(SEASON), result("season", "default")),
        ((has("to") & t.rlike(DATE_RANGE)) | t.rlike(MONTH_YEAR), calendar),
        (has("day") & t.rlike(_span("day")) & ~has("year"), result("day", "spelled")),
        (has("day") & t.rlike(DAY_REFERENCE), one_day),
        *[(has(u) & t.rlike(_span(u)), result(u, "spelled")) for u in ("week", "month", "year")],
        (t.rlike(BARE_MONTH), calendar),
        (t.rlike(I + "^(?:weeks|months|years)$"), result(F.regexp_replace(low, "s$", ""), "")),
        (has("day", "week", "month", "year", "night", "hour") & t.rlike(COUNTED), result(F.when(counted_unit.isin("night", "hour"), "day").otherwise(counted_unit), "spelled")),
    ]
    case = F.when(*rules[0])
    for condition, value in rules[1:]:
        case = case.when(condition, value)
    return case.otherwise(noise)


def classify(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text_clean, category, duration_days``; null text counts as empty, which is noise.

    Each step is generated from an array of one, which keeps the optimizer from writing it out again wherever it is used; not the
    days, so that tables of categories alone don't find them.
    """
    clean = df.select("*", F.explode(F.array(collapse(F.coalesce(text, F.lit(""))))).alias("text_clean"))
    ruled = clean.select("*", F.explode(F.array(_rule(F.col("text_clean")))).alias("__rule"))
    category, how = F.col("__rule.category"), F.col("__rule.how")
    days = F.when(how == "spelled", _days(F.col("text_clean"), category)).when(how == "default", _lookup(DEFAULT_DAYS, category))
    return ruled.select("*", category.alias("category"), days.alias("duration_days")).drop("__rule")
