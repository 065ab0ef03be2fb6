"""Fields of a testimony's header, biographical and internment blocks, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import collapse, matches, strip

# What can follow a biographical value.
LABELS = (
    r"(?:occupation|profession)\b|religion\b|nationality\b|parents?.?\s*(?:forenames|names|husband)\b|identification\s+document\s*:|husband\b|proof\s+of\s+identity\b|"
    r"last\s+place\s+of\s+residence\b|current\s+place\s+of\s+residence\b|\bwho\s+[–\-]"
)
DATE = r"\d{1,2}\s+\w+\s+\d{4}"


def _trim_end(c: Column) -> Column:
    """Empty if nothing is left, which isn't the same as null: the label was there."""
    return F.regexp_replace(strip(c), r"[ ,.]+$", "")


def _until_label(value: Column) -> Column:
    """A value up to the next label."""
    return _trim_end(F.regexp_replace(value, rf"(?iUds)(?:{LABELS}).*$", ""))


def _after(text: Column, lead: str) -> Column:
    """What follows the first match of ``lead``, up to the next label; null without a match."""
    return _until_label(matches(text, rf"(?iUd){lead}\s+(.+)", 1))


def biography(block: Column) -> dict[str, Column]:
    """The twelve fields of a ``Here stands`` block."""
    t = collapse(F.regexp_replace(F.coalesce(block, F.lit("")), r"\[/?(?:note|stamp)[^\]]*\]", ""))
    titled = matches(t, r"(?Ud)Here stands\s+(?:Ms|Mr|Mrs)\s+(.+?)\s+born on", 1)
    untitled_end = matches(t, r"(?Ud)Here stands\s+(?:Ms|Mr|Mrs)\s+(.+?)(?:\s+born|\s*$)", 1)
    title = matches(t, r"(?Ud)Here stands\s+(Ms|Mr|Mrs)\s+.+", 1)
    name = F.coalesce(titled, untitled_end, matches(t, r"(?Ud)Here stands\s+(.+?)\s+born on", 1))
    born = matches(t, r"(?Ud)born on\s+(.+?)(?:\s+[Ii]n\s|\s*$)", 1)
    born_short = matches(t, r"(?Ud)born (?:on\s+)?(.+?)(?:\s+[Ii]n\s)", 1)
    religions = F.transform(F.slice(F.split(t, r"(?iUd)religion\s+"), 2, 1_000_000), _until_label)
    usable = F.filter(religions, lambda v: (v != "") & ~v.rlike(r"(?Ud)^[,–\-\s]+$") & ~v.startswith(","))
    document = _after(t, r"identification\s+document\s*:")
    return {
        "title": title,
        "name": strip(name),
        "birth_date": F.coalesce(_until_label(born), _trim_end(born_short)),
        "birthplace": _until_label(matches(t, r"(?Ud)born (?:on\s+)?.+?\s+[Ii]n\s+(.+)", 1)),
        "occupation": _until_label(matches(t, r"(?iUd)(?:occupation|profession(?:\s+of)?)\s+(?:a\s+)?(.+)", 1)),
        "religion": F.element_at(F.when(F.size(usable) > 0, usable), -1),
        "nationality": _after(t, "nationality"),
        "parents_forenames": _after(t, r"parents?.?\s*(?:(?:husband.s\s+)?forenames|names)"),
        "husband": _until_label(matches(t, r"(?iUd)husband\s*[–\-]\s*(.+)", 1)),
        "proof_of_identity": F.coalesce(_after(t, "proof of identity provided"), document),
        "last_residence_poland": _after(t, r"last place of residence(?:\s+in Poland)?\s*,?"),
        "current_residence": _after(t, "current place of residence"),
    }


def recorder(raw: Column) -> tuple[Column, Column]:
    """(role, name) of a recorder's line."""
    clean = strip(F.regexp_replace(raw, r"(?iUd)\s+Transcribed$", ""))
    role = matches(clean, r"(?iUd)^(Institute Assistant)\s+.+", 1)
    named = F.regexp_replace(strip(matches(clean, r"(?iUd)^Institute Assistant\s+(.+)", 1)), ",+$", "")
    bare = strip(F.regexp_replace(named, r"(?Ud),?\s*(?:LL\s*M|Master of Law|\[with a Master.s degree in Law\])$", ""))
    accepted = strip(matches(clean, r"(?iUd)^Ms\s+(.+?)\s+testimony accepted by", 1))
    name = F.when(role.isNotNull(), F.when(~bare.isin("", "[not completed]"), bare)).otherwise(F.coalesce(accepted, F.nullif(clean, F.lit(""))))
    return role, name


def header(block: Column) -> dict[str, Column]:
    """The eight fields of the text before ``Here stands``. A date line without a place but with a two-digit day loses the first digit to the place, as in the reference semantics."""
    lines = F.filter(F.transform(F.split(F.coalesce(block, F.lit("")), "\n"), strip), lambda x: x != "")
    dated = F.filter(lines, lambda x: x.rlike(rf"(?Ud)^(?:.+?)?{DATE}$"))
    line = F.get(dated, F.lit(0))
    place = matches(line, rf"(?Ud)^(.+?){DATE}$", 1)
    date = F.coalesce(matches(line, rf"(?Ud)^.+?({DATE})$", 1), matches(line, rf"(?Ud)^({DATE})$", 1))
    received = F.get(F.filter(lines, lambda x: F.lower(x).rlike("testimony (?:received|recorded) by")), F.lit(0))
    raw = strip(matches(received, r"(?iUd)(?:received|recorded)\s+by\s+(.+)", 1))
    role, name = recorder(raw)
    return {
        "testimony_place": F.nullif(strip(F.regexp_replace(strip(place), ",+$", "")), F.lit("")),
        "testimony_date": date,
        "recorder": raw,
        "recorder_role": role,
        "recorder_name": name,
        "testimony_number": matches(F.array_join(lines, " "), r"(?Ud)Record of [Ww]itness [Tt]estimony\s+(\d+)", 1).try_cast("long"),
        "is_transcribed": F.exists(lines, lambda x: F.contains(F.lower(x), F.lit("transcribed"))),
        "is_confidential": F.exists(lines, lambda x: F.contains(F.lower(x), F.lit("confidential"))),
    }


def internment(block: Column) -> dict[str, Column]:
    """The five fields of an internment block; placeholders for colour and letter are null."""
    t = collapse(F.coalesce(block, F.lit("")))
    dated, loose = r"(?Ud)I was arrested in\s+(.+?)\s+on\s+(\d.+?)(?:\s*I was|\s*$)", r"(?Ud)I was arrested in\s+(.+?)\s+on\s+(.+?)(?:\s|$)"
    colour = strip(matches(t, r"(?iUd)wearing a\s+(.+?)\s*-?\s*colou?red\s+triangle", 1))
    letter = matches(t, r"(?iUd)with the letter\s+['\"]?(.+?)['\"]?(?:\s*[.;]\s|\s+I\s|\s+Afterwards|\s+\d+\)|\s*$)", 1)
    letter = F.regexp_replace(strip(letter), r"^['\".,;\- ]+|['\".,;\- ]+$", "")
    return {
        "arrest_place": strip(F.coalesce(matches(t, dated, 1), matches(t, loose, 1))),
        "arrest_date": strip(F.coalesce(matches(t, dated, 2), matches(t, loose, 2))),
        "prisoner_number": matches(t, r"(?Ud)bearing the number\s+(\d[\d\s]*\d|\d+)", 1),
        "triangle_color": F.when(~colour.isin("", "[not completed]", "–", "-", "____"), colour),
        "triangle_letter": F.when((letter != "") & ~F.lower(letter).isin("not completed", "no", "none", "afterwards"), letter),
    }
