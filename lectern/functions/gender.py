"""Gender from a person's name, by titles, known given names, and the ending of Polish given names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import collapse, strip, words

# Given names that the ending would misjudge, or that settle any order of name parts.
FEMALE = (
    "Miriam", "Edith", "Edit", "Esther", "Ester", "Ruth", "Margit", "Judith", "Ingrid", "Astrid", "Gudrun", "Ruchel", "Rachel", "Elisabeth", "Elizabeth", "Carmen", "Ellen", "Helen", "Mignon",
)
MALE = (
    "Adam", "Alfred", "Andrzej", "Antoni", "Arkadjusz", "Bartłomiej", "Bohdan", "Bolesław", "Bonifacy", "Bronisław", "Czesław", "Drew", "Edmund", "Emanuel", "Ernest", "Eugeniusz", "Feliks", "Ferenc",
    "Franciszek", "Genek", "Henryk", "Hersz", "Hieronim", "Izaak", "Izrael", "Jakub", "Jan", "Jerzy", "Józef", "Kanty", "Karol", "Kazimierz", "Leon", "Lucjan", "Ludwik", "Majer", "Marian", "Marjan",
    "Michał", "Mieczysław", "Natan", "Paweł", "Peter", "Piotr", "Roman", "Ryszard", "Stanisław", "Stefan", "Tadeusz", "Wacław", "Wincenty", "Władysław", "Włodzimierz", "Wojciech", "Zbigniew", "Zdzisław",
    "Zygmunt",
)

TITLE = r"(?iUd)^(?:Miss|Mrs\.?|Mr\.?|Ms\.?|M\s+Revd|M\s)\s*"
FEMALE_SURNAME = r"(?iUd)(?:ska|cka|ńska)$"


def gender(name: Column) -> Column:
    """``female``, ``male`` or ``unknown``; a null, empty or unnamed person is unknown."""
    raw = strip(name)
    bare = F.regexp_replace(F.regexp_replace(raw, TITLE, ""), r"(?Ud)\[.*?\]", "")
    parts = words(collapse(F.regexp_replace(bare, r"(?Ud)[\s,;!]+$", "")))
    n = F.size(parts)
    lead = F.element_at(parts, 1)
    shouted = (lead == F.upper(lead)) & (lead != F.lower(lead)) & (n > 1)
    first = F.when(shouted, F.get(parts, F.lit(1))).otherwise(lead)
    listed = F.filter(parts, lambda p: p.isin(*MALE, *FEMALE))
    later = F.exists(F.slice(parts, 2, F.greatest(n - 1, F.lit(0))), lambda p: p.endswith("a") & (F.length(p) > 2) & p.rlike(r"(?Ud)^\p{Lu}") & ~p.rlike(FEMALE_SURNAME))
    return (
        F.when(name.isNull() | (name == "") | (name == "Name Unknown"), "unknown")
        .when(raw.rlike(r"(?iUd)^(?:Mrs|Miss|Ms)\b"), "female")
        .when(raw.rlike(r"(?Ud)^Mr[\s,.]"), "male")
        .when(n == 0, "unknown")
        .when(F.size(listed) > 0, F.when(F.element_at(listed, 1).isin(*MALE), "male").otherwise("female"))
        .when(~first.endswith("a") & (n > 1) & later, "female")
        .when(first.rlike("[aA]$"), "female")
        .otherwise("male")
    )
