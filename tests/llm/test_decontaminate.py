import re
from collections import defaultdict

import pytest
import regex

from lectern.llm import decontaminate as dec

ITEMS = [
    (1, "If Anna buys 3 apples for 12 euros then how much does Anna pay for 9 apples in the same shop?"),
    (2, "what is the capital city of the country"),
    (3, None),
    (4, ""),
    (5, "one two three"),
    (6, "The train from Paris goes 80 km/h for 2 hours and stops, how far is it from Lyon when it has run dry of coal today?"),
]
DOCS = [
    (1, "x y. If Anna buys 3 apples for 12 euros then how much does Anna pay for 9 apples in the same shop? z"),
    (2, "If Omar buys 4 apples for 20 dollars then how much does Omar pay for 8 apples in the same shop?"),
    (3, "If Omar buys 4 apples for 20 dollars then how much does Lena pay for 8 apples in the same shop?"),
    (4, "so WHAT is the capital city of the country then"),
    (5, "one two three"),
    (6, None),
    (7, ""),
    (8, "how much does Anna pay for 9 apples in"),
    (9, "The train from Rome goes 95 mph for 3 hours and stops, how far is it from Bari when it has run dry of coal"),
    (9, "The train from Rome goes 95 mph for 3 hours and stops, how far is it from Bari when it has run dry of coal"),
    (10, "word " * 50_000 + "what is the capital city of the country"),
]


def brute(docs, items):
    def words(t):
        return re.split(f"[{dec.SPACE}]+", t) if t else []

    def forms(text):
        text = (text or "").strip(dec.SPACE)
        marked = regex.sub(dec.UNIT, r"\1<unit>", regex.sub(dec.NUMBER, "<num>", text))
        return words(text), [words(x.lower()) for x in (regex.sub(r"(?<![\p{L}\p{N}])\p{Lu}\p{L}*", "<name>", marked), marked, text)]

    slot = lambda w: any(p in w for p in ("<num>", "<unit>", "<name>"))
    strip = lambda w: regex.sub(dec.EDGES, "", w).lower()
    out, prepared = set(), [(d, *forms(t), {}) for d, t in docs]
    for i, it in dict.fromkeys(items):
        w, cs = forms(it)
        k = min(dec.WINDOW, len(w))
        if not k:
            continue
        starts = range(len(w) - k + 1)
        evident = [[j for j in starts if sum(not slot(x) for x in c[j : j + k]) >= dec.FIXED] for c in cs[:2]]
        evident.append([] if evident[1] else list(starts))
        for d, dw, dcs, at in prepared:
            best = None
            for kind, windows in enumerate(evident):
                if (kind, k) not in at:
                    at[kind, k] = defaultdict(list)
                    for p in range(len(dw) - k + 1):
                        at[kind, k][tuple(dcs[kind][p : p + k])].append(p)
                lines = defaultdict(list)
                for place, j in enumerate(windows):
                    for p in at[kind, k].get(tuple(cs[kind][j : j + k]), ()):
                        if k >= dec.FIXED or len(dw) == k:
                            lines[p - j].append((place, j))
                need = min(dec.RUN - dec.WINDOW + 1, len(windows))
                for shift, hit in lines.items():
                    pairs = lambda some: {(strip(w[j + q]), strip(dw[j + shift + q])) for _, j in some for q in range(k) if kind < 2 and slot(cs[kind][j + q])}  # noqa: B023, E731
                    agree = lambda some: len(pairs(some)) == len({b for b, _ in pairs(some)})  # noqa: B023, E731
                    runs = [hit[a : a + need] for a in range(len(hit) - need + 1)]
                    runs = [r for r in runs if r[-1][0] - r[0][0] == need - 1 and agree(r)]
                    good = set(hit) if len(hit) >= need and agree(hit) else {x for r in runs for x in r}
                    if good:
                        changed = any(x != y for x, y in pairs(good))
                        best = (max(best[0], len(good)), max(best[1], len(windows)), best[2] and changed) if best else (len(good), len(windows), changed)
            if best:
                out.add((d, i, best[0], best[1], best[0] / best[1], best[2]))
    return out


@pytest.mark.parametrize("rows", [dec.BROADCAST_ROWS, 0])
def test_matches_brute_force(spark, rows):
    docs = spark.createDataFrame([(*d, 7, "x") for d in DOCS], "doc_id long, text string, item_id int, h string")
    items = spark.createDataFrame(ITEMS + ITEMS[:1], "item_id long, text string")
    got = [tuple(r) for r in dec.contamination(docs, items, broadcast_rows=rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(DOCS, ITEMS)
    assert {(r[0], r[1], r[5]) for r in got} == {(1, 1, False), (2, 1, True), (3, 1, True), (4, 2, False), (5, 5, False), (9, 6, True), (10, 2, False)}


FIVE = "The men work for 5 days on the wall and after that they rest in the shade of the old oak for 5 hours, says the old book."
CASES = [  # item, document, whether it is contaminated
    (FIVE, FIVE.replace("5 hours", "6 hours"), True),  # a slot that differs elsewhere doesn't hide a verbatim run
    (FIVE, "The men work for 5 days on the dry wall and after it they rest in a shade of the old oak for 6 hours, says an old book.", False),
    ("Betty is saving money. Betty has 50 coins. Betty wants 100 coins. How many does Betty need?", "Omar is saving money. Omar has 60 coins. Omar wants 120 coins. How many does Omar need?", True),
    ("Betty is saving money. Betty has 50 coins. Betty wants 100 coins. How many does Betty need?", "x betty is saving money. betty has 50 coins. betty wants 100 coins. how many does betty need?", True),
    ("Name the river that Paris and Rouen stand on, and say where it ends.", "they say: please Name the river that Paris and Rouen stand on, and say where it ends.", True),
    ("Solve 3 + 4 now", "please: solve 3 + 4 now, he said; Solve 3 + 4 now or never", True),
    ("Solve 3 + 4 now", "Solve 3 + 5 now", False),
    ("3 4", "3 4", True),
    ("3 4", "they had 3 4 times", False),
    ("1 2 3 4 5 6 7 8 9", "0 1 2 3 4 5 6 7 8 9", True),
    ("1 2 3 4 5 6 7 8 9", "1 2 3 4 5 6 7 8 8", False),
]


@pytest.mark.parametrize("rows", [dec.BROADCAST_ROWS, 0])
def test_names_short_items_and_partly_changed_ones(spark, rows):
    items = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "item_id long, text string")
    docs = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "doc_id long, text string")
    got = [tuple(r) for r in dec.contamination(docs, items, broadcast_rows=rows).collect()]
    assert set(got) == brute([(i, c[1]) for i, c in enumerate(CASES)], [(i, c[0]) for i, c in enumerate(CASES)])
    assert {r[0] for r in got if r[0] == r[1]} == {i for i, c in enumerate(CASES) if c[2]}


def test_drops_and_empty_tables(spark):
    docs = spark.createDataFrame([(*d, 7) for d in DOCS], "doc_id long, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = dec.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [6, 7, 8]
    assert dec.contamination(docs.limit(0), items).collect() == []
    assert dec.contamination(docs, items.limit(0)).collect() == []


def test_stored_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {tuple(r) for r in dec.contamination(docs, items).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
