"""Benchmark decontamination by template canonicalisation, in built-in functions only.

A text has three canonical forms, word for word:

* ``typed``: numbers, units after a number, and names become typed placeholders, the rest is lower-cased. A name is any word
  that starts with a capital, wherever it stands, so that the first word of a sentence is no exception;
* ``folded``: numbers and units become placeholders, the rest is lower-cased: for copies that lost their capitals;
* ``literal``: lower-cased words, for items of which no folded window is evidence.

Windows of ``WINDOW`` words (all of a shorter item) of the benchmark's forms are hash-joined with those of every document, and
compared in full. Windows with fewer than ``FIXED`` words that are no placeholder are no evidence. In a run of hits at one
alignment of a document with an item, a slot value of the item must always stand for one value of the document (whatever
its case). A document is contaminated by an item if consistent hits cover at least ``RUN`` words (or all that is evidence in a
shorter item): in a run without a gap, or over a whole alignment that is consistent. So a slot that differs elsewhere
doesn't hide a verbatim run. An item of fewer than ``FIXED`` words contaminates only a document that holds nothing else.

The hashes of the benchmark's windows are broadcast if their counted number is within a bound; beyond it, documents' hashes
are shuffled, without words, and the documents that have hits are read again. Hits are pre-aggregated by alignment.

Defined results: null texts count as empty and match nothing, null ids are kept as ids; rows repeated with one id are
one document; items repeated with one id are one item; empty tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_ROWS, materialize, small, table, without

WINDOW, RUN, FIXED = 8, 13, 4

# Units that may follow a number.
UNITS = "km cm mm m kg mg g lb lbs oz ml l km/h mph % °c °f hz khz mhz ghz kb mb gb tb ms s sec min h hr hrs hours hour minutes minute seconds second days day weeks week months month years year miles mile feet foot ft inches inch in yards yard meters metres meter metre kilometers kilometres liters litres grams kilograms pounds ounces dollars dollar cents cent euros euro usd eur gbp percent degrees"

SPACE = " \t\n\x0b\f\r"
NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
ANY_UNIT = "(?:" + "|".join(sorted((u.replace("/", "\\/") for u in UNITS.split()), key=lambda u: (-len(u), u))) + ")"
UNIT = r"(?i)(<num>\s?)" + ANY_UNIT + r"(?![\p{L}\p{N}])"
NAME = r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{L}*"
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+$"


TYPED, FOLDED, LITERAL = 0, 1, 2


def forms(text: Column) -> list[Column]:
    """The canonical texts, by kind; white space, and so the number of words, stays as it is."""
    numbered = F.regexp_replace(text, NUMBER, "<num>")
    marked = F.when(F.contains(numbered, F.lit("<num>")), F.regexp_replace(numbered, UNIT, "$1<unit>")).otherwise(numbered)
    return [F.lower(F.regexp_replace(marked, NAME, "<name>")), F.lower(marked), F.lower(text)]


def _words(text: Column) -> Column:
    return F.when(text != "", F.split(text, f"[{SPACE}]+")).otherwise(F.array().cast("array<string>"))


def _text(col: str) -> Column:
    return F.trim(F.coalesce(F.col(col), F.lit("")), F.lit(SPACE))


def _slots(template_words: Column) -> Column:
    return F.transform(template_words, lambda w: F.contains(w, F.lit("<num>")) | F.contains(w, F.lit("<unit>")) | F.contains(w, F.lit("<name>")))


def benchmark_windows(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``kind, h, item_id, item_at, place, item_windows, size, item_template, item_words`` of windows that are evidence.

    ``place`` is the ordinal of a window among the ``item_windows`` of its item and kind.
    """
    rows = items.select(F.col(item_col).alias("item_id"), _text(text_col).alias("t")).distinct()
    rows = rows.select("item_id", _words(F.col("t")).alias("w"), F.array(*map(_words, forms(F.col("t")))).alias("c")).where(F.size("w") > 0)
    rows = rows.withColumn("size", F.least(F.size("w"), F.lit(WINDOW)))
    rows = rows.withColumn("item_at", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))))
    rows = rows.select("*", F.posexplode("c").alias("kind", "form"))
    cut = lambda c: F.slice(c, F.col("item_at") + 1, F.col("size"))
    rows = rows.select("kind", "item_id", "item_at", "size", cut("form").alias("item_template"), cut("w").alias("item_words"))
    evident = rows.where((F.col("kind") != LITERAL) & (F.size(F.filter(_slots(F.col("item_template")), lambda s: ~s)) >= FIXED))
    known = evident.where(F.col("kind") == FOLDED).select(F.col("item_id").alias("__item")).distinct()
    other = rows.where(F.col("kind") == LITERAL).join(known, F.col("item_id").eqNullSafe(F.col("__item")), "left_anti")
    found = evident.unionByName(other)
    item = Window.partitionBy("item_id", "kind")
    place = F.dense_rank().over(item.orderBy("item_at"))
    found = found.withColumn("place", place).withColumn("item_windows", F.max("place").over(item))
    return found.withColumn("h", F.xxhash64("kind", "item_template"))


def _hits(text: DataFrame, bench: DataFrame, broadcast_rows: int) -> DataFrame:
    """``__id, at, kind, h, words, seen`` of the documents' windows whose hash the benchmark has."""
    hashes = materialize(bench.select("h", "kind", "size").distinct(), "hashes")
    few = hashes.count() <= broadcast_rows
    sizes = {r[0]: r[1] for r in hashes.groupBy("size").agg(F.max("kind")).collect()}  # at most WINDOW of them
    cut = lambda c: F.slice(c, F.col("at") + 1, F.col("size"))
    found = None
    for size, last in sorted(sizes.items()):
        # Positions are generated, and windows hashed after that, so that all of it is compiled: a lambda over the array isn't.
        kinds = last + 1
        every = F.when(F.size("w") >= size, F.sequence(F.lit(0), (F.size("w") - size + 1) * kinds - 1))
        rows = text.select("*", F.explode(every).alias("i")).select("*", F.expr(f"cast(i div {kinds} AS int)").alias("at"), (F.col("i") % kinds).alias("kind"), F.lit(size).alias("size"))
        form = F.when(F.col("kind") == TYPED, cut("c0")).when(F.col("kind") == FOLDED, cut("c1")).otherwise(cut("c2"))
        rows = rows.withColumn("h", F.xxhash64("kind", form))
        own = hashes.where(F.col("size") == size).select("h")
        if few:
            rows = rows.join(F.broadcast(own), "h", "left_semi")
        else:
            hits = rows.select("h", "__id", "at", "kind").join(own, "h", "left_semi").distinct()
            hits = small(materialize(hits.select(F.col("__id").alias("__hit"), "at", "kind", "h"), "hits"))
            rows = text.join(hits, F.col("__id").eqNullSafe(F.col("__hit"))).withColumn("size", F.lit(size))
        rows = rows.select("__id", "at", "kind", "h", cut("w").alias("words"), form.alias("seen"), F.size("w").alias("doc_size"))
        found = rows if found is None else found.unionByName(rows)
    return found


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row per contaminated document and item: ``id_col, item_id, n_windows, item_windows, coverage, reparameterised``."""
    bench = materialize(benchmark_windows(items, item_col, item_text_col), "bench")
    text = docs.select(F.col(id_col).alias("__id"), _text(text_col).alias("__text"))
    text = text.select("__id", _words(F.col("__text")).alias("w"), *[_words(c).alias(f"c{k}") for k, c in enumerate(forms(F.col("__text")))])
    found = _hits(text, bench, broadcast_rows)
    if found is None:
        empty = docs.limit(0).select(F.col(id_col))
        return empty.select(id_col, F.lit(None).cast(items.schema[item_col].dataType).alias("item_id"), F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("item_windows"), F.lit(0.0).alias("coverage"), F.lit(False).alias("reparameterised"))
    strip = lambda w: F.lower(F.regexp_replace(w, EDGES, ""))
    pairs = F.filter(F.zip_with(F.arrays_zip("item_words", "words"), _slots(F.col("item_template")), lambda p, s: F.when(s, F.struct(strip(p["item_words"]).alias("b"), strip(p["words"]).alias("d")))), lambda p: p.isNotNull())
    pairs = F.when(F.col("kind") == LITERAL, F.filter(pairs, lambda _: F.lit(False))).otherwise(pairs)
    hits = found.join(bench.drop("kind"), "h").where((F.col("seen") == F.col("item_template")) & ((F.col("size") >= FIXED) | (F.col("doc_size") == F.col("size"))))
    hits = hits.select("__id", "item_id", "kind", (F.col("at") - F.col("item_at")).alias("shift"), "place", "item_windows", pairs.alias("pairs"))
    # A hit of rows repeated with one id, or of items repeated with one id, counts once; its pairs are those of all.
    lined = hits.groupBy("__id", "item_id", "kind", "shift", "place").agg(F.max("item_windows").alias("item_windows"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    lined = lined.groupBy("__id", "item_id", "kind", "shift").agg(F.max("item_windows").alias("item_windows"), F.array_sort(F.collect_list(F.struct("place", "pairs"))).alias("hits"))
    need = F.least(F.lit(RUN - WINDOW + 1), F.col("item_windows"))
    merged = lambda some: F.array_distinct(F.flatten(F.transform(some, lambda h: h["pairs"])))
    agree = lambda p: F.size(p) == F.size(F.array_distinct(F.transform(p, lambda x: x["b"])))
    run = lambda i: F.slice("hits", i, need)
    whole = lambda r: F.element_at(r, -1)["place"] - F.element_at(r, 1)["place"] == need - 1
    starts = F.when(F.size("hits") >= need, F.sequence(F.lit(1), F.size("hits") - need + 1)).otherwise(F.array().cast("array<int>"))
    good = F.filter(starts, lambda i: whole(run(i)) & agree(merged(run(i))))
    places = F.when(agree(merged(F.col("hits"))) & (F.size("hits") >= need), F.sequence(F.lit(1), F.size("hits"))).otherwise(F.array_distinct(F.flatten(F.transform(good, lambda i: F.sequence(i, i + need - 1)))))
    lined = lined.withColumn("places", places).where(F.size("places") > 0)
    changed = F.exists("places", lambda i: F.exists(F.element_at("hits", i)["pairs"], lambda p: p["b"] != p["d"]))
    best = lined.groupBy("__id", "item_id").agg(F.max(F.size("places")).cast("long").alias("n_windows"), F.max("item_windows").cast("long").alias("item_windows"), F.min(changed).alias("reparameterised"))
    return best.select(F.col("__id").alias(id_col), "item_id", "n_windows", "item_windows", (F.col("n_windows") / F.col("item_windows")).alias("coverage"), "reparameterised")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that any item contaminates."""
    return without(docs, contamination(docs, items, id_col, text_col).select(id_col), id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_SPACE = r"[ \t\n\x0b\f\r]"


def _sql_forms(rows: str) -> str:
    return rf"""
SELECT id, text, raw, [lower(regexp_replace(marked, '(^|[^\p{{L}}\p{{N}}])\p{{Lu}}\p{{L}}*', '\1<name>', 'g')), lower(marked), lower(raw)] AS forms
FROM (
  SELECT id, text, raw, regexp_replace(regexp_replace(raw, '{NUMBER}', '<num>', 'g'), '(<num>{_SQL_SPACE}?){ANY_UNIT}($|[^\p{{L}}\p{{N}}])', '\1<unit>\2', 'gi') AS marked
  FROM (SELECT DISTINCT id, text, regexp_replace(coalesce(text, ''), '^{_SQL_SPACE}+|{_SQL_SPACE}+$', '', 'g') AS raw FROM {rows})
) WHERE raw <> ''
"""


def _sql_split(text: str) -> str:
    return f"string_split_regex({text}, '{_SQL_SPACE}+')"


def _sql_strip(word: str) -> str:
    return f"lower(regexp_replace({word}, '{EDGES}', '', 'g'))"


#: The same rules, with every window written out and compared as text.
ORACLE_SQL = rf"""
WITH items AS ({_sql_forms("(SELECT item_id AS id, text FROM benchmark)")}),
docs AS ({_sql_forms("(SELECT doc_id AS id, text FROM documents)")}),
item_words AS (
  SELECT id AS item_id, kind, {_sql_split("raw")} AS w, {_sql_split("forms[kind + 1]")} AS c
  FROM items, (SELECT unnest([0, 1, 2]) AS kind)
),
item_windows AS (
  SELECT item_id, kind, pos, size, w[pos + 1 : pos + size] AS w, c[pos + 1 : pos + size] AS c
  FROM (SELECT *, least(len(w), {WINDOW}) AS size, unnest(range(0, len(w) - least(len(w), {WINDOW}) + 1)) AS pos FROM item_words)
),
evident AS (SELECT * FROM item_windows WHERE kind < 2 AND len(list_filter(c, lambda x: NOT regexp_matches(x, '<num>|<unit>|<name>'))) >= {FIXED}),
chosen AS (
  SELECT * FROM evident
  UNION ALL SELECT * FROM item_windows WHERE kind = 2 AND item_id NOT IN (SELECT item_id FROM evident WHERE kind = 1)
),
bench AS (
  SELECT *, array_to_string(c, ' ') AS template, dense_rank() OVER (PARTITION BY item_id, kind ORDER BY pos) AS place,
    count(DISTINCT pos) OVER (PARTITION BY item_id, kind) AS n_item
  FROM chosen
),
doc_words AS (
  SELECT id AS doc_id, kind, size, {_sql_split("raw")} AS w, {_sql_split("forms[kind + 1]")} AS c
  FROM docs, (SELECT DISTINCT kind, size FROM bench)
),
doc_windows AS (
  SELECT doc_id, kind, size, pos, len(w) AS doc_size, w[pos + 1 : pos + size] AS w, array_to_string(c[pos + 1 : pos + size], ' ') AS template
  FROM (SELECT *, unnest(range(0, len(w) - size + 1)) AS pos FROM doc_words)
),
hits AS (
  SELECT doc_id, item_id, kind, d.pos - b.pos AS shift, place, n_item, least({RUN - WINDOW + 1}, n_item) AS need, b.c, b.w AS bw, d.w AS dw
  FROM doc_windows d JOIN bench b USING (kind, size, template) WHERE size >= {FIXED} OR doc_size = size
),
slots AS (
  SELECT doc_id, item_id, kind, shift, place, {_sql_strip("b")} AS b, {_sql_strip("d")} AS d
  FROM (SELECT doc_id, item_id, kind, shift, place, unnest(c) AS c, unnest(bw) AS b, unnest(dw) AS d FROM hits WHERE kind < 2)
  WHERE regexp_matches(c, '<num>|<unit>|<name>')
),
places AS (SELECT DISTINCT doc_id, item_id, kind, shift, place, n_item, need FROM hits),
agreeing AS (
  SELECT doc_id, item_id, kind, shift FROM places p LEFT JOIN slots s USING (doc_id, item_id, kind, shift, place)
  GROUP BY ALL HAVING count(DISTINCT place) >= any_value(need) AND count(DISTINCT b) = count(DISTINCT (b, d)) FILTER (WHERE b IS NOT NULL)
),
runs AS (
  SELECT a.doc_id, a.item_id, a.kind, a.shift, a.place AS first, a.need
  FROM places a JOIN places b USING (doc_id, item_id, kind, shift) LEFT JOIN slots s ON (s.doc_id, s.item_id, s.kind, s.shift, s.place) = (b.doc_id, b.item_id, b.kind, b.shift, b.place)
  WHERE b.place BETWEEN a.place AND a.place + a.need - 1
  GROUP BY ALL HAVING count(DISTINCT b.place) = a.need AND count(DISTINCT s.b) = count(DISTINCT (s.b, s.d)) FILTER (WHERE s.b IS NOT NULL)
),
good AS (
  SELECT p.* FROM places p JOIN agreeing USING (doc_id, item_id, kind, shift)
  UNION SELECT p.* FROM places p JOIN runs r ON (p.doc_id, p.item_id, p.kind, p.shift) = (r.doc_id, r.item_id, r.kind, r.shift) AND p.place BETWEEN r.first AND r.first + r.need - 1
),
lines AS (
  SELECT doc_id, item_id, kind, shift, count(DISTINCT place) AS n, any_value(n_item) AS n_item, coalesce(bool_or(b <> d), false) AS changed
  FROM good LEFT JOIN slots USING (doc_id, item_id, kind, shift, place) GROUP BY ALL
)
SELECT doc_id, item_id, max(n) AS n_windows, max(n_item) AS item_windows, max(n) / max(n_item) AS coverage, bool_and(changed) AS reparameterised
FROM lines GROUP BY doc_id, item_id
"""
