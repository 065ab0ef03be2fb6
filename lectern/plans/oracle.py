"""DuckDB SQL that computes the same results by other means: markers for lookbehind, inlined lists, values known by construction."""

from __future__ import annotations

from lectern.functions.temporal import CATEGORIES, MEANINGFUL, MONTHS
from lectern.functions.text import NUMBER_WORDS, STOPWORDS
from lectern.operators.annotators import BE, IRREGULAR, NEGATORS, ORG_WORDS, PLACE_LEADS
from lectern.operators.entities import NOISE
from lectern.operators.pacing import HISTOGRAM_EDGES
from lectern.plans import samples as s


def lit(v) -> str:
    return "NULL" if v is None else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def among(words) -> str:
    return "(" + ", ".join(map(lit, sorted(words))) + ")"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def word(c: str, phrase: str, cased: bool = False) -> str:
    edge = "[^\\p{L}\\p{N}_]"
    return f"regexp_matches({c}, '{'' if cased else '(?i)'}(^|{edge}){phrase}($|{edge})')"


SENT = f"""sent AS (
  SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS sentence_idx, unnest(parts) AS sentence, lang FROM (
    SELECT doc_id, lang, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {strip("x")}), lambda x: x <> '') AS parts
    FROM documents WHERE text IS NOT NULL))"""

CLEAN = strip("regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), 'https?://\\S+', '', 'g'), '\\S+@\\S+', '', 'g')")
BOW = f"""bow AS (SELECT doc_id, list_filter(list_transform(list_filter(regexp_extract_all({CLEAN}, '[\\p{{L}}\\p{{N}}]+(?:[''’-][\\p{{L}}\\p{{N}}]+)*'),
    lambda w: NOT regexp_matches(w, '^\\p{{N}}+(?:[-''’]\\p{{N}}+)*$') AND lower(w) NOT IN {among(NUMBER_WORDS)} AND length(w) >= 2 AND lower(w) NOT IN {among(STOPWORDS)}), lambda w: lower(w)), lambda w: regexp_matches(w, '\\p{{L}}')) AS tokens FROM documents)"""

SHEET = f"cells AS (SELECT * FROM (SELECT unnest({[c for c in s.SHEET_COLUMNS]}) AS category, unnest([Nouns, Phrases, Empty]) AS cell, r FROM (VALUES {values([(*row, i) for i, row in enumerate(s.SHEET)])}) t(Nouns, Phrases, Empty, r)) WHERE cell IS NOT NULL)"
TERMS = f"""{SHEET}, raw AS (SELECT category, r, unnest(string_split(cell, ',')) AS t, unnest(range(len(string_split(cell, ',')))) AS i FROM cells),
  firsts AS (SELECT category, r, i, trim(t) AS term FROM raw WHERE trim(t) <> '' QUALIFY row_number() OVER (PARTITION BY category, lower(trim(t)) ORDER BY r, i) = 1)"""

EXPR = f"expr AS (SELECT * FROM (VALUES {values([(i, *e) for i, e in enumerate(s.EXPRESSIONS)])}) t(k, text, category, duration_days))"
DATES = f"""{SENT}, {EXPR}, dates AS (SELECT doc_id, sentence_idx, text, regexp_replace(text, '\\s+', ' ', 'g') AS text_clean, category, CAST(duration_days AS DOUBLE) AS duration_days, 0 AS start
  FROM sent JOIN expr ON k = (doc_id * 31 + sentence_idx) % {len(s.EXPRESSIONS)})"""
PLACED = f"""{DATES}, total AS (SELECT doc_id, CAST(max(sentence_idx) + 1 AS BIGINT) AS total_sentences FROM sent GROUP BY doc_id),
  placed AS (SELECT *, CASE WHEN total_sentences > 1 THEN sentence_idx::DOUBLE / (total_sentences - 1) ELSE 0.0 END AS text_position FROM dates JOIN total USING (doc_id))"""
FRACTIONS = ", ".join(f"round(avg(CASE WHEN category = '{c}' THEN 1.0 ELSE 0.0 END), 6) AS frac_{c}" for c in MEANINGFUL)


def dominant(rows: str, keys: str) -> str:
    return f"(SELECT {keys}, category AS dominant_category FROM (SELECT {keys}, category, count(*) AS k, min(sentence_idx) AS f FROM {rows} GROUP BY {keys}, category) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY k DESC, f) = 1)"


def binned(n: int, name: str) -> str:
    edges = " + ".join(f"CAST({j} * ((hi - lo) / {n}) + lo < text_position AS INTEGER)" for j in range(1, n))
    return f"""{PLACED}, good AS (SELECT * FROM placed WHERE category <> 'noise'), ends AS (SELECT min(text_position) AS lo, max(text_position) AS hi FROM good),
  binned AS (SELECT good.*, {edges} AS {name} FROM good, ends)"""


BY_DOC = f"""{DATES}, good AS (SELECT * FROM dates WHERE category <> 'noise'),
  by_doc AS (SELECT * FROM (SELECT doc_id, count(*) AS n_expressions, median(duration_days) AS median_duration_days, round(avg(duration_days), 6) AS mean_duration_days, {FRACTIONS} FROM good GROUP BY doc_id) JOIN {dominant("good", "doc_id")} USING (doc_id))"""
BY_SECTION = f"""{binned(3, "section")}, by_section AS (SELECT * FROM (SELECT doc_id, section, count(*) AS n_expressions, median(duration_days) AS median_duration_days, {FRACTIONS} FROM binned GROUP BY doc_id, section) JOIN {dominant("binned", "doc_id, section")} USING (doc_id, section))"""

ANNOTATED = f"""{SENT}, phrases AS (SELECT * FROM (VALUES {values(enumerate(s.PHRASES))}) t(k, phrase)),
  ann AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, sentence_idx, sentence || ' ' || phrase AS st FROM sent JOIN phrases ON k = (doc_id * 31 + sentence_idx) % {len(s.PHRASES)})"""
DATE_RE = f"\\b(?:\\d{{1,2}} (?:{MONTHS}) \\d{{4}}|(?:{MONTHS}) \\d{{4}}|(?:one|two|three|four|five|six|seven|eight|nine|ten|several|few|\\d+) (?:day|week|month|year|night|hour)s?(?: later)?|19\\d{{2}})\\b"


def marked(name: str, pattern: str, replacement: str) -> str:
    return f"""{name} AS (SELECT doc_id, sentence_idx, st, string_split(parts[i], chr(2))[1] AS text, CAST(length(replace(array_to_string(parts[1:i - 1], ''), chr(2), '')) AS INTEGER) AS start
  FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM (SELECT doc_id, sentence_idx, st, string_split(regexp_replace(st, '{pattern}', {replacement}, 'g'), chr(1)) AS parts FROM ann)))"""


ENTITIES = f"""{ANNOTATED}, {marked("found_names", "([\\p{Ll},;] )(\\p{Lu}\\p{Ll}+(?: \\p{Lu}\\p{Ll}+)*)", "'\\1' || chr(1) || '\\2' || chr(2)")}, {marked("found_dates", DATE_RE, "chr(1) || '\\0' || chr(2)")},
  ents AS (SELECT text, CASE WHEN regexp_matches(text, '\\b({"|".join(ORG_WORDS)})\\b') THEN 'ORG' WHEN lower(regexp_extract(substring(st, 1, start - 1), '([^ ]*)$', 1)) IN {among(PLACE_LEADS)} THEN 'LOC' ELSE 'PER' END AS entity_type,
      start, CAST(start + length(text) AS INTEGER) AS "end", 0.9::DOUBLE AS confidence, sentence_idx, doc_id FROM found_names
    UNION ALL SELECT text, 'DATE', start, CAST(start + length(text) AS INTEGER), 1.0::DOUBLE, sentence_idx, doc_id FROM found_dates)"""
TYPES = ["PER", "LOC", "ORG", "DATE"]
COUNTS = ", ".join(f"count(*) FILTER (entity_type = '{t}') AS {t}" for t in TYPES) + ", count(*) AS total_entities"

FORM = f"(lower(x) IN {among(IRREGULAR)} OR regexp_matches(x, '^\\p{{L}}{{2,}}[^e\\P{{L}}]ed$'))"
HAS = lambda words: f"len(list_filter(b, lambda y: y IN {among(words)})) > 0"
VERBS = f"""{ANNOTATED}, toks AS (SELECT *, regexp_extract_all(regexp_replace(st, 'n[''’]t\\b', ' n''t', 'g'), 'n''t|[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]') AS w FROM ann),
  each AS (SELECT doc_id, sentence_idx, st, i, w[i] AS x, list_transform(w[greatest(1, i - 3):i - 1], lambda y: lower(y)) AS b FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM toks)),
  vs AS (SELECT doc_id, sentence_idx, st AS sentence_text, x AS verb_text, 'VERB' AS verb_pos, CAST(i - 1 AS INTEGER) AS verb_idx_in_sentence,
      CASE lower(x) {" ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in IRREGULAR.items())} ELSE CASE WHEN regexp_matches(lower(x), '..ied$') THEN regexp_replace(lower(x), 'ied$', 'y') WHEN regexp_matches(lower(x), '[^e]ed$') THEN regexp_replace(lower(x), 'ed$', '') ELSE lower(x) END END AS verb_lemma,
      CASE WHEN {FORM} AND i > 1 AND {HAS(BE)} THEN 'passive' ELSE 'active' END AS voice, CASE WHEN i > 1 AND {HAS(NEGATORS)} THEN 'negated' ELSE 'affirmative' END AS polarity
    FROM each WHERE {FORM} OR (i > 1 AND b[-1] IN {among(NEGATORS)} AND regexp_matches(x, '^\\p{{Ll}}{{3,}}$') AND {HAS(["do", "does", "did"])}))"""

NAMED = f"named AS (SELECT doc_id, name, gender FROM documents JOIN (VALUES {values([(i, *n) for i, n in enumerate(s.NAMES)])}) t(k, name, gender) ON k = doc_id % {len(s.NAMES)})"


def pick(items: list[str], at: str) -> str:
    return f"CASE ({at}) % {len(items)} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(items)) + " END"


N = "CAST(doc_id AS VARCHAR)"
EXPECTED = {
    "doc_id": N, "testimony_place": pick(s.PLACES, "doc_id"), "testimony_date": "CAST(doc_id % 28 + 1 AS VARCHAR) || ' December 1945'", "recorder": f"'Institute Assistant Helena M' || {N}", "recorder_role": "'Institute Assistant'", "recorder_name": f"'Helena M' || {N}", "testimony_number": "doc_id", "is_transcribed": "false", "is_confidential": "false",
    "title": pick(s.TITLES, "doc_id"), "name": f"'Ewa N' || {N}", "birth_date": "'7 May 19' || CAST(doc_id % 30 + 10 AS VARCHAR)", "birthplace": pick(s.PLACES, "doc_id + 1"), "occupation": pick(s.JOBS, "doc_id"), "religion": "'Catholic'", "nationality": "'Polish'", "parents_forenames": "'Jan and Maria'", "husband": "CAST(NULL AS VARCHAR)", "proof_of_identity": "CAST(NULL AS VARCHAR)", "last_residence_poland": "'Łódź'", "current_residence": pick(s.PLACES, "doc_id + 2"), "gender": "'female'",
    "arrest_place": pick(s.PLACES, "doc_id"), "arrest_date": "'3 June 1942'", "prisoner_number": N, "triangle_color": pick(s.COLOURS, "doc_id"), "triangle_letter": "'P'",
    "content_summary": f"'1. Camp life of N' || {N} || '.'", "testimony_body": f"'I remember the winter well, and number ' || {N} || ' too.' || chr(10) || 'We walked for days through the snow.'", "interviewer_assessment": lit(s.INTERVIEW), "warnings": "CAST(NULL AS VARCHAR)",
}


def expected(names: list[str]) -> str:
    return "SELECT " + ", ".join(f"{EXPECTED[n]} AS {n}" for n in names) + " FROM documents"


HEADER = ["doc_id", "testimony_place", "testimony_date", "recorder", "recorder_role", "recorder_name", "testimony_number", "is_transcribed", "is_confidential"]
BIO = ["doc_id", "title", "name", "birth_date", "birthplace", "occupation", "religion", "nationality", "parents_forenames", "husband", "proof_of_identity", "last_residence_poland", "current_residence", "gender"]
INTERNMENT = ["doc_id", "arrest_place", "arrest_date", "prisoner_number", "triangle_color", "triangle_letter"]
SECTIONS = ["doc_id", "content_summary", "testimony_body", "interviewer_assessment", "warnings"]


def fill_rates() -> str:
    rows = []
    for n in [*HEADER[1:], *BIO[1:], *INTERNMENT[1:]]:
        e = EXPECTED[n]
        if n == "testimony_number":
            rows.append(f"SELECT '{n}' AS field, count(*) FILTER ({e} > 0) AS filled, CAST(NULL AS DOUBLE) AS mean_length FROM documents")
        elif n.startswith("is_"):
            rows.append(f"SELECT '{n}' AS field, count(*) FILTER ({e}) AS filled, CAST(NULL AS DOUBLE) AS mean_length FROM documents")
        else:
            rows.append(f"SELECT '{n}' AS field, count(*) FILTER (length({e}) > 0) AS filled, round(avg(length({e})) FILTER (length({e}) > 0), 6) AS mean_length FROM documents")
    return " UNION ALL ".join(rows)


def hits(terms: list[tuple[str, str]]) -> str:
    """Sentences by each (term, pattern) of a category, as the sheet's rules leave them."""
    one = [f"SELECT doc_id, sentence_idx, {lit(t)} AS matched_word, sentence FROM sent WHERE " + (word("sentence", p) if p == t.lower() else f"regexp_matches(sentence, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){p}')") for t, p in terms]
    return f"WITH {SENT}, hits AS (" + " UNION ALL ".join(one) + ")"


# "a." ends in a mark, so a word character must follow it.
NOUNS = [("The", "the"), ("and", "and"), ("in", "in"), ("of", "of"), ("a.", "a\\.[\\p{L}\\p{N}_]")]
PHRASES = [("of the", "of the"), ("It", "it"), ("that thon", "that thon"), ("ing", "ing")]

EDGES = HISTOGRAM_EDGES
SQL = {
    "filter_category": hits(NOUNS) + " SELECT * FROM hits",
    "category_hits_by_term": hits(PHRASES) + " SELECT matched_word, count(*) AS sentences, count(DISTINCT doc_id) AS documents FROM hits GROUP BY 1",
    "corpus_summary": "SELECT count(*) AS documents, CAST(count(*) AS BIGINT) AS n_pages, CAST(coalesce(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''))), 0) AS BIGINT) AS n_words, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars, count(*) FILTER (text = '') AS errors FROM documents",
    "doc_lengths": "SELECT doc_id, length(coalesce(text, '')) AS n_chars, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS n_words FROM documents",
    "sentences": f"WITH {SENT} SELECT doc_id, sentence_idx, sentence FROM sent",
    "sentences_per_doc": f"WITH {SENT} SELECT doc_id, count(*) AS sentence_count FROM sent GROUP BY 1",
    "sentence_counts_max": f"WITH {SENT} SELECT doc_id, CAST(max(sentence_idx) + 1 AS BIGINT) AS total_sentences FROM sent GROUP BY 1",
    "sentence_statistics": f"WITH {SENT} SELECT d.n AS documents, t.n AS sentences, round(t.n::DOUBLE / d.n, 6) AS mean_sentences FROM (SELECT count(*) AS n FROM documents) d, (SELECT count(*) AS n FROM sent) t",
    "filter_word": f"WITH {SENT} SELECT doc_id, sentence_idx, sentence FROM sent WHERE {word('sentence', 'the')}",
    "filter_phrase_case": f"WITH {SENT} SELECT doc_id, sentence_idx, sentence FROM sent WHERE {word('sentence', 'of the', True)}",
    "filter_word_by_attr": f"WITH {SENT} SELECT doc_id, lang, sentence_idx, sentence FROM sent WHERE lower(lang) = 'fr' AND {word('sentence', 'la')}",
    "category_terms": f"WITH {TERMS} SELECT category, term, CAST(row_number() OVER (PARTITION BY category ORDER BY r, i) AS INTEGER) AS position FROM firsts",
    "clean_text": f"SELECT doc_id, {CLEAN} AS clean_text FROM documents",
    "tokens": f"WITH {BOW} SELECT doc_id, coalesce(array_to_string(tokens, ' '), '') AS tokens_text, len(tokens) AS token_count FROM bow",
    "token_summary": f"WITH {BOW} SELECT count(*) AS documents, CAST(sum(len(tokens)) AS BIGINT) AS tokens, round(avg(len(tokens)), 6) AS mean_tokens, median(len(tokens)) AS median_tokens, count(*) FILTER (len(tokens) = 0) AS empty_documents, (SELECT count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM bow)) AS vocabulary FROM bow",
    "vocab_df_pruned": f"WITH {BOW} SELECT term, count(*) AS documents FROM (SELECT unnest(list_distinct(tokens)) AS term FROM bow) GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.5 * (SELECT count(*) FROM bow)",
    "temporal_classified": f"WITH {DATES} SELECT doc_id, sentence_idx, text, text_clean, category, duration_days FROM dates",
    "text_position": f"WITH {PLACED} SELECT doc_id, sentence_idx, total_sentences, round(text_position, 9) AS text_position FROM placed",
    "pacing_by_document": f"WITH {BY_DOC} SELECT * FROM by_doc",
    "pacing_dominant": f"WITH {BY_DOC} SELECT dominant_category, count(*) AS documents FROM by_doc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "pacing_top_docs": f"WITH {BY_DOC} SELECT doc_id, sentence_idx, text_clean, category FROM good WHERE doc_id IN (SELECT doc_id FROM by_doc ORDER BY n_expressions DESC, doc_id LIMIT 10)",
    "pacing_by_section": f"WITH {BY_SECTION} SELECT * FROM by_section",
    "section_means": f"WITH {BY_SECTION} SELECT section, " + ", ".join(f"round(avg(frac_{c}), 5) AS frac_{c}" for c in MEANINGFUL) + " FROM by_section GROUP BY section",
    "pacing_by_position": f"WITH {binned(20, 'position_bin')} SELECT position_bin, round((position_bin + 0.5) / 20, 6) AS position_mid, count(*) AS n_expressions, count(DISTINCT doc_id) AS n_documents, {FRACTIONS} FROM binned GROUP BY position_bin",
    "pacing_report": f"WITH {DATES} SELECT count(*) AS total_date_entities, count(*) FILTER (category <> 'noise') AS meaningful_expressions, count(DISTINCT doc_id) FILTER (category <> 'noise') AS documents_with_expressions, "
    + ", ".join(f"count(*) FILTER (category = '{c}') AS n_{c}, round_even(count(*) FILTER (category = '{c}')::DOUBLE / count(*), 3) AS frac_{c}" for c in CATEGORIES) + " FROM dates",
    "duration_histogram": f"WITH {DATES}, edges AS (SELECT * FROM (VALUES {values([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))])}) t(bin, low, high)) SELECT CAST(bin AS INTEGER) AS bin, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, count(duration_days) AS n FROM edges LEFT JOIN (SELECT * FROM dates WHERE category <> 'noise' AND duration_days > 0) ON duration_days >= low AND (duration_days < high OR (bin = {len(EDGES) - 2} AND duration_days = high)) GROUP BY ALL",
    "entities": f"WITH {ENTITIES} SELECT * FROM ents",
    "entities_by_sentence": f"WITH {ENTITIES} SELECT a.doc_id, a.sentence_idx, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*TYPES, "total_entities"]) + f", st AS sentence_text FROM ann a LEFT JOIN (SELECT doc_id, sentence_idx, {COUNTS} FROM ents GROUP BY ALL) c USING (doc_id, sentence_idx)",
    "entities_by_document": f"WITH {ENTITIES} SELECT e.*, n.sentence_count, d.source AS name, d.lang AS testimony_place FROM (SELECT doc_id, {COUNTS}, " + ", ".join(f"count(DISTINCT text) FILTER (entity_type = '{t}') AS {t}_unique" for t in TYPES) + " FROM ents GROUP BY doc_id) e JOIN (SELECT doc_id, count(*) AS sentence_count FROM ann GROUP BY doc_id) n USING (doc_id) JOIN documents d ON CAST(d.doc_id AS VARCHAR) = e.doc_id",
    "entity_top20": f"WITH {ENTITIES}, c AS (SELECT entity_type, text, count(*) AS n, min((doc_id, sentence_idx, start)) AS f FROM ents GROUP BY ALL) SELECT entity_type, text, n, CAST(row_number() OVER (PARTITION BY entity_type ORDER BY n DESC, f, text) AS INTEGER) AS rank FROM c QUALIFY rank <= 20",
    "entity_freq_min_count": f"WITH {ENTITIES} SELECT entity_type, text, count(*) AS n FROM ents WHERE text NOT IN {among([*NOISE, 'Gestapo'])} GROUP BY ALL HAVING count(*) >= 2",
    "entity_report": f"WITH {ENTITIES} SELECT entity_type, count(*) AS entities, count(DISTINCT text) AS distinct_texts, count(DISTINCT doc_id) AS documents FROM ents GROUP BY 1 UNION ALL SELECT 'ALL', count(*), count(DISTINCT (entity_type, text)), count(DISTINCT doc_id) FROM ents",
    "verbs": f"WITH {VERBS} SELECT * FROM vs",
    "verb_summary": f"WITH {VERBS} SELECT verb_lemma, " + ", ".join(f"count(*) FILTER ({c} = '{v}') AS {v}" for c, v in (("voice", "active"), ("voice", "passive"), ("polarity", "affirmative"), ("polarity", "negated"))) + ", count(*) AS total FROM vs GROUP BY 1",
    "verb_report": f"WITH {VERBS} SELECT count(*) AS total_verbs, count(DISTINCT verb_lemma) AS lemmas, count(DISTINCT doc_id) AS documents, " + ", ".join(f"count(*) FILTER ({c} = '{v}') AS {v}" for c, v in (("voice", "active"), ("voice", "passive"), ("polarity", "affirmative"), ("polarity", "negated"))) + ", round_even(count(*) FILTER (voice = 'passive')::DOUBLE / count(*), 6) AS passive_ratio, round_even(count(*) FILTER (polarity = 'negated')::DOUBLE / count(*), 6) AS negated_ratio FROM vs",
    "verb_quadrants": f"WITH {VERBS}, c AS (SELECT voice, polarity, verb_lemma, count(*) AS n FROM vs GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY voice, polarity ORDER BY n DESC, verb_lemma) AS INTEGER) AS rank, CAST(sum(n) OVER (PARTITION BY voice, polarity) AS BIGINT) AS quadrant_total FROM c QUALIFY rank <= 20",
    "verb_filter": f"WITH {VERBS} SELECT doc_id, sentence_idx, verb_text, verb_idx_in_sentence FROM vs WHERE verb_lemma = 'beat' AND voice = 'passive' AND polarity = 'affirmative'",
    "verb_list": f"WITH {VERBS} SELECT verb_lemma, count(*) AS n FROM vs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "verb_suggest": f"WITH {VERBS} SELECT verb_lemma, count(*) AS n FROM vs WHERE verb_lemma LIKE 'wal%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "gender_classified": f"WITH {NAMED} SELECT * FROM named",
    "gender_counts": f"WITH {NAMED} SELECT " + ", ".join(f"count(*) FILTER (gender = '{g}') AS {g}" for g in ("female", "male", "unknown")) + " FROM named",
    "header_fields": expected(HEADER),
    "bio_fields": expected(BIO),
    "internment_fields": expected(INTERNMENT),
    "sections": expected(SECTIONS),
    "metadata_fill_rates": fill_rates(),
    "section_closings": f"SELECT {N} AS doc_id, '1. Life of N' || {N} || '.' AS content_summary, 'We walked for days, number ' || {N} || '.' AS testimony_body, {pick([(c if own else '') + s.VERDICT for c, own in s.CLOSINGS], 'doc_id')} AS interviewer_assessment, CAST(NULL AS VARCHAR) AS warnings FROM documents",
    "section_warnings": f"SELECT {N} AS doc_id, {pick([*s.WARNINGS, None], 'doc_id')} AS warnings FROM documents",
    "text_files": f"SELECT {N} AS doc_id, {N} || '.txt' AS filename, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents WHERE text <> ''",
    "pdf_corpus": f"SELECT {N} AS doc_id, {N} || '.pdf' AS filename, 2 AS n_pages, CAST(length(t) AS INTEGER) AS n_chars, 3 AS n_words, t AS full_text, CAST(NULL AS VARCHAR) AS error FROM (SELECT *, 'Document ' || {N} || chr(10) || chr(10) || coalesce(lang, 'none') AS t FROM documents)",
    "csv_projection": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "corpus_stored": f"SELECT {N} AS doc_id, {N} || '.pdf' AS filename, 2 AS n_pages, CAST(length(coalesce(text, '')) AS INTEGER) AS n_chars, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS INTEGER) AS n_words, CAST(NULL AS VARCHAR) AS error FROM documents",
    "word_list": f"SELECT DISTINCT lower(trim(w)) AS word FROM (VALUES {values([(w,) for w in s.WORD_LIST])}) t(w) WHERE trim(w) <> '' AND trim(w) NOT LIKE '#%'",
    "entities_resumed": f"WITH {ENTITIES} SELECT * FROM ents",
    "display_ids": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id * 2 AS VARCHAR) ELSE 'row_' || (row_number() OVER (ORDER BY doc_id) - 1) END AS row_id, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id * 2 AS VARCHAR) ELSE 'unknown' END AS display_id FROM documents",
    "first_documents": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 10",
    "cloud_words": f"WITH {ENTITIES} SELECT entity_type, text, count(*) AS n FROM ents GROUP BY entity_type, text HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY entity_type ORDER BY n DESC, text) <= 5",
    "marker_positions": "SELECT doc_id, CASE WHEN strpos(lower(substr(t, 6)), 'the') > 0 THEN strpos(lower(substr(t, 6)), 'the') + 4 ELSE -1 END AS any_case, CASE WHEN strpos(substr(t, 21), 'the') > 0 THEN strpos(substr(t, 21), 'the') + 19 ELSE -1 END AS exact FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "rule_sentences": f"SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS sentence_idx, unnest(parts) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\"''”’)\\]]?\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {strip("x")}), lambda x: x <> '') AS parts FROM documents WHERE text IS NOT NULL)",
    "verbs_from_parse": f"SELECT {N} AS doc_id, 0 AS sentence_idx, 's' AS sentence_text, 'said' AS verb_text, 'say' AS verb_lemma, p AS verb_pos, CASE WHEN a IN ('nsubjpass', 'auxpass') THEN 'passive' ELSE 'active' END AS voice, CASE WHEN b = 'neg' THEN 'negated' ELSE 'affirmative' END AS polarity, 3 AS verb_idx_in_sentence FROM documents JOIN (VALUES {values([(i, *x) for i, x in enumerate(s.PARSES)])}) t(k, p, a, b) ON k = doc_id % {len(s.PARSES)} WHERE p = 'VERB'",
    "pacing_full_report": f"WITH {BY_DOC}, n AS (SELECT count(*) AS total, count(*) FILTER (category = 'noise') AS noise, count(*) FILTER (category = 'day') AS day, count(*) FILTER (category = 'season') AS season FROM dates) SELECT total AS total_date_entities, noise AS noise_filtered, round_even(noise::DOUBLE / total, 3) AS noise_fraction, 3 AS n_sections, round_even((SELECT median(n_expressions) FROM by_doc), 1) AS median_expressions_per_doc, day AS n_day, round_even(season::DOUBLE / total, 3) AS frac_season, least(5, (SELECT count(DISTINCT dominant_category) FROM by_doc)) AS n_dominant FROM n",
    "verb_full_report": f"WITH {VERBS} SELECT count(*) AS total_verbs, " + ", ".join(f"count(*) FILTER (voice = '{v}' AND polarity = '{p}') AS {v}_{p}_count" for v in ("active", "passive") for p in ("affirmative", "negated")) + ", count(*) FILTER (voice = 'passive' AND polarity = 'affirmative' AND verb_lemma = 'beat') AS beat_passive_affirmative FROM vs",
    "ner_full_report": f"WITH {ENTITIES} SELECT (SELECT count(DISTINCT doc_id) FROM ann) AS total_documents, (SELECT count(*) FROM ann) AS total_sentences, count(*) AS total_entities, count(*) FILTER (entity_type = 'LOC') AS n_loc, count(DISTINCT text) FILTER (entity_type = 'PER') AS unique_per, count(*) FILTER (entity_type = 'ORG' AND text = 'Gestapo') AS n_gestapo FROM ents",
}
