import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import annotators, corpus, entities, pacing, search, topics, verbs
from lectern.sources import readers, sinks
from lectern.streaming.search import document_stream, search_stream

DOCS = [(1, "The camp was cold. We saw the gate."), (2, None), (3, " "), (4, "Camp! No camp gate here.")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_search_rows_in_term_order(docs):
    got = [tuple(r) for r in search.search_terms(docs, ["gate", "camp", "camp gate"]).orderBy("doc_id", "sentence_idx").collect()]
    assert got == [(1, 0, "camp", "The camp was cold."), (1, 1, "gate", "We saw the gate."), (4, 0, "camp", "Camp!"), (4, 1, "gate", "No camp gate here."), (4, 1, "camp", "No camp gate here."), (4, 1, "camp gate", "No camp gate here.")]
    assert search.search_terms(docs, []).count() == 0


def test_statistics_count_empty_documents(docs):
    assert tuple(search.sentence_statistics(docs).first()) == (4, 4, 1.0)
    assert tuple(search.sentence_statistics(docs.limit(0)).first()) == (0, 0, None)


def test_display_id_and_text_column(spark):
    df = spark.createDataFrame([(5, "x"), (None, "y")], "testimony_number long, full_text string")
    assert sorted(r.display_id for r in search.with_display_id(df).collect()) == ["5", "unknown"]
    assert search.text_column(df) == "full_text"
    with pytest.raises(ValueError):
        search.text_column(df.drop("full_text"))


def test_pacing_ties_positions_and_bins(spark):
    rows = spark.createDataFrame([(1, 0, 0, "day", 1.0, 0.0), (1, 1, 0, "week", 7.0, 0.5), (1, 2, 0, "noise", None, 1.0), (2, 0, 0, "year", None, 0.0)], "doc_id long, sentence_idx int, start int, category string, duration_days double, text_position double")
    got = {r.doc_id: r for r in pacing.by_document(rows).collect()}
    assert got[1].dominant_category == "day" and got[1].n_expressions == 2 and got[1].median_duration_days == 4.0 and got[1].frac_day == 0.5
    assert got[2].median_duration_days is None
    values = [0.0, 0.1, 0.25, 0.5, 0.5, 0.9]
    df = spark.createDataFrame([(v,) for v in values], "text_position double")
    got = [r.b for r in pacing.with_bin(df, 4, "b").orderBy("text_position").collect()]
    assert got == pd.cut(pd.Series(values), 4, labels=False).tolist()
    same = spark.createDataFrame([(0.0,), (0.0,)], "text_position double")
    assert [r.b for r in pacing.with_bin(same, 3, "b").collect()] == pd.cut(pd.Series([0.0, 0.0]), 3, labels=False).tolist()
    assert pacing.report(rows.limit(0)).first().total_date_entities == 0
    placed = pacing.with_position(rows.drop("text_position"), spark.createDataFrame([(1, 3)], "doc_id long, total_sentences long"))
    assert sorted(r.text_position for r in placed.collect()) == [0.0, 0.0, 0.5, 1.0]


def test_entity_filters_and_model_hook(spark):
    sents = spark.createDataFrame([("d", 0, "x"), ("d", 1, "y")], "doc_id string, sentence_idx int, sentence_text string")

    def load():
        found = [{"entity": "B-PER", "word": w, "start": 0, "end": 2, "score": c} for w, c in (("Ab", 0.5), ("Cd", 0.49), ("##ab", 0.9), ("E", 0.9))]
        return lambda texts: [found if t == "x" else [] for t in texts]

    got = entities.extract(sents, model=load)
    assert [(r.text, r.entity_type) for r in got.collect()] == [("Ab", "PER")]
    assert [(r.sentence_idx, r.PER, r.total_entities) for r in entities.by_sentence(got, sents).orderBy("sentence_idx").collect()] == [(0, 1, 1), (1, 0, 0)]
    assert entities.by_document(got.limit(0), sents).columns[:6] == ["doc_id", "PER", "LOC", "ORG", "DATE", "total_entities"]
    assert entities.extract(sents, types=["DATE"]).count() == 0


def test_verbs(spark):
    sents = spark.createDataFrame([("d", 0, "They were not beaten, she walked, and he did not help.")], "doc_id string, sentence_idx int, sentence_text string")
    v = annotators.rule_verbs(sents)
    got = sorted((r.verb_text, r.verb_lemma, r.voice, r.polarity, r.verb_idx_in_sentence) for r in v.collect())
    assert got == [("beaten", "beat", "passive", "negated", 3), ("help", "help", "active", "negated", 12), ("walked", "walk", "active", "affirmative", 6)]
    r = verbs.report(v).first()
    assert r.active + r.passive == r.affirmative + r.negated == r.total_verbs == 3
    assert verbs.report(v.limit(0)).first().passive_ratio == 0.0
    parsed = spark.createDataFrame([("d", 0, "s", "was", "be", "AUX", 1, []), ("d", 0, "s", "beaten", "beat", "VERB", 2, ["auxpass", "neg"])], "doc_id string, sentence_idx int, sentence_text string, text string, lemma string, pos string, idx int, children array<string>")
    assert [(x.verb_lemma, x.voice, x.polarity) for x in verbs.from_dependencies(parsed).collect()] == [("beat", "passive", "negated")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    for name, data in (("b.pdf", b"one|two"), ("a.pdf", b"bad"), ("c.txt", b"no")):
        (tmp_path / "pdf" / name).write_bytes(data)

    def extract(content):
        if content == b"bad":
            raise ValueError("broken")
        return content.decode().split("|")

    got = sorted(tuple(r) for r in readers.read_pdfs(spark, f"file://{tmp_path}/pdf", extract).collect())
    assert got == [("a", "a.pdf", 0, 0, 0, "", "broken"), ("b", "b.pdf", 2, 8, 2, "one\n\ntwo", None)]
    out = f"file://{tmp_path}/txt"
    assert sinks.write_texts(spark.createDataFrame([("x", "a\r\nb"), ("y", "")], "doc_id string, full_text string"), out) == 1
    assert [tuple(r) for r in readers.read_texts(spark, out).collect()] == [("x", "x.txt", "a\nb")]
    (tmp_path / "words").write_text("# c\n The\n\nthe\ncamp \n")
    assert sorted(r.word for r in readers.read_words(spark, f"file://{tmp_path}/words").collect()) == ["camp", "the"]
    (tmp_path / "sheet.csv").write_text('A,B\n"x, X ,y",\n,"z"\n')
    assert sorted(tuple(r) for r in readers.category_terms(readers.read_sheet(spark, f"file://{tmp_path}/sheet.csv")).collect()) == [("A", "x", 1), ("A", "y", 2), ("B", "z", 1)]
    table = spark.createDataFrame([("1", 'a "q"\nb')], "doc_id string, sentence_text string")
    sinks.write_csv(table, f"{tmp_path}/csv")
    assert [tuple(r) for r in readers.read_csv(spark, f"{tmp_path}/csv", "doc_id string, sentence_text string").collect()] == [("1", 'a "q"\nb')]
    sinks.write_report(verbs.report(spark.createDataFrame([], "verb_lemma string, voice string, polarity string, doc_id string")), f"{tmp_path}/report")
    assert '"total_verbs":0' in spark.read.text(f"{tmp_path}/report").first()[0]
    assert sinks.safe_name("Camp gate!", None, "Female") == "camp_gate__Female" and sinks.plain_name("../x") == ".._x"
    rows = []
    assert sinks.write_sheet(table, rows.extend) == 1 and rows[0] == ["doc_id", "sentence_text"]
    assert readers.without_done(table, table, ["doc_id"]).count() == 0


def test_corpus_tables(spark, docs):
    bow = corpus.bag_of_words(docs)
    assert {r.doc_id: r.token_count for r in bow.collect()} == {1: 4, 2: 0, 3: 0, 4: 5}
    rates = {r.field: (r.filled, r.mean_length) for r in corpus.fill_rates(spark.createDataFrame([("a", 0, True), (" ", 2, None)], "t string, n int, b boolean")).collect()}
    assert rates == {"t": (2, 1.0), "n": (1, None), "b": (1, None)}
    blank = spark.createDataFrame([("", ""), (None, "abc")], "name string, testimony_body string")
    assert {r.field: (r.filled, r.mean_length) for r in corpus.fill_rates(blank).collect()} == {"name": (1, None), "testimony_body": (1, 3.0)}


def test_topics(spark):
    rows = [(i, ["apple", "pear", "plum"] * 5 if i % 2 else ["train", "car", "bus"] * 5) for i in range(20)] + [(99, [])]
    bow = spark.createDataFrame(rows, "doc_id long, tokens array<string>").coalesce(1)
    settings = topics.TopicSettings(no_above=0.9, passes=30)
    model = topics.train(bow, 2, settings)
    got = topics.document_topics(bow, model).collect()
    assert all(abs(r.topic_0 + r.topic_1 - 1) < 1e-6 for r in got if r.doc_id != 99)
    words = {}
    for r in topics.topic_words(model, 3).collect():
        words.setdefault(r.topic, set()).add(r.word)
    assert sorted(map(sorted, words.values())) == [["apple", "pear", "plum"], ["bus", "car", "train"]]
    good, bad = topics.coherence(bow, [["apple", "pear"], ["car", "bus"]]), topics.coherence(bow, [["apple", "car"], ["pear", "bus"]])
    assert good > 0.99 > bad
    with pytest.raises(ValueError):
        topics.vectors(bow.where(F.col("doc_id") == 99), settings)


def test_stream_gives_the_batch_result(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = search_stream(document_stream(spark, f"{tmp_path}/in", "doc_id long, text string"), ["camp"], f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, search.search_terms(docs, ["camp"]).collect()))


def test_topics_read_every_document_in_every_pass(spark):
    bow = spark.createDataFrame([(i, ["apple", "pear"] if i % 2 else ["car", "bus"]) for i in range(20)], "doc_id long, tokens array<string>")
    lda = topics.train(bow, 2, topics.TopicSettings(no_above=0.9, passes=3)).lda
    assert (lda.getSubsamplingRate(), lda.getMaxIter()) == (1.0, 3)


def test_csv_keeps_odd_values(spark, tmp_path):
    odd = ["a\r\nb", "a\rb", "x\r", " lead", "trail ", " ", "\t", "\n", "\nx", "\r\n", "\0", "\\", 'a\\"', '"', '""', "a,b", None]  # an empty string reads as null
    rows = [(i, x) for i, x in enumerate(odd)]
    sinks.write_csv(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), f"{tmp_path}/odd")
    assert sorted((r.doc_id, r.text) for r in readers.read_csv(spark, f"{tmp_path}/odd", "doc_id long, text string").collect()) == rows


def test_topics_of_several_k_share_vectors_and_windows(spark):
    bow = spark.createDataFrame([(i, (["apple", "pear"] if i % 2 else ["car", "bus"]) * 60) for i in range(20)] + [(99, [])], "doc_id long, tokens array<string>")
    k, scores = topics.select_k(bow, [3, 2], topics.TopicSettings(no_above=0.9, passes=2))
    assert [s[0] for s in scores] == [2, 3] and k in (2, 3)
    tops = [[["apple", "pear"], ["car", "bus"]], [["apple", "car"]]]
    both = topics.coherences(bow, tops, 7)
    assert both == pytest.approx([topics.coherence(bow, t, 7) for t in tops]) and both[0] > 0.99 > both[1]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pacing_report_classifies_once(spark):
    rows = spark.createDataFrame([(1, 0, 0, "day"), (1, 1, 0, "noise"), (2, 0, 0, "noise"), (3, 0, 0, "year")], "doc_id long, sentence_idx int, start int, category string")
    full = pacing.full_report(rows)
    assert "InMemoryRelation" in _plan(full)
    r = full.first()
    assert (r.total_date_entities, r.meaningful_expressions, r.noise_fraction, r.documents_with_expressions, r.median_expressions_per_doc, r.category_counts.year) == (4, 2, 0.5, 2, 1.0, 1)
    assert r.corpus_dominant_categories == {"day": 1, "year": 1} and pacing.full_report(rows.limit(0)).first().total_date_entities == 0


def test_top_documents_of_dates(spark):
    dates = spark.createDataFrame([(1, 0, 0, "two weeks"), (1, 1, 0, "1850"), (2, 0, 0, "1850")], "doc_id long, sentence_idx int, start int, text string")
    got = pacing.top_documents(dates, pacing.by_document(pacing.classified(dates)), 1)
    assert [(r.doc_id, r.category) for r in got.collect()] == [(1, "week")]


def test_entity_and_verb_reports_find_once(spark):
    sents = spark.createDataFrame([("d", 0, "They were beaten near Lund.")], "doc_id string, sentence_idx int, sentence_text string")
    full = entities.full_report(entities.extract(sents), sents)
    assert "InMemoryRelation" in _plan(full) and full.first().top_entities == {"LOC": {"Lund": 1}}
    full = verbs.full_report(annotators.rule_verbs(sents))
    assert "InMemoryRelation" in _plan(full) and full.first().top_passive_affirmative_verbs == {"beat": 1}


def test_files_are_listed_by_a_task(spark, tmp_path):
    for name in ("a.txt", "b é.txt", "_c.txt", "d.pdf"):
        (tmp_path / name).write_bytes("ż\r\n".encode())
    got = readers.read_texts(spark, f"file://{tmp_path}")
    assert got.inputFiles() == [] and sorted(map(tuple, got.collect())) == [("a", "a.txt", "ż\n"), ("b é", "b é.txt", "ż\n")]
    assert readers.read_texts(spark, f"{tmp_path}/*.txt").count() == 2
