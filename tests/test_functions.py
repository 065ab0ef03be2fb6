from pyspark.sql import functions as F

from lectern.functions import fields, temporal, text
from lectern.functions.gender import gender
from lectern.plans.samples import EXPRESSIONS, NAMES


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_temporal_expressions(spark):
    more = [(None, "noise", None), ("", "noise", None), ("X", "noise", None), ("Sundays", "habitual", None), ("one-half", "noise", None), ("4 ], +", "noise", None), ("12345", "noise", None), ("early spring", "season", 90.0), ("fallen", "season", 90.0), ("May to June", "calendar", None), ("June 5 to 7", "calendar", None), ("several nights", "day", 4.0), ("yesterday", "day", 1.0), ("a month or so", "month", 30.0), ("half days", "day", 0.5), ("3-week", "week", 7.0)]
    rows = [(i, *e) for i, e in enumerate([*EXPRESSIONS, *more])]
    df = spark.createDataFrame([r[:2] for r in rows], "i int, text string")
    got = {r.i: (r.category, r.duration_days) for r in temporal.classify(df).collect()}
    assert {rows[i][1]: v for i, v in got.items()} == {r[1]: (r[2], r[3]) for r in rows}


def test_gender(spark):
    assert column(spark, [n for n, _ in NAMES], gender) == [g for _, g in NAMES]


def test_sentences(spark):
    got = column(spark, ["A one. B two!  C. d? E", " \n", None, "a. b. c", "Zażółć! Ćma. X. Y"], text.sentences)
    assert got == [["A one.", "B two!", "C. d?", "E"], [], [], ["a. b. c"], ["Zażółć! Ćma.", "X.", "Y"]]


def test_clean_text_and_tokens(spark):
    assert column(spark, ["a  http://x.y b\n me@h.org c", None], text.clean_text) == ["a  b  c", ""]
    assert column(spark, ["The 12 camps, twenty-one 3rd Wózek's x ab2 two!", None], text.tokens) == [["camps", "twenty-one", "3rd", "wózek's", "ab2"], []]
    assert column(spark, ["Camp camp the"], lambda c: text.tokens(c, stopwords=["camp"])) == [["camp"]]


def test_phrases_are_literal_whole_words(spark):
    values = ["a camp.", "CAMP gate", "camps", "ÉLAN vital", "x+y z", "a.b", "a. b"]
    has = lambda q, **o: column(spark, values, lambda c: text.has_phrase(c, q, **o))
    assert has("camp") == [True, True, False, False, False, False, False]
    assert has("camp", case_sensitive=True) == [True, False, False, False, False, False, False]
    assert has("élan") == [False, False, False, True, False, False, False]
    assert has("x+y") == [False] * 4 + [True, False, False]
    assert has("a.") == [False] * 5 + [True, False]


def test_find(spark):
    assert column(spark, ["xAbab"], lambda c: text.find(c, "ab")) == [1] and column(spark, ["xAbab"], lambda c: text.find(c, "ab", 2)) == [3]
    assert column(spark, ["xAbab"], lambda c: text.find(c, "ab", 0, True)) == [3] and column(spark, ["x"], lambda c: text.find(c, "q")) == [-1]


def test_header_fields(spark):
    def header(block):
        df = spark.createDataFrame([(block,)], "b string")
        return df.select(*[c.alias(k) for k, c in fields.header(F.col("b")).items()]).first().asDict()

    got = header("Lund, 12 December 1945\nTRANSCRIBED\nTestimony received by Institute Assistant Jan Lis, LL M Transcribed\nRecord of Witness testimony 17")
    assert got == {"testimony_place": "Lund", "testimony_date": "12 December 1945", "recorder": "Institute Assistant Jan Lis, LL M Transcribed", "recorder_role": "Institute Assistant", "recorder_name": "Jan Lis", "testimony_number": 17, "is_transcribed": True, "is_confidential": False}
    assert header("7 February 1947")["testimony_date"] == "7 February 1947" and header("7 February 1947")["testimony_place"] is None
    got = header("12 December 1945")  # kept as the reference semantics have it
    assert (got["testimony_place"], got["testimony_date"]) == ("1", "2 December 1945")
    got = header("Testimony recorded by Ms Ewa Lis testimony accepted by Institute")
    assert (got["recorder_role"], got["recorder_name"]) == (None, "Ewa Lis")
    assert all(v in (None, False) for v in header(None).values())


def test_biography_and_internment(spark):
    block = "Here stands Mr Jan\nLis [note: x] born on 1 May 1910 in Łódź, occupation a baker, religion , religion Catholic, nationality Polish, husband – Adam, identification document: pass, proof of identity provided card 7, current place of residence Lund."
    df = spark.createDataFrame([(block, "I was arrested in Łódź on 1 May 1943 I was moved bearing the number 1 234 wearing a - coloured triangle with the letter none. I was")], "b string, i string")
    got = df.select(*[c.alias(k) for k, c in fields.biography(F.col("b")).items()]).first().asDict()
    assert got == {"title": "Mr", "name": "Jan Lis", "birth_date": "1 May 1910", "birthplace": "Łódź", "occupation": "baker", "religion": "Catholic", "nationality": "Polish", "parents_forenames": None, "husband": "Adam", "proof_of_identity": "card 7", "last_residence_poland": None, "current_residence": "Lund"}
    got = df.select(*[c.alias(k) for k, c in fields.internment(F.col("i")).items()]).first().asDict()
    assert got == {"arrest_place": "Łódź", "arrest_date": "1 May 1943", "prisoner_number": "1 234", "triangle_color": None, "triangle_letter": None}
