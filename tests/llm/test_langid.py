import functools
import zlib

import numpy as np
import pytest

from lectern.llm import langid


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return langid.learn(docs, "doc_id", "text", "lang", sample_docs=60)


def slow_lengths(texts, text):
    """Bits of each byte after training on ``texts``, with plain dictionaries and every symbol written out."""
    counts = {}
    for t in texts:
        b = langid.START + t.encode().lower()
        for i in range(langid.ORDER, len(b)):
            for k in range(langid.ORDER + 1):
                after = counts.setdefault(b[i - k : i], {})
                after[b[i]] = after.get(b[i], 0) + 1

    @functools.cache
    def chances(context):
        shorter = chances(context[1:]) if context else [1 / 256] * 256
        after = counts.get(context)
        if not after:
            return shorter
        total = sum(after.values()) + (len(after) if len(after) < 256 else 0)
        left = sum(shorter[s] for s in range(256) if s not in after)
        return [after[s] / total if s in after else len(after) / total * shorter[s] / left for s in range(256)]

    b = langid.START + text.encode().lower()
    return [chances(b[i - langid.ORDER : i]) for i in range(langid.ORDER, len(b))], b[langid.ORDER :]


TEXTS = {f"l{i}": [f"{w} and the {w[::-1]} {w * i} été", f"{w} ß {i}"] for i, w in enumerate(["house", "maison", "casa", "haus", "dom", "дом", "σπίτι", "家屋", "बड़ा", "talo"])}


@pytest.mark.parametrize("n", [1, 2, 10])
def test_matches_a_slow_model_for_any_number_of_languages(spark, n):
    texts = dict(list(TEXTS.items())[:n])
    df = spark.createDataFrame([(i, t, k) for i, (k, v) in enumerate(texts.items()) for t in v], "doc_id long, text string, lang string")
    ppm = langid.learn(df, "doc_id", "text", "lang", sample_docs=1000)
    assert ppm.langs == sorted(texts)
    for text in ("The HOUSE and 家 été", "домдом", "\0\xff"):
        lengths = ppm.code_lengths(text.encode())
        for i, lang in enumerate(ppm.langs):
            chances, symbols = slow_lengths(texts[lang], text)
            assert all(abs(sum(c) - 1) < 1e-9 for c in chances)
            assert lengths[i] == pytest.approx(-sum(np.log2(c[s]) for c, s in zip(chances, symbols, strict=True)), rel=1e-5)
            context = np.uint64(int.from_bytes((langid.START + text.encode().lower())[-langid.ORDER :], "big"))
            assert np.exp2(-ppm.bits((context << np.uint64(8)) + np.arange(256, dtype=np.uint64)).astype(float)).sum(axis=0) == pytest.approx(1, rel=1e-5)


def test_equal_lengths_go_to_the_first_language(spark):
    df = spark.createDataFrame([(1, "same text", "b"), (2, "same text", "a")], "doc_id long, text string, lang string")
    got = langid.predict(df, langid.learn(df, "doc_id", "text", "lang", sample_docs=1000)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("a", 0.5)] * 2


def test_index_finds_every_number():
    numbers = np.unique(np.random.default_rng(1).integers(0, 2**40, 5000, dtype=np.uint64))
    index = langid.Index(numbers)
    assert (index.find(numbers) == np.arange(len(numbers))).all() and (index.find(numbers + np.uint64(2**41)) == -1).all()
    assert len(langid.Index(numbers[:0]).find(numbers)) == len(numbers)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = langid.query(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_null_blank_unlabelled_and_empty(spark, model):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, "12 ½ !?", "x"), (None, "the of and with that", "x"), (3, "é" * 300_000, "x")], "doc_id long, text string, lang_pred string")
    got = langid.predict(df, model).collect()
    assert [(r.lang_pred == "und", r.score) for r in got[:3]] == [(True, 0.0)] * 3 and got[3].lang_pred == "en" and got[4].lang_pred != "und"
    assert langid.predict(df.limit(0), model).collect() == []
    nothing = langid.learn(df.select("doc_id", "text", df.lang_pred.alias("lang")).limit(0), "doc_id", "text", "lang")
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}
