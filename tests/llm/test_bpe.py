import hashlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from lectern.llm import bpe  # noqa: E402

TEXTS = [None, "", " ", "don't I'LL it's  123 ½\n\n x", "a<|endoftext|>b<|endoftext|>", "é" * 2000 + "\x00" + "ab" * 3000, "👩‍👩‍👧 x\x85y\x1c z", "word " * 500]


def test_same_ids_and_text_as_the_library(spark):
    path = bpe.default_vocabulary()
    tok = tokenizers.Tokenizer.from_file(path)
    df = spark.createDataFrame([(i % 6, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    rows = bpe.encode_documents(df, path, texts=True).collect()
    want = []
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        want.append((i % 6, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert sorted(map(tuple, rows)) == sorted(want)
    assert bpe.encode_documents(df.limit(0), path).collect() == []


def test_stale_entries_are_skipped_in_one_long_word():
    model = bpe.Bpe(open(bpe.default_vocabulary(), encoding="utf-8").read())
    tok = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    r = np.random.default_rng(0)
    for n in (1, 2, 50, 20_000):
        word = "".join(chr(97 + c) for c in r.integers(0, 4, n))
        assert model.encode(word) == tok.encode(word, add_special_tokens=False).ids
