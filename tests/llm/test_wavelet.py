import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from lectern.llm import common, wavelet  # noqa: E402

TEXTS = [None, "", "  ", "don't I'LL  ÉCOLE Σας ½ x\x1cy z", "a<|endoftext|>b <|startoftext|>", "é" * 3000, "\x85 x", "word " * 4000, "İstanbul é"]


def test_queries_of_the_matrix_match_a_plain_array():
    r = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (64, 2), (1000, 50), (5000, 49408)):
        v = r.integers(0, top, n).astype(np.uint32)
        ids, counts, m = wavelet.unpack(wavelet.pack([1, None], [n, 0], v))
        assert ids == [1, None] and counts.tolist() == [n, 0]
        assert m.values().tolist() == v.tolist() and m.access(np.arange(n)).tolist() == v.tolist()
        for s in {*v[:20].tolist(), 0, 70000}:
            assert m.occurrences(s).tolist() == np.nonzero(v == s)[0].tolist()
            assert m.rank(s, n // 3, n // 2) == (v[n // 3 : n // 2] == s).sum()


def test_lookups_expand_only_the_blocks_they_touch():
    v = np.random.default_rng(1).integers(0, 50_000, 10 * wavelet.BLOCK).astype(np.uint32)
    data = wavelet.pack([1], [len(v)], v)
    loaded = lambda m: [len(p.loaded) for p in m.planes]
    m = wavelet.unpack(data)[2]
    assert len(m.planes) == 16 and loaded(m) == [0] * 16
    assert m.access([123_456]).tolist() == [v[123_456]] and max(loaded(m)) == 1
    m = wavelet.unpack(data)[2]
    assert m.rank(int(v[0]), 1000, 400_000) == (v[1000:400_000] == v[0]).sum() and max(loaded(m)) <= 2
    m, symbol = wavelet.unpack(data)[2], int(v[600_000])
    want = np.nonzero(v == symbol)[0]
    assert m.select(symbol, [len(want) - 1]).tolist() == want[-1:].tolist() and max(loaded(m)) <= 3
    starts = np.array([0, 5, wavelet.BLOCK, 3 * wavelet.BLOCK - 1])
    assert m.counts(symbol, starts, starts + 200_000).tolist() == [(v[a : a + 200_000] == symbol).sum() for a in starts]


@pytest.mark.parametrize("shard_tokens", [100, 1 << 20])
def test_files_give_back_the_library_s_ids(spark, shard_tokens):
    tok = tokenizers.Tokenizer.from_file(wavelet.default_vocabulary())
    rows = [(9 - i if i < 7 else 3, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id")]
    df = spark.createDataFrame([(*r, "x")[:3] for r in rows], "doc_id long, text string, ids string")
    folder = common.shared_path(spark, "test")
    index = wavelet.write_tokens(df, folder, wavelet.default_vocabulary(), shard_tokens=shard_tokens)
    got = sorted(wavelet.read_tokens(index, folder, ids=True).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for g, w in zip(got, want, strict=True):
        ids = [*tok.encode(w[1] or "", add_special_tokens=False).ids, 1]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (w[0], start, len(ids), ids)
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (g.n_end, g.end_at) == (ids.count(1), start + len(ids) - 1)
        start += len(ids)
    files = spark.read.format("binaryFile").load(folder)
    word = tok.encode("word", add_special_tokens=False).ids[0]
    assert wavelet.occurrences(files, word).count() == 4000


def test_empty_table(spark):
    folder = common.shared_path(spark, "test")
    index = wavelet.write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder, wavelet.default_vocabulary())
    assert index.collect() == [] and wavelet.read_tokens(index, folder).collect() == []


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def ids_of(encoder, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_batch([t.encode() for t in texts])]


def test_words_of_latin_letters_are_encoded_many_at_a_time():
    with open(wavelet.default_vocabulary(), encoding="utf-8") as f:
        encoder = wavelet.Encoder(f.read())
    encoder.tokenizer = counted = Counted(encoder.tokenizer)
    words = [f"{a}é{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    got = ids_of(encoder, [" ".join([*words, *[w + "%%" for w in words], *[w + "," for w in words]])])
    assert counted.texts <= 20
    assert got == [counted.tokenizer.encode(" ".join([*words, *[w + "%%" for w in words], *[w + "," for w in words]]), add_special_tokens=False).ids]


def test_pieces_get_the_library_s_ids():
    with open(wavelet.default_vocabulary(), encoding="utf-8") as f:
        spec = f.read()
    tok, encoder = tokenizers.Tokenizer.from_str(spec), wavelet.Encoder(spec)
    letters = [chr(i) for i in range(0xC0, 0x180)] + ["a", "Z", "Σ", "é"]
    r = np.random.default_rng(2)
    signs = [*letters, *".,;!'_%|<> \t\x1c\x7f\x01019½²×÷́ͅ ΣςÅ中", "'S", "'ll", "<|endoftext|>", "</w>"]
    texts = [a + m for a in letters for m in ("", ".", "'s", "'", "_", "1", "́", "$$%")] + ["".join(r.choice(signs, r.integers(1, 30))) for _ in range(2000)]
    assert ids_of(encoder, texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]
