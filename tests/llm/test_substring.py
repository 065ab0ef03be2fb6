import hashlib

import numpy as np

from lectern.llm import substring


def brute(rows, size):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words, strict=True):
        if doc is not None:
            for i in range(len(w) - size + 1):
                k = tuple(w[i : i + size])
                first[k] = min(doc, first.get(k, doc))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        if doc is not None:
            for i in range(len(w) - size + 1):
                if first[tuple(w[i : i + size])] < doc:
                    gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_automaton_windows():
    r = np.random.default_rng(0)
    docs = [[b"%d" % x for x in r.integers(0, 3, 60)] for _ in range(6)]
    a = substring.Automaton()
    for i, d in enumerate(docs[:5]):
        a.add(d, i)
    a.freeze()
    for size in (1, 3, 5):
        want = []
        for i in range(60 - size + 1):
            holders = [n for n, d in enumerate(docs[:5]) if any(d[j : j + size] == docs[5][i : i + size] for j in range(60 - size + 1))]
            want += [(i, min(holders))] if holders else []
        assert a.windows(docs[5], size) == want


def test_matches_brute_force(spark):
    r = np.random.default_rng(1)
    passages = [[f"p{k}w{x}" for x in range(r.integers(10, 60))] for k in range(30)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(r.integers(1, 6)):
            words += [f"u{x}" for x in r.integers(0, 10**6, r.integers(0, 20))] + passages[r.integers(0, 30)][r.integers(0, 5) :]
        rows.append((int(r.permutation(1000)[0]), " ".join(words)))
    hot = " ".join(passages[0] + passages[1])
    rows += [(2000 + i, hot) for i in range(60)]
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "É x " * 40), (5004, "É x\n" * 40), (5005, "a " * 20000), (5006, "a\v" * 30), (None, hot), (7, hot), (7, hot), (7, hot + " more"), (-3, hot + " x")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, batch string, n_words int")
    got = substring.remove_repeats(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 13)
    assert substring.remove_repeats(df.limit(0)).collect() == []


def test_texts_and_spans(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"a {shared} b"), (2, f"c  d {shared}\n{shared} e")], "doc_id long, text string")
    got = {r.doc_id: r for r in substring.remove_repeats(df, texts=True).collect()}
    assert got[1].n_removed == 0 and got[1].kept == f"a {shared} b"
    assert got[2].kept == "c d e" and got[2].removed == "[[2, 42]]"
