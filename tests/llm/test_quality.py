import math

import numpy as np
import pytest

from lectern.llm import quality


def test_trees_learn_an_interaction_and_walk_like_a_loop():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    got = m.score(x[3000:])
    assert ((got >= 0.5) == y[3000:]).mean() > 0.95
    for row, p in zip(x[3000:3050], got, strict=False):
        total = m.base
        for t in range(len(m.leaf)):
            node = 0
            while node < m.feature.shape[1]:
                node = 2 * node + 1 + (row[m.feature[t, node]] > m.threshold[t, node])
            total += m.leaf[t, node - m.feature.shape[1]]
        assert abs(1 / (1 + np.exp(-total)) - p) < 1e-9


def slow_statistics(text):
    """The twenty statistics by loops over characters, words and lines."""
    n, words = max(1, len(text)), text.split()
    w = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x]
    share = lambda test: sum(map(test, text)) / n
    mark = lambda b: 32 < b < 127 and not chr(b).isalnum()
    entropy = -sum(k / n * math.log2(k / n) for k in (text.count(bytes([b])) for b in set(text)))
    count = lambda test: sum(1 for x in words if test(x)) / w
    return [
        math.log1p(len(text)), math.log1p(len(words)), sum(len(x) for x in words) / w,
        share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122), share(lambda b: 48 <= b <= 57), share(mark), share(lambda b: b > 127), len(lines) / w, entropy,
        len(set(words)) / w, sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / w, max((words.count(x) for x in set(words)), default=0) / w, count(lambda x: mark(x[-1])),
        count(lambda x: mark(x[-1]) and len(x) > 1 and mark(x[-2])), max((len(x) for x in words), default=0), 1 - len(set(lines)) / max(1, len(lines)),
        count(lambda x: x.isupper()), count(lambda x: len(x) == 1 and mark(x[0])), sum(x[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)),
    ]


def test_statistics_match_loops(spark):
    texts = ["", " \n\t", "A b, B. b b!\nA b, B. b b!\nÉté 12 ½ -- (x) ?!", "X" * 5000, "\x00\x1f~ `a`"]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    for t in texts:
        assert quality.statistics(t.encode()) == pytest.approx(slow_statistics(t.encode()), rel=1e-9, abs=1e-12)


def slow_fit(x, y, trees, depth, rate=0.15, l2=1.0, least=2.0):
    """Scores after boosting, each split found by trying every cut of every feature on the rows themselves."""
    cuts = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1]).tolist())) for f in range(x.shape[1])]
    raw = [math.log(y.mean() / (1 - y.mean()))] * len(y)
    for _ in range(trees):
        g = [1 / (1 + math.exp(-r)) - v for r, v in zip(raw, y, strict=True)]
        h = [(a + v) * (1 - a - v) for a, v in zip(g, y, strict=True)]
        gain = lambda rows: sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + l2)  # noqa: B023, E731
        leaves = [list(range(len(y)))]
        for _ in range(depth):
            grown = []
            for rows in leaves:
                best, split = 1e-6, (rows, [])
                for f, own in enumerate(cuts):
                    for c in own:
                        a, b = [i for i in rows if x[i, f] <= c], [i for i in rows if x[i, f] > c]
                        if min(sum(h[i] for i in a), sum(h[i] for i in b)) >= least and (value := gain(a) + gain(b) - gain(rows)) > best + 1e-12:
                            best, split = value, (a, b)
                grown += split
            leaves = grown
        for rows in leaves:
            for i in rows:
                raw[i] -= rate * sum(g[j] for j in rows) / (sum(h[j] for j in rows) + l2)
    return [1 / (1 + math.exp(-r)) for r in raw]


def test_fit_matches_a_search_over_all_splits_with_ties_in_the_rows():
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(60, 3)), 1)
    y = (x[:, 0] + r.normal(size=60) * 0.3 > 0.1).astype(float)
    x, y = np.concatenate([x, x[:20]]), np.concatenate([y, y[:20]])
    assert quality.fit(x, y, trees=3, depth=2).score(x) == pytest.approx(slow_fit(x, y, 3, 2), rel=1e-9)


def test_rows_of_a_repeated_id_count_once(spark):
    docs = spark.createDataFrame([(i % 4, f"{'Good text here.' if i % 2 else 'x x x'} {i % 4}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] * 2, "doc_id long, quality int")
    once = quality.learn(docs.dropDuplicates(["doc_id"]), labels.distinct())
    assert np.array_equal(quality.learn(docs, labels).leaf, once.leaf) and once.base == quality.learn(docs, labels).base


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = quality.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 80 and (held.predicted == held.quality).mean() > 0.95


def test_edge_texts_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (2, "a " * 200_000, 1.0), (None, "é!", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (2, 7), (None, 0)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    assert len(model.leaf) == 0 and all(r.score > 0.9 for r in quality.score(docs, model).collect())
    neutral = quality.learn(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, neutral).collect()} == {0.5}
    assert quality.accepted(docs, model).columns == docs.columns and quality.accepted(docs, model).count() == 4
    assert quality.score(docs.limit(0), model).collect() == []
