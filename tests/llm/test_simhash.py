import numpy as np
import xxhash

from lectern.llm import golay, graph, simhash

SCHEMA = "doc_id long, text string, f0 string, component_id int"


def brute(rows, size, most):
    prints = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[j : j + size]) for j in range(max(1, len(words) - size + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {(i, f"{prints[i]:016x}", top(i)) for i in ids}


def test_golay_keys_meet_within_four_bits():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**64, 500, dtype=np.uint64)
    y = x.copy()
    for i in range(len(x)):
        for b in r.choice(64, r.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1 << int(b))
    found = [set(zip(*map(np.ndarray.tolist, golay.keys(v)), strict=True)) for v in (x, y)]
    assert {i for i, _ in found[0] & found[1]} == set(range(len(x)))


def test_matches_brute_force_with_nulls_ties_and_clashing_columns(spark):
    r = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(25):
        base = [vocabulary[k] for k in r.integers(0, 300, 80)]
        for _ in range(6):
            copy = list(base)
            for _ in range(r.integers(0, 3)):
                copy[r.integers(0, 80)] = "Edit"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n"), (len(rows) + 3, "one two"), (len(rows) + 4, "ONE  two"), (len(rows) + 5, "x " * 30000)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = {tuple(x) for x in simhash.near_duplicates(df, shingle=4, similarity=None).collect()}
    assert got == brute(rows, 4, 4)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "zz yy")], "doc_id long, text string")
    got = sorted((x.doc_id or -1, x.component_id or -1) for x in simhash.near_duplicates(df, shingle=4, similarity=None).collect())
    assert got == [(-1, -1), (-1, 1), (1, 1), (1, 1)]
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_similar_texts_leave_one(spark):
    r = np.random.default_rng(3)
    rows = []
    for _ in range(30):
        base = [f"w{k}" for k in r.integers(0, 5000, 200)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base[:100], "changed", *base[101:]]))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert {x.doc_id for x in kept.collect()} == set(range(0, 60, 2))


def test_large_group_around_one_text_is_joined_by_its_center(spark):
    r = np.random.default_rng(7)
    base = [f"w{k}" for k in r.integers(0, 10**6, 300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):  # each is similar to the first, most are not to each other
        copy = list(base)
        for at in r.choice(60, 4, replace=False):
            copy[5 * at + 2] = f"e{i}_{at}"
        rows.append((i, " ".join(copy)))
    group, alike = similar(spark, rows)
    assert all(alike(0, i) >= 0.8 for i in range(1, 120)) and sum(alike(i, i + 1) < 0.8 for i in range(1, 119)) > 80
    assert set(group.values()) == {0}


def similar(spark, rows, **options):
    """Groups of more than one text, and the similarities of all pairs, by brute force."""
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    group = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, **options).collect()}
    return group, lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])


def test_whole_shingle_sets_decide(spark):
    r = np.random.default_rng(5)
    rows, edits = [], [84, 86, *range(90, 97), *range(90, 97)]
    for n in edits:  # some above and some below 0.8, all near it
        base = [f"w{k}" for k in r.integers(0, 10**6, 4000)]
        copy = list(base)
        for at in r.choice(800, n, replace=False):
            copy[5 * at + 2] = f"e{at}"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    group, alike = similar(spark, rows)
    pairs = [(i, i + 1) for i in range(0, len(rows), 2)]
    assert len({alike(i, j) >= 0.8 for i, j in pairs}) == 2
    assert not [(i, j) for i, j in pairs if group[i] == group[j] and alike(i, j) < 0.8]


def test_every_pair_at_the_similarity_is_joined(spark):
    r = np.random.default_rng(6)
    rows = []
    for _ in range(60):
        size = int(r.integers(6, 400))
        base = [f"w{k}" for k in r.integers(0, 10**6, size)]
        copy = list(base)
        for at in r.choice(size, max(1, size // 50), replace=False):
            copy[at] = "Edit"
        footer = ["All", "rights", "reserved", "by", "the", "press", "of", "the", "town"] * (len(rows) % 4 == 0)
        rows += [(len(rows), " ".join(base + footer)), (len(rows) + 1, " ".join(copy + footer))]
    group, alike = similar(spark, rows)
    links = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if alike(i, j) >= 0.8]
    assert len(links) > 20 and sum(alike(i, j) < 0.85 for i, j in links) > 5
    assert [(i, j) for i, j in links if group[i] != group[j]] == []
    assert {i for i, g in group.items() if list(group.values()).count(g) > 1} == {i for pair in links for i in pair}


def test_rows_of_a_repeated_id_and_without_one(spark):
    near = [f"a b c d e f g h i j k l m n o p q r s t u v w x y z {x}" for x in ("1", "2")]
    df = spark.createDataFrame([(3, near[0]), (5, near[1]), (5, "another text of five words"), (None, near[1]), (None, "alone")], "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.drop_near_copies(df).collect())
    assert kept == [(0, "alone"), (3, near[0]), (5, "another text of five words")]
    assert simhash.drop_near_copies(df.limit(0)).collect() == []


def test_components_of_odd_links(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 3), (None, 4), (5, None), (7, 6), (7, 6)], "node long, root long")
    assert sorted(map(tuple, graph.components(links).collect())) == [(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)]
    assert graph.components(links.limit(0)).collect() == []
    assert all(len(x) == 0 for f in (golay.keys, golay.loose_keys) for x in f(np.zeros(0, np.uint64)))
