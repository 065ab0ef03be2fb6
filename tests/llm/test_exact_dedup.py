from lectern.llm import exact_dedup


def test_groups_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "Ab É"), (2, "aB É"), (3, "ab é"), (4, None), (5, ""), (6, "x"), (6, "x"), (None, "x"), (7, "x" * 100_000 + "a"), (8, "x" * 100_000 + "b"), (None, "only null")]
    df = spark.createDataFrame([(i, t, 9, True) for i, t in rows], "doc_id long, text string, keep_id int, kept boolean")
    got = sorted(((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()))
    assert got == [(0, 0, 1, True), (0, 6, 3, False), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 3, True), (6, 6, 3, True), (7, 7, 1, True), (8, 8, 1, True)]
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.drop("keep_id").collect())[:6] == [(0, "only null"), (2, "aB É"), (3, "ab é"), (5, ""), (6, "x"), (7, "x" * 100_000 + "a")]


def test_rows_of_a_repeated_id_are_judged_by_their_own_text(spark):
    rows = [(5, "A"), (5, "b"), (9, "B"), (9, "B"), (None, "n"), (None, "N"), (None, "b"), (None, None), (2, "")]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, keep_id int")
    kept = exact_dedup.drop_exact_copies(df)
    got = sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept.collect())
    assert kept.columns == df.columns and got == [(0, "n"), (2, ""), (5, "a"), (9, "b")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(df).collect() == []
