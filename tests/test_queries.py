"""Each query with SQL, run by Spark and by DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from lectern.plans import catalogue

DATA = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{DATA}/{name}'")
    return con


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(rounded(r[c]) for c in columns) for r in df.collect()]
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    want = [tuple(map(rounded, r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entry_and_catalogue(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "sentence_idx", "matched_word", "sentence"]
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    without = {n for n in catalogue.QUERIES if n not in SQL}
    assert without == {"lda_doc_topics", "lda_topic_words", "lda_topic_counts", "lda_coherence"}
