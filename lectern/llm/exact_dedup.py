"""Exact dedup by progressive refinement, in built-in functions only.

Rows are grouped by byte length, then by the hash of a folded prefix, then by the SHA-256 of the whole folded text. Each
level looks only at rows whose group still has two members, so a text that is alone in its length, or in its length and
prefix, is never hashed in full. Group tables are pre-aggregated before their shuffle; a hot group is one row in them.

Defined results: null text counts as empty; rows repeated with the same id are members of their group each; a null id
is never kept before a non-null one, and a group of null ids only keeps them all with a null ``keep_id``; an empty table
gives an empty table. Extra columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import discard, fold_ascii, materialize, small, table, without_texts

PREFIX_CHARS = 256


def _grouped(df: DataFrame, id_col: str, text_col: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """``__id, __full, __keep, __n, __grouped`` of each row; the full hash only of rows that need it, the rest of groups only."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("__id"), text.alias("__text"), F.octet_length(text).alias("__len"), *[c.alias(k) for k, c in (carry or {}).items()])
    prefix = F.xxhash64(fold_ascii(F.substring("__text", 1, PREFIX_CHARS)))

    lengths = materialize(rows.groupBy("__len").count().where("count > 1").select("__len"), "lengths")
    by_length = rows.select("__len", "__text").join(small(lengths), "__len", "left_semi")
    prefixes = materialize(by_length.select("__len", prefix.alias("__prefix")).groupBy("__len", "__prefix").count().where("count > 1").select("__len", "__prefix", F.lit(True).alias("__open")), "prefixes")

    open_rows = rows.withColumn("__prefix", prefix).join(small(prefixes), ["__len", "__prefix"], "left")
    hashed = materialize(open_rows.select("__id", "__len", F.when(F.col("__open"), full_hash("__text")).alias("__full"), *(carry or {})), "hashed")
    discard(lengths, prefixes)
    groups = hashed.where("__full IS NOT NULL").groupBy("__len", "__full").agg(F.max("__id").alias("__keep"), F.count("*").alias("__n")).where("__n > 1").withColumn("__grouped", F.lit(True))
    # Written first: few groups are broadcast, and many meet the rows in a join whose hot side Spark can split.
    return hashed.join(small(materialize(groups, "groups")), ["__len", "__full"], "left")


def full_hash(text_col: str) -> Column:
    return F.unhex(F.sha2(fold_ascii(F.col(text_col)), 256))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """A row per input row: ``id_col, keep_id, group_size, kept`` and the ``carry`` columns.

    The row with the largest id of each group of equal texts (after lower-casing A-Z) stays.
    """
    out = _grouped(df, id_col, text_col, carry)
    keep = F.when(F.col("__grouped"), F.col("__keep")).otherwise(F.col("__id"))
    return out.select(F.col("__id").alias(id_col), keep.alias("keep_id"), F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"), F.col("__id").eqNullSafe(keep).alias("kept"), *(carry or {}))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: one with its largest id. Rows of a repeated id are judged each by its own text."""
    rows = _grouped(docs, id_col, text_col).where("__grouped")
    here = materialize(rows.groupBy("__id", "__full").agg(F.any_value("__keep").alias("__keep"), F.count("*").alias("__n")), "grouped")
    left = without_texts(docs, here.where("NOT (__id <=> __keep)").select("__id", "__full"), id_col, full_hash(text_col))
    twins = here.where("__id <=> __keep AND __n > 1").select("__id", "__full")
    if twins.isEmpty():
        return left
    # Equal texts of one id, or of none: any one row of them.
    twins = small(twins.toDF("__twin_id", "__twin_key"))
    same = left[id_col].eqNullSafe(F.col("__twin_id")) & F.coalesce(full_hash(text_col) == F.col("__twin_key"), F.lit(False))
    one = left.join(twins, same).dropDuplicates(["__twin_id", "__twin_key"]).select(*[left[c] for c in docs.columns])
    return left.join(twins, same, "left_anti").unionByName(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(fold_ascii(F.col("text")), 256)
    return exact_dedup(table(spark, sf_dir, "documents"), carry={"text_sha256": digest})


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
