"""The training-data pipeline over ``documents``.

Quality trees drop rejected documents; exact dedup keeps the largest id of equal texts; SimHash near-dedup keeps the smallest
id of each group of shingle similarity 0.8; documents that a benchmark item contaminates go; the rest is encoded. Each
stage is written as Parquet to the shared folder and reread as the next one's input, so a stage that is lost is redone alone.

Defined results: null and empty texts count as empty, are scored like any, and all but one go as copies of each other; rows that
repeat an id are judged each by its own text, but go together if a benchmark item is in one of them; rows without an id stay
unless an earlier rule drops them; other columns of ``documents``, whatever their names, are kept by all stages but the last;
empty tables give an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import quality
from lectern.llm.bpe import default_vocabulary, encode_documents
from lectern.llm.common import materialize, table
from lectern.llm.decontaminate import drop_contaminated
from lectern.llm.exact_dedup import drop_exact_copies
from lectern.llm.langid import held_out
from lectern.llm.simhash import drop_near_copies


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    return quality.accepted(docs, quality.learn(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, default_vocabulary())


STAGES = [("quality_trees", good_quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("decontamination", clean), ("bpe_codec", encode)]

#: Learned scores and fuzzy hashing are not SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
