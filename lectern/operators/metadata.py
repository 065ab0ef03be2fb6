"""Structured metadata of testimonies: sections, their fields, and gender."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.fields import biography, header, internment
from lectern.functions.gender import gender
from lectern.functions.sections import split_sections

LONG_TEXTS = ("content_summary", "testimony_body", "interviewer_assessment")


def with_sections(df: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``filename`` if there is one, and the sections."""
    keep = [c for c in ("doc_id", "filename") if c in df.columns]
    return df.select(*keep, split_sections(F.col(text)).alias("s")).select(*keep, "s.*")


def extract_metadata(df: DataFrame, text: str = "text") -> DataFrame:
    """The metadata table of whole documents, gender included."""
    rows = with_sections(df, text)
    keep = [c for c in ("doc_id", "filename") if c in rows.columns]
    fields = header(F.col("header_block")) | biography(F.col("here_stands_block")) | internment(F.col("internment_block"))
    out = rows.select(*keep, *[c.alias(k) for k, c in fields.items()], "internment_block", *LONG_TEXTS, "warnings")
    return out.withColumn("gender", gender(F.col("name")))
