"""Sinks: Parquet, CSV, a text file a document, JSON reports, remote sheets."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    """CSV with a header; ``drop`` leaves out long text columns. White space at the ends of values stays."""
    df.drop(*drop).write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_texts(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "full_text", ending: str = "txt") -> int:
    """``<id>.txt`` for each document that isn't empty; how many. Files go through Arrow's file systems, from the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for name, text in zip(b["id"], b["text"], strict=True):
                with fs.open_output_stream(f"{root}/{plain_name(name)}.{ending}") as out:
                    out.write(text.encode())
            yield pd.DataFrame({"n": [len(b)]})

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text <> '' AND id IS NOT NULL")
    return rows.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def report_json(report: DataFrame) -> DataFrame:
    """Report rows as one ``json`` column."""
    return report.select(F.to_json(F.struct("*")).alias("json"))


def write_report(report: DataFrame, path: str) -> None:
    report_json(report).coalesce(1).write.mode("overwrite").text(path)


def as_uri(path: str) -> str:
    """A path as Arrow's file systems take it."""
    return path if "://" in path else f"file://{os.path.abspath(path)}"


def plain_name(name: str) -> str:
    """A name that stays in its folder."""
    return re.sub(r"[/\\\0]", "_", name)


def safe_name(query: str, *filters: str | None) -> str:
    """A file name from a query, every other character of which becomes an underscore, and its filters as they are."""
    return plain_name("_".join([re.sub(r"[^\w-]", "_", query.lower()), *[f for f in filters if f]]))


def write_sheet(df: DataFrame, replace_tab: Callable[[list[list[str]]], None], max_rows: int = 100_000) -> int:
    """Hand a result to a remote sheet, header first. ``replace_tab`` clears or makes the tab. Sheets are small: more rows raise."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a sheet takes at most {max_rows} rows")
    replace_tab([df.columns, *[["" if v is None else str(v) for v in r] for r in rows]])
    return len(rows)
