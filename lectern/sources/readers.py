"""Sources: PDF and text folders, Parquet, CSV, word lists, category sheets."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import strip, words
from lectern.sources.pdf import page_texts

CORPUS_SCHEMA = "doc_id string, filename string, n_pages int, n_chars int, n_words int, full_text string, error string"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stem(name):
    return F.regexp_replace(name, r"\.[^.]*$", "")


FILES_MB = 16  # of files that are handed on at a time


def _local_or_shared(folder: str):
    """Arrow's file system of a folder and the path in it; none for patterns, and for stores that only Spark reads."""
    try:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        return (fs, root) if not any(c in folder for c in "*?[{") and fs.get_file_info(root).type == pyarrow.fs.FileType.Directory else None
    except (pa.ArrowException, OSError, ValueError):
        return None


def _files(spark: SparkSession, folder: str, ending: str) -> DataFrame:
    """``filename, content`` of a folder's files of an ending. One task lists the names and others open the files, so that the
    driver holds none of them, and the tasks are as many as the cores want, not a few files each."""
    found = _local_or_shared(folder)
    if found is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").load(folder)
        return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    fs, root = found
    local = isinstance(fs, pyarrow.fs.LocalFileSystem)

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            every = (e.name for e in os.scandir(root) if e.is_file()) if local else (i.base_name for i in fs.get_file_info(pyarrow.fs.FileSelector(root)) if i.is_file)
            held = []
            for name in every:
                if name.endswith(f".{ending}") and not name.startswith(("_", ".")):  # as Spark's readers
                    held.append(name)
                if len(held) == 10_000:
                    yield pd.DataFrame({"filename": held})
                    held = []
            yield pd.DataFrame({"filename": held}, dtype=str)

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, size = [], 0
            for name in b["filename"]:
                with fs.open_input_stream(f"{root}/{name}") as f:
                    held.append((name, f.read()))
                size += len(held[-1][1])
                if size > FILES_MB << 20:
                    yield pd.DataFrame(held, columns=["filename", "content"])
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=["filename", "content"])

    listed = spark.range(0, 1, 1, 1).mapInPandas(names, "filename string")
    return listed.repartition(8 * spark.sparkContext.defaultParallelism).mapInPandas(contents, "filename string, content binary")


def read_pdfs(spark: SparkSession, folder: str, extract: Callable[[bytes], list[str]] = page_texts) -> DataFrame:
    """One row per ``*.pdf``, in no order: a sort would move all texts, or parse files twice. ``extract`` gives the texts of a
    file's pages; an error becomes a row with ``error`` set. Pages are joined by a blank line.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["filename"], b["content"], strict=True):
                try:
                    pages = [p or "" for p in extract(bytes(content))]
                    rows.append((name, len(pages), "\n\n".join(pages), None))
                except Exception as e:  # noqa: BLE001 - what a parser raises is data here
                    rows.append((name, 0, "", str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["filename", "n_pages", "full_text", "error"])

    rows = _files(spark, folder, "pdf").mapInPandas(run, "filename string, n_pages int, full_text string, error string")
    return as_corpus(rows)


def as_corpus(rows: DataFrame) -> DataFrame:
    """``filename, n_pages, full_text, error`` with ids and lengths."""
    text = F.coalesce("full_text", F.lit(""))
    return rows.select(_stem(F.col("filename")).alias("doc_id"), "filename", F.col("n_pages").cast("int").alias("n_pages"), F.length(text).alias("n_chars"), F.size(words(text)).alias("n_words"), text.alias("full_text"), F.col("error").cast("string").alias("error"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ``*.txt``: ``doc_id`` (the name without its ending), ``filename``, ``text``; line ends become line feeds."""
    files = _files(spark, folder, "txt").select("filename", F.col("content").cast("string").alias("value"))
    return files.select(_stem(F.col("filename")).alias("doc_id"), "filename", F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header and a declared schema; quoted values may hold line ends. ``columns`` prunes the scan."""
    # A declared line end: else the parser takes the first carriage return for one. Values may be as long as they like.
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', lineSep="\n", maxCharsPerColumn=-1)
    return df.select(*columns) if columns else df


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word list, one a line: stripped, lower-cased, distinct; blank lines and comments go."""
    word = F.lower(strip(F.col("value"))).alias("word")
    return spark.read.text(path).select(word).where("word <> '' AND word NOT LIKE '#%'").distinct()


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet exported as CSV, a category a column, all strings, with ``row`` as its order."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.withColumn("row", F.monotonically_increasing_id())


def fetch_sheet(spark: SparkSession, fetch: Callable[[], list[list[str | None]]]) -> DataFrame:
    """A remote sheet, as ``fetch`` gives it: rows of cells, header first; short rows are filled up. Sheets are made by hand, so small."""
    names, *rows = fetch()
    cells = [(*[(c or None) for c in [*r, *[None] * len(names)][: len(names)]], i) for i, r in enumerate(rows)]
    return spark.createDataFrame(cells, ", ".join(f"`{n}` string" for n in names) + ", row long")


def category_terms(sheet: DataFrame, order: str = "row") -> DataFrame:
    """Long form of a wide sheet: ``category, term, position``. Cells hold terms between commas; of terms that differ only in case the first stays."""
    columns = [c for c in sheet.columns if c != order]
    cells = sheet.unpivot([order], columns, "category", "cell").where("cell IS NOT NULL")
    terms = cells.select("category", order, F.posexplode(F.split("cell", ",")).alias("at", "raw")).select("category", order, "at", strip(F.col("raw")).alias("term")).where("term <> ''")
    first = Window.partitionBy("category", F.lower("term")).orderBy(order, "at")
    kept = terms.withColumn("n", F.row_number().over(first)).where("n = 1")
    return kept.select("category", "term", F.row_number().over(Window.partitionBy("category").orderBy(order, "at")).alias("position"))


def without_done(df: DataFrame, done: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rows whose keys are not yet in an earlier output: what a resumed run has left to do."""
    keys = list(keys)
    return df.join(done.select(*keys).distinct(), keys, "left_anti")
