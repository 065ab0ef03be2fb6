"""The stateless operators over streams of documents.

Cleaning, sentence splitting, search, classification and field extraction keep no state, so the same functions serve
``readStream`` frames; profiles need the whole corpus and stay batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.search import search_terms


def document_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def search_stream(docs: DataFrame, terms: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Append hits to Parquet, exactly once by the sink's log; ends when what is there has been read."""
    hits = search_terms(docs, terms)
    return hits.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
