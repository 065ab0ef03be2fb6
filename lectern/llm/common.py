"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Most rows of a key table (some 16 bytes each) that is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000

BATCH_ROWS = 1000

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Unset, it is a temporary one in local mode, as in tests; a cluster has none, and refuses."""
    global _own_dir
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return _own_dir


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lectern-{tag}-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and outlives executors. Its shuffle files go at once;
    nothing reads them again."""
    path, conf = shared_path(df.sparkSession, tag), df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_lectern_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, already materialized, with a broadcast hint if its counted rows are within ``limit``."""
    return F.broadcast(df) if df.count() <= limit else df


def fold_ascii(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast built-in; null counts as empty."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fold_ascii_py(text: str | None) -> str:
    return (text or "").translate(_FOLD)


_FOLD = str.maketrans(UPPER, LOWER)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def limit_batches(spark: SparkSession) -> None:
    """Lower the session's own limit to ``BATCH_ROWS``: the batches of 10,000 texts that Spark makes by default, outside the heap,
    are kept by its allocator."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_ROWS`` rows, which bounds what a worker holds; empty ones are skipped."""
    limit_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                yield from each(batch.slice(at, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is in ``ids`` (one column). Null ids stay. All columns are kept as they are."""
    drop = materialize(ids.toDF("__drop_id").where("__drop_id IS NOT NULL").distinct(), "drop")
    return docs.join(small(drop), docs[id_col] == drop["__drop_id"], "left_anti")


def without_texts(docs: DataFrame, gone: DataFrame, id_col: str, key: Column) -> DataFrame:
    """``docs`` without the rows that ``gone`` (id, key) names; null ids are equal. ``key``, made from a row's text, is worked
    out only where the id is in ``gone``, so that other rows of a repeated id stay."""
    drop = small(materialize(gone.toDF("__drop_id", "__drop_key").distinct(), "drop"))
    # Not a bare equality, which would make the key one of the join.
    return docs.join(drop, docs[id_col].eqNullSafe(drop["__drop_id"]) & F.coalesce(key == F.col("__drop_key"), F.lit(False)), "left_anti")
