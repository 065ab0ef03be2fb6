from pyspark.sql import functions as F

from lectern.llm import common


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in map(str, (files.apply(i).getName() for i in range(files.size()))) if f.startswith("shuffle_")}


def test_materialized_frames_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(20000).withColumn("k", F.xxhash64("id"))
    out = common.materialize(rows.repartition(5, "k").groupBy("k").count().join(rows.hint("merge"), "k"), "test")
    assert shuffle_files(spark) <= before
    assert out.count() == 20000
    assert spark.conf.get(common.CLEANUP) == "false"
