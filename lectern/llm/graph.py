"""Connected components by alternating large-star and small-star contraction.

Defined results: links with a null end are left out, as are links of a node to itself; repeated links and both directions of one
count once; an empty table gives an empty table. Columns are taken by place, so their names may clash with any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).distinct()


def _stars_only(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every end of a link; root is the smallest node that can be reached.

    ``links`` has two columns of one orderable type. A hub's links are folded to their minimum before any shuffle, and meet
    it again in a join whose skewed side Spark can split. Each round is written to the shared folder.
    """
    a, b = links.columns
    edges = materialize(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _stars_only(edges):
        last, edges = edges, materialize(_small_star(_large_star(edges)), "edges")
        discard(last)
    return edges.union(edges.select("v", "v").distinct()).toDF("node", "root")
