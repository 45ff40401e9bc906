"""Connected components by alternating large-star and small-star rounds; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartomill.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of ``links`` (a, b; any orderable type); comp is the component's least node.

    Links of a node to itself and nulls count for nothing.  No links: no rows.
    """
    lesser, greater = F.least("a", "b"), F.greatest("a", "b")
    edges = written(links.where("a <> b").select(greater.alias("u"), lesser.alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        again = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old, edges = edges, written(again.where("u <> v").distinct(), "edges")
        discard(old)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        before = state
