"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a minimum per vertex (combined map-side) and a join back on the vertex, which AQE can split; each round is written to the
shared folder. No vertex's neighbours are ever gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release, remove, staged


def _print(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.coalesce(F.sum(F.xxhash64("b", "a") % 1_000_003), F.lit(0))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): for each node of an edge, the least node it reaches. Loops, nulls and repeated edges are harmless."""
    spark = edges.sparkSession
    state = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while (now := _print(state)) != before and now[0]:
        before = now
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = staged(small.where("a <> b").distinct(), "small")
        remove(large)
        remove(state)
        state = after
    release(spark)
    nodes = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
