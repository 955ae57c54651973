"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the edges' node; the edges of a step are
written once to the shared folder, so a lost executor costs one step. The steps end when an
edge set repeats; nothing but its size and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of comparable ids -> ``(node, component)`` for every node of an edge,
    the component being its smallest node. Loops, repeats and nulls are allowed."""
    edges = edges.where("a is not null and b is not null and a <> b")
    cur = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(cur)
    while state[0]:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # nodes whose neighbours are all smaller keep their edge to the smallest
        rest = low.where("m < a").select("a", F.col("m").alias("b"))
        large = cut_lineage(large.unionByName(rest).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        cur = cut_lineage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        state, before = _state(cur), state
        if state == before:
            break
    tops = cur.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
