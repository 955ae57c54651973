"""Output routing (K1): which sinks, under which keys, receive each item."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def route_outputs(items: DataFrame, outputs: DataFrame, output_of: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """K1: each item names an ``output_id`` (null or unknown -> ``default``); the output
    maps sinks to keys. One row per (item, sink) with its ``key``; a sink the output
    does not name receives nothing. U2: ``output_of`` gives the output id of the items by an
    expression of your own (from the URL, say) in place of the column.

    outputs: output_id, sink, key (configuration; its measured size decides the join).
    """
    if output_of is not None:
        items = items.withColumn("output_id", output_of(items))
    outs = outputs
    known = outputs.select(F.col("output_id").alias("__oid")).distinct()
    x = items.join(known, items.output_id == known.__oid, "left")
    x = x.withColumn("__eff", F.when(F.col("__oid").isNotNull(), F.col("output_id")).otherwise(F.lit("default")))
    x = x.drop("__oid")
    return x.join(outs.withColumnRenamed("output_id", "__eff"), "__eff", "inner").drop("__eff")
