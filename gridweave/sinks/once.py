"""All sinks in one write (K2, K3, K4, A2): every output as lines of (sink, key, place).

The items are worked out once and written as a table; each sink's lines are rendered from it and
one job writes them all, dealt by ranges of (sink, key, place) and sorted within, so a key with
most of the items is many tasks, and a key's files in the order of their names, end to end, are
its output:

* lists: JSON objects, newest first;
* CSV: a byte-order mark and a header, the columns of the key's first record, then the records in
  order; values quoted where they must be, a missing or null one empty. A record with columns
  that the header lacks cannot be written: it is left out of the CSV and of the counts;
* counts: one JSON object, URL to number of items, its braces in the first and last line.

Writing again replaces the keys that are written, so a repeated run leaves the same files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.operators.aggregates import url_counts_keyed
from gridweave.operators.scan import running_sum
from gridweave.session import cut_lineage
from gridweave.sinks.files import CSV_SINKS, LIST_SINKS, REPLACE_KEYS

#: The counts' place among the sinks.
COUNTS = "counts"


def csv_value(c) -> Column:
    """A value as CSV has it: quoted if it holds a comma, a quote or a line's end, quotes doubled."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_line(values: Column, bom: bool = False) -> Column:
    """An array of values as one line; a line of one empty value is a pair of quotes."""
    line = F.array_join(F.transform(values, csv_value), ",")
    whole = F.when((F.size(values) == 1) & (line == ""), F.lit('""')).otherwise(line)
    return F.concat(F.lit("﻿" if bom else ""), whole, F.lit("\r"))


def _lines(rows: DataFrame, part: int, line: Column, up: Column | None = None, down: Column | None = None) -> DataFrame:
    none = F.lit(None)
    kind = rows.schema["at"].dataType if "at" in rows.columns else None
    at = lambda c: (none if c is None else c).cast(kind) if kind else none
    return rows.select(F.coalesce("sink", F.lit("")).alias("sink"), F.coalesce("key", F.lit("")).alias("key"), F.lit(part).alias("part"), at(up).alias("up"), at(down).alias("down"), line.alias("line"))


def _headed(rows: DataFrame) -> DataFrame:
    """CSV rows with ``header``, the columns of their key's first record, and whether it fits."""
    first = cut_lineage(rows.groupBy("sink", "key").agg(F.min_by(F.map_keys("data_item"), "at").alias("header")))
    return rows.join(first, ["sink", "key"]).withColumn("fits", F.size(F.array_except(F.map_keys("data_item"), F.col("header"))) == 0)


def sink_lines(items: DataFrame, routed: DataFrame, order: Sequence[str], bom: bool = True) -> DataFrame:
    """sink, key, part, up, down, line: the lines of all sinks (see the module).

    items: url and ``order``, whose columns together name an item; routed: also sink, key and
    data_item, one row per item and sink. Items without a key for a sink are not in it."""
    order = list(order)
    sinks = {r["sink"] for r in routed.select("sink").distinct().collect()}  # configuration: a few names
    if unknown := sorted(s for s in sinks if s is not None and s not in LIST_SINKS + CSV_SINKS):
        raise ValueError(f"no writer for sinks {unknown}")
    at = F.struct(*[F.col(c) for c in order])
    keyed = routed.where(F.col("key").isNotNull() & (F.col("key") != "") & F.col("sink").isNotNull())
    kept = cut_lineage(keyed.select("sink", "key", "data_item", at.alias("at")))
    rows = _headed(kept.where(F.col("sink").isin(*CSV_SINKS)))
    values = F.transform("header", lambda c: F.try_element_at("data_item", c))
    lists = _lines(kept.where(F.col("sink").isin(*LIST_SINKS)), 1, F.to_json("data_item"), down=F.col("at"))
    table = _lines(rows.where("fits"), 1, csv_line(values), up=F.col("at"))
    heads = rows.groupBy("sink", "key").agg(F.first("header").alias("header"), F.min("at").alias("at"))
    head = _lines(heads, 0, csv_line(F.col("header"), bom), up=F.col("at"))
    # an item's list key, and whether its CSV could not be written
    of = kept.where(F.col("sink").isin(*LIST_SINKS)).select("at", "key", F.lit(False).alias("bad"))
    of = of.unionByName(rows.where(~F.col("fits")).select("at", F.lit(None).cast("string").alias("key"), F.lit(True).alias("bad")))
    of = of.groupBy("at").agg(F.min("key").alias("key"), F.max("bad").alias("bad"))
    counted = items.select("url", *order).withColumn("at", at).join(of, "at", "left").where(~F.coalesce("bad", F.lit(False)))
    return lists.unionByName(table).unionByName(head).unionByName(_count_lines(url_counts_keyed(counted.drop("at", "bad"), order), lists))


def _count_lines(counts: DataFrame, like: DataFrame) -> DataFrame:
    """One JSON object over any number of tasks: a brace, entries by URL, all but the first after a
    comma, a brace."""
    counts = cut_lineage(counts)
    least = counts.agg(F.min("url").alias("u")).select("u").scalar()
    entry = F.to_json(F.create_map("url", "n"))
    entry = F.substr(entry, F.lit(2), F.length(entry) - 2)
    comma = F.when(F.col("url") == least, F.lit("")).otherwise(F.lit(","))
    key = counts.select("key").distinct()  # one row: the run's
    none = [F.lit(None).cast(like.schema[c].dataType).alias(c) for c in ("up", "down")]
    brace = lambda part, sign: key.select(F.lit(COUNTS).alias("sink"), "key", F.lit(part).alias("part"), *none, F.lit(sign).alias("line"))
    body = counts.select(F.lit(COUNTS).alias("sink"), "key", F.lit(1).alias("part"), *none, F.concat(comma, entry).alias("line"))
    all_ = brace(0, "{").unionByName(body).unionByName(brace(2, "}"))
    return all_.withColumn("key", F.coalesce("key", F.lit("")))


def write_once(items: DataFrame, routed: DataFrame, base: str, order: Sequence[str], bom: bool = True) -> None:
    """Write every sink's output under ``base`` as ``sink=<sink>/key=<key>/part-*``."""
    lines = sink_lines(items, routed, order, bom)
    place = ["sink", "key", "part", F.col("up").asc(), F.col("down").desc(), "line"]
    placed = lines.repartitionByRange(*place).sortWithinPartitions(*place)
    placed.select("sink", "key", "line").write.mode("overwrite").options(**REPLACE_KEYS).partitionBy("sink", "key").text(base)


def read_lines(spark: SparkSession, base: str) -> DataFrame:
    """sink, key, no, line of written outputs, lines numbered from 0 in the order of a key's files
    (the reader drops a byte-order mark)."""
    raw = spark.read.schema("value string, sink string, key string").option("lineSep", "\n").text(base)
    rows = raw.select("sink", "key", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), F.col("value").alias("line"))
    bucket = F.format_string("%s %020d", "file", "block")
    out = running_sum(rows, ["sink", "key"], ["file", "mid"], F.lit(1), "no", bucket)
    return out.select("sink", "key", (F.col("no") - 1).cast("bigint").alias("no"), "line")
