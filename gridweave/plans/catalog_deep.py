"""Registered queries: nested data of any depth, CSV records, all sinks in one write."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from gridweave.functions.sql import register_sql
from gridweave.operators import deep, trees
from gridweave.operators.frontier import expand_bucketed
from gridweave.operators.job import CONDITIONS
from gridweave.operators.label_index import match_labels
from gridweave.plans import fixtures as fx
from gridweave.plans.catalog import register
from gridweave.plans.catalog_shape import ITEM_FIELDS, _items, _routed
from gridweave.plans.catalog_web import JOB_CONDITIONS
from gridweave.session import checkpoint_dir, table_path
from gridweave.sinks.files import write_csv
from gridweave.sinks.once import csv_line, read_lines, write_once
from gridweave.sources.pages import read_grid
from gridweave.streaming.frontier import RuleStream

#: Every fifth table ends in a bare text as long as its header has cells.
FIVE_SIGNS = "total"


def deep_cells(spark, sf):
    """The `grid` three lists deep: a row of one cell is a bare text, customer names are
    lists of two texts, and a text stands before the tables."""
    g = fx.grid(spark, sf)
    at = F.array(F.lit(1).cast("bigint"), "table_id", F.lit(0).cast("bigint"), "row_idx")
    foot = F.col("cells")[0].startswith("end of ") & (F.col("table_id") % 5 == 0)
    bare = g.where(F.size("cells") == 1).select("doc", at.alias("path"), F.when(foot, F.lit(FIVE_SIGNS)).otherwise(F.col("cells")[0]).alias("text"))
    one = g.where(F.size("cells") > 1).select("doc", at.alias("at"), F.posexplode("cells").alias("col", "cell"))
    named = F.col("cell").startswith("Customer#")
    plain = one.where(~named).select("doc", F.concat("at", F.array(F.col("col").cast("bigint"))).alias("path"), F.col("cell").alias("text"))
    parts = one.where(named).select("doc", "at", "col", F.posexplode(F.split("cell", "#")).alias("k", "text"))
    parts = parts.select("doc", F.concat("at", F.array(F.col("col").cast("bigint"), F.col("k").cast("bigint"))).alias("path"), "text")
    top = g.select("doc").distinct().select("doc", F.array(F.lit(0).cast("bigint")).alias("path"), F.col("doc").alias("text"))
    return top.unionByName(bare).unionByName(plain).unionByName(parts)


def _path(c: str = "path"):
    return F.array_join(F.col(c).cast("array<string>"), ".").alias("path")


@register("body_cells")
def q_body_cells(spark, sf):
    return trees.body_cells(fx.pages(spark, sf)).select("doc", _path(), "text")


@register("page_tree")
def q_page_tree(spark, sf):
    t = trees.page_tree(fx.pages(spark, sf))
    return t.select("page_id", "start", "end", "parent", F.col("level").cast("bigint").alias("level"), F.col("ordinal").cast("bigint").alias("ordinal"), "tag")


@register("map_cells")
def q_map_cells(spark, sf):
    out = deep.map_cells(deep_cells(spark, sf), fx.grid_rules(spark))
    return out.select("doc", _path(), "cust_key", "cust_name", "balance", "segment")


@register("describe_cells")
def q_describe_cells(spark, sf):
    return deep.describe_cells(deep_cells(spark, sf), fx.grid_rules(spark)).select("doc", _path(), "description")


def _folder(spark, kind: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"gw-{kind}-{uuid.uuid4().hex}")


@register("all_sinks")
def q_all_sinks(spark, sf):
    """K1 to K4 and A2: keyed lists, CSV files and URL counts written by one job and read back
    line by line."""
    order, path = ["doc", "table_id", "row_idx"], _folder(spark, "sinks")
    routed = _routed(spark, sf)
    fields = F.map_from_arrays(F.array(*[F.lit(f) for f in ITEM_FIELDS]), F.array(*[F.col(f) for f in ITEM_FIELDS]))
    write_once(_items(spark, sf), routed.withColumn("data_item", fields), path, order)
    return read_lines(spark, path)


@register("csv_records")
def q_csv_records(spark, sf):
    """Whole texts, with their line breaks, quotes and commas, written as CSV files
    by language and read back as records."""
    path = _folder(spark, "csv")
    write_csv(fx.read(spark, sf, "documents").select("doc_id", "text", "source", F.col("lang").alias("key")), path, ["doc_id", "text", "source"])
    rows = read_grid(spark, os.path.join(path, "*")).where("row_idx > 0")
    cell = F.col("cells")
    return rows.select(cell[0].cast("bigint").alias("doc_id"), cell[1].alias("text"), cell[2].alias("source"), F.size(cell).cast("bigint").alias("n_cells"))


@register("file_tables")
def q_file_tables(spark, sf):
    """A folder per document with all its tables in CSV files, blank lines between them."""
    path = _folder(spark, "book")
    g = fx.grid(spark, sf).select(F.coalesce(F.regexp_replace("doc", "/", "-"), F.lit("")).alias("book"), "table_id", "row_idx", csv_line(F.col("cells")).alias("line"))
    blank = g.where("row_idx = 0").select("book", "table_id", F.lit(-1).cast("bigint").alias("row_idx"), F.lit("").alias("line"))
    rows = g.unionByName(blank).repartition("book").sortWithinPartitions("book", "table_id", "row_idx")
    rows.select("book", "line").write.partitionBy("book").text(path)
    out = read_grid(spark, os.path.join(path, "*"), table_break="^$")
    return out.select(F.regexp_extract("doc", "book=([^/]*)$", 1).alias("book"), "table_id", "row_idx", F.array_join("cells", "|").alias("cells"))


@register("label_index")
def q_label_index(spark, sf):
    """X1 against a label set too large to be compiled: part names under part types and brands."""
    part = fx.read(spark, sf, "part")
    labels = part.select(F.lower("p_type").alias("label")).union(part.select(F.lower("p_brand"))).union(part.select(F.substring("p_name", 1, 5))).distinct()
    rows = part.select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("cell"))
    return match_labels(rows, labels).select("p_partkey", "label")


@register("sql_functions")
def q_sql_functions(spark, sf):
    """X1, X10, X11, S8, T3 and T4 in a query written in SQL alone."""
    register_sql(spark)
    return spark.sql(
        f"""SELECT page_id, gw_quote_url(url) AS quoted, gw_url_postfix(url) AS postfix, gw_url_base_name(url) AS base_name,
  gw_resolve_url(url, concat('../x y?', page_id)) AS resolved, gw_label_match(url, 'news') AS matched,
  gw_clean_text(gw_node_text(regexp_extract(html, '(?s)<h1>.*?</h1>', 0))) AS heading FROM parquet.`{table_path(sf, "pages")}`"""
    )


@register("frontier_bucketed")
def q_frontier_bucketed(spark, sf):
    """L7 with edges and visited URLs in buckets."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return expand_bucketed(fx.tree_seeds(spark, sf), fx.tree_edges(spark, sf), buckets=buckets).select("url", F.col("depth").cast("bigint").alias("depth"))


@register("stream_rule_job")
def q_stream_rule_job(spark, sf):
    """R1 with L6 to L9: the walk over the given pages as a stream whose state is keyed by URL;
    pages lie in two drops, every page is a seed."""
    drops, p = _folder(spark, "drops"), fx.pages(spark, sf)
    for k in (0, 1):
        p.where(F.col("page_id") % 2 == k).write.parquet(f"{drops}/drop={k}")
    stream = RuleStream(spark, drops, _folder(spark, "walk"), spark.createDataFrame(list(JOB_CONDITIONS), CONDITIONS), p.select("url", F.lit("root").alias("step_id")))
    stream.drain()
    return stream.frontier()
