"""Header search and mapping on nested data of any depth (M1-M5, M10 on T7 cells).

Input: path-addressed cells ``(doc, path ARRAY<BIGINT>, text)`` as :func:`trees.body_cells` makes
them. A *row* is a list that directly holds texts, named by its path; a row is a header when
enough labels match texts that it holds directly. Its *table* is the list around it, and the
table's other items are the rows below: lists of texts, lists that hold lists (a nested item
is one cell, its texts joined in order), or bare texts, whose characters are their cells.

:func:`deep_grid` finds the headers and brings only the tables that hold one into the shape of
the two-level operators, ``table_id`` being the table's path; those then cut regions, project
records and describe tables as on any grid (two-level scans by row ranges, so one giant
table is many tasks). A cell is dealt once per header depth above it, never to every prefix.

Rows at the top of a document have no table around them and are no headers. A null text is empty;
a missing place in a list is an empty cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators import mapping as M
from gridweave.session import cut_lineage

PATH = "array<bigint>"


def _cells(cells: DataFrame) -> DataFrame:
    return cells.select("doc", F.col("path").cast(PATH).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def deep_headers(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """M1 and M2: doc, row (path), hits, first: the label and place of the row's first hit, which
    is its rank among the headers of a document."""
    held = _cells(cells).where(F.size("path") >= 2).withColumnRenamed("text", "cell")
    hits = M.label_hits(held, rules).select("doc", F.slice("path", F.lit(1), F.size("path") - 1).alias("row"), F.struct("ord", "path").alias("at"))
    found = hits.groupBy("doc", "row").agg(F.count(F.lit(1)).alias("hits"), F.min("at").alias("first"))
    return found.where(F.col("hits") >= M.load_ruleset(rules).threshold)


def _rows_of_tables(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """doc, table_id (path), row_idx, cells of every item of the given tables (doc, table_id)."""
    # how deep tables lie: a handful of small numbers, bounded by the depth of the data
    depths = [r["d"] for r in tables.select(F.size("table_id").alias("d")).distinct().orderBy("d").collect()]
    c = _cells(cells)
    if not depths:
        return c.select("doc", F.col("path").alias("table_id"), F.lit(0).cast("bigint").alias("row_idx"), F.array("text").alias("cells")).limit(0)
    n = F.size("path")
    above = F.filter(F.array(*[F.lit(d) for d in depths]), lambda d: d < n)
    c = c.withColumn("d", F.explode(above)).withColumn("table_id", F.slice("path", F.lit(1), F.col("d")))
    c = c.join(tables, ["doc", "table_id"], "left_semi")
    c = c.select("doc", "table_id", F.get("path", F.col("d")).alias("row_idx"), F.get("path", F.col("d") + 1).alias("col"), "path", "text")
    # one exchange by row serves both groupings
    key = ["doc", "table_id", "row_idx"]
    items = c.repartition(*key).groupBy(*key, "col").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "").alias("text")
    )
    rows = items.groupBy(*key).agg(
        F.max(F.when(F.col("col").isNull(), F.col("text"))).alias("bare"),
        F.array_sort(F.collect_list(F.when(F.col("col").isNotNull(), F.struct("col", "text")))).alias("parts"),
    )
    last = F.try_element_at("parts", F.lit(-1))["col"]
    texts = F.transform("parts", lambda p: p["text"])
    spread = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: F.coalesce(F.get(F.filter("parts", lambda p: p["col"] == i), 0)["text"], F.lit("")))
    listed = F.when(F.size("parts") == last + 1, texts).otherwise(spread)
    chars = F.regexp_extract_all("bare", F.lit("(?s)(.)"), 1)
    return rows.select(*key, F.when(F.col("bare").isNotNull(), chars).otherwise(listed).alias("cells"))


def deep_grid(cells: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grid, layout) of the tables that hold header rows, both written once: ``table_id`` is the
    table's path, ``layout`` has the headers as :func:`mapping.header_layout` gives them."""
    heads = cut_lineage(deep_headers(cells, rules))
    split = heads.select(
        "doc", F.slice("row", F.lit(1), F.size("row") - 1).alias("table_id"), F.element_at("row", -1).alias("row_idx"), "first"
    )
    grid = cut_lineage(_rows_of_tables(cells, split.select("doc", "table_id").distinct()))
    own = grid.join(split, M.RKEY).select(*M.RKEY, "first", F.size("cells").alias("n"), F.posexplode("cells").alias("col", "cell"))
    per_cell = M.label_hits(own, rules).groupBy(*M.RKEY, "col").agg(
        F.max_by("target", "ord").alias("target"), F.first("cell").alias("text"), F.first("n").alias("n"), F.first("first").alias("first")
    )
    per_row = per_cell.groupBy(*M.RKEY).agg(
        F.first("n").alias("n"), F.first("first").alias("first"), F.array_sort(F.collect_list(F.struct("col", "target", "text"))).alias("got")
    )
    by_col = F.map_from_entries(F.transform("got", lambda g: F.struct(g["col"], g["target"])))
    targets = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.try_element_at(by_col, i))
    layout = per_row.select(
        *M.RKEY,
        F.struct(
            F.col("row_idx").alias("row"), F.col("n").alias("n"), F.col("first").alias("first_ord"),
            targets.alias("targets"), F.transform("got", lambda g: g["text"]).alias("mapped"),
        ).alias("hdr"),
    )
    return grid, cut_lineage(layout)


def map_cells(cells: DataFrame, rules: DataFrame, keep_header: bool = False, bucket_rows: int = M.DEFAULT_BUCKET_ROWS) -> DataFrame:
    """M1-M5 at any depth: doc, path (the data row's), <targets...> (and ``hdr``)."""
    grid, layout = deep_grid(cells, rules)
    records = M.map_records(grid, rules, keep_header=keep_header, bucket_rows=bucket_rows, layout=layout)
    path = F.concat("table_id", F.array(F.col("row_idx").cast("bigint")))
    return records.select("doc", path.alias("path"), *[c for c in records.columns if c not in M.RKEY])


def describe_cells(cells: DataFrame, rules: DataFrame, bucket_rows: int = M.DEFAULT_BUCKET_ROWS) -> DataFrame:
    """M10 at any depth: doc, path (the header row's), description."""
    grid, layout = deep_grid(cells, rules)
    out = M.describe_table(grid, rules, bucket_rows, layout=layout)
    return out.select("doc", F.concat("table_id", F.array(F.col("row_idx").cast("bigint"))).alias("path"), "description")
