"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each reads the driver's tables (through the fixture builders) and runs the operator
from the library on all of it. Oracle twins live in :mod:`gridweave.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.operators import mapping as M
from gridweave.plans import fixtures as fx
from gridweave.sources.rules import rules_frame

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def _grid(spark, sf):
    return fx.grid(spark, sf), fx.grid_rules(spark)


# --- header detection and mapping (M) ---------------------------------------------


@register("find_headers")
def q_find_headers(spark, sf):
    g, r = _grid(spark, sf)
    return M.find_headers(g, r).select(*M.RKEY, "hits", F.col("first_ord").cast("bigint"))


@register("header_order")
def q_header_order(spark, sf):
    g, r = _grid(spark, sf)
    return M.header_order(g, r)


@register("assign_columns")
def q_assign_columns(spark, sf):
    g, r = _grid(spark, sf)
    return M.assign_columns(g, r).select(
        *M.RKEY, F.col("col").cast("bigint"), "header_text", "target"
    )


@register("data_rows")
def q_data_rows(spark, sf):
    g, r = _grid(spark, sf)
    return M.data_rows(g, r).select(
        *M.RKEY, F.col("hdr.row").alias("header_row"), F.array_join("cells", "|").alias("cells")
    )


@register("map_records")
def q_map_records(spark, sf):
    g, r = _grid(spark, sf)
    return M.map_records(g, r)


@register("table_description")
def q_table_description(spark, sf):
    g, r = _grid(spark, sf)
    return M.describe_table(g, r)


@register("select_title")
def q_select_title(spark, sf):
    g, r = _grid(spark, sf)
    return M.select_title(g, r, 1)


def _with_selects(spark, sf, select_rows, doc_text=False):
    g = fx.grid(spark, sf)
    base = fx.grid_rules(spark)
    sel = rules_frame(spark, "grid", list(fx.GRID_RULES) + list(select_rows))
    rec = M.map_records(g, base, keep_header=True)
    dt = fx.grid_doc_text(spark, sf) if doc_text else None
    return M.select_values(rec, sel, dt)


@register("select_header")
def q_select_header(spark, sf):
    out = _with_selects(spark, sf, [fx.GRID_SELECTS[0]])
    return out.select(*M.RKEY, "name_header")


@register("select_post")
def q_select_post(spark, sf):
    out = _with_selects(spark, sf, [fx.GRID_SELECTS[1]])
    return out.select(*M.RKEY, "key_header")


@register("fill_select")
def q_fill_select(spark, sf):
    out = _with_selects(spark, sf, [fx.GRID_SELECTS[2]])
    return out.select(*M.RKEY, "segment")


@register("select_text")
def q_select_text(spark, sf):
    out = _with_selects(spark, sf, [fx.GRID_SELECTS[3]], doc_text=True)
    return out.select(*M.RKEY, "region_word")


@register("award_level")
def q_award_level(spark, sf):
    """Label records by a pattern in their table description, keep labelled ones."""
    from gridweave.operators.shaping import label_from_description

    g, r = _grid(spark, sf)
    rec = M.map_records(g, r, keep_header=True)
    desc = M.describe_table(g, r)
    out = label_from_description(rec, desc, "grade ([AB])", 1, "level")
    return out.select(*M.RKEY, "cust_key", "cust_name", "level")


# Register the remaining query groups.
from gridweave.plans import catalog_deep, catalog_shape, catalog_web  # noqa: E402,F401
