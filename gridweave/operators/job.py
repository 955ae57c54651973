"""The rule-driven job: from a rule set and fetched pages to routed records.

Seeds start at the rule set's root steps; every page's links are tested against its step's
conditions and the pages behind them take the child steps, redirect targets the step of
their source, until no new page is found. Pages of steps with a mapping are cut into tables
and mapped by their own rules; records go to the outputs that their step names.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.text import node_text
from gridweave.operators.frontier import MERGE_LEVELS, assign_steps
from gridweave.operators.mapping import load_ruleset, map_records, select_values
from gridweave.operators.pages import fill_rowspan, html_tables, strip_blocks
from gridweave.operators.selectors import placed_links
from gridweave.session import cut_lineage
from gridweave.sinks.routing import route_outputs

CONDITIONS = "step_id string, cond_ord int, selector string, regex string, child_step string, is_next boolean"


class RuleJob(NamedTuple):
    frontier: DataFrame  # url, step_id of every page that a step claims
    items: DataFrame  # url, page_id, table_id, row_idx, output_id, data_item
    routed: DataFrame  # items with sink and key, one row per sink


def _name(path) -> str:
    return "/".join(map(str, path))


def conditions_of(steps: DataFrame) -> DataFrame:
    """The steps of :func:`gridweave.sources.rules.read_rules` (one rule set) as the
    conditions that :func:`assign_steps` takes; steps are named by their path."""
    rows = []
    for r in steps.collect():  # configuration
        if r["is_next"]:
            rows.append((_name(r["step_id"]), r["cond_ord"], r["xpath"], r["regex"], None, True))
        elif r["parent_step"] is not None:
            rows.append((_name(r["parent_step"]), r["cond_ord"], r["xpath"], r["regex"], _name(r["step_id"]), False))
    return steps.sparkSession.createDataFrame(rows, CONDITIONS)


def crawl(pages: DataFrame, seeds: DataFrame, conditions: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """url, step_id of every reached URL, each at its first depth, whether fetched or not.

    seeds: url, step_id; redirects: from_url, to_url (a target takes its source's step;
    chains are followed). Links are extracted once for all pages."""
    links = cut_lineage(placed_links(pages).select("src_url", "pos", "dst_url", "text", "path"))
    levels = [cut_lineage(seeds.groupBy("url").agg(F.max("step_id").alias("step_id")))]
    level = levels[0]
    while not level.isEmpty():
        found = assign_steps(level, links, conditions)
        if redirects is not None:
            alias = level.join(redirects, level.url == redirects.from_url).select(F.col("to_url").alias("url"), "step_id")
            found = found.unionByName(alias.where(F.col("url").isNotNull()))
        visited = levels[0]
        for x in levels[1:]:
            visited = visited.unionByName(x)
        new = found.groupBy("url").agg(F.max("step_id").alias("step_id")).join(visited.select("url"), "url", "left_anti")
        level = cut_lineage(new.select("url", "step_id"))
        levels.append(level)
        if len(levels) > MERGE_LEVELS:
            levels = [cut_lineage(visited.unionByName(level))]
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def root_seeds(steps: DataFrame) -> DataFrame:
    """url, step_id of the rule set's root steps; a root without a URL is an error."""
    rows = steps.where(~F.col("is_next") & F.col("parent_step").isNull()).collect()  # configuration
    roots = [(r["url"], _name(r["step_id"])) for r in rows]
    if any(u is None or not u.strip() for u, _ in roots):
        raise ValueError("a root step has no URL")
    return steps.sparkSession.createDataFrame(roots, "url string, step_id string")


ITEMS = "page_id long, table_id long, row_idx long, data_item map<string,string>, url string, output_id string"


def claimed_records(steps: DataFrame, rules: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function from claimed pages (page_id, url, html, step_id) to their items, each page
    mapped by the rules that its step names. Pages of steps without a mapping have none. The
    pages are written once and cut into tables once, whatever the number of rules: a page
    belongs to one step, and each rule's mapping reads its own pages' grid."""
    known = {r["rule_id"] for r in rules.select("rule_id").distinct().collect()}  # configuration
    uses = []
    for r in steps.where(~F.col("is_next")).collect():
        if r["mapping_id"] is not None:
            if r["mapping_id"] not in known:
                raise ValueError(f"no mapping with id {r['mapping_id']!r}")
            uses.append((_name(r["step_id"]), r["mapping_id"], r["output_id"]))
    sets = {rule_id: rules.where(F.col("rule_id") == rule_id) for rule_id in dict.fromkeys(u[1] for u in uses)}

    def items(claimed: DataFrame) -> DataFrame:
        spark = claimed.sparkSession
        out = spark.createDataFrame([], ITEMS)
        if not uses:
            return out
        of = spark.createDataFrame(uses, "step_id string, rule_id string, output_id string")
        data = cut_lineage(claimed.join(of, "step_id").select("page_id", "url", "html", "rule_id", "output_id"))
        about = data.drop("html")
        grid = fill_rowspan(html_tables(data)).withColumn("page_id", F.col("doc").cast("bigint"))
        grid = cut_lineage(grid.join(about.select("page_id", "rule_id").distinct(), "page_id"))
        for rule_id, own in sets.items():
            selects = bool(load_ruleset(own).selects)
            mine = F.col("rule_id") == rule_id
            records = map_records(grid.where(mine).select("doc", "table_id", "row_idx", "cells"), own, keep_header=selects)
            if selects:
                text = data.where(mine).select(F.col("page_id").cast("string").alias("doc"), strip_blocks("html").alias("raw"))
                records = select_values(records, own, text.select("doc", node_text("raw").alias("text")))
            fields = load_ruleset(own).output_columns
            item = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f"`{f}`").cast("string") for f in fields]))
            rows = records.select(F.col("doc").cast("bigint").alias("page_id"), "table_id", "row_idx", item.alias("data_item"))
            out = out.unionByName(rows.join(about.where(mine).select("page_id", "url", "output_id"), "page_id"))
        return out

    return items


def run_rules(pages: DataFrame, steps: DataFrame, rules: DataFrame, outputs: DataFrame, redirects: DataFrame | None = None) -> RuleJob:
    """Run one rule set (the rows of one ``spider_id`` of ``read_rules``) over ``pages``
    (page_id, url, html). An unknown mapping id is an error, an unknown output id means the
    default output."""
    frontier = crawl(pages, root_seeds(steps), conditions_of(steps), redirects)
    records = claimed_records(steps, rules)
    items = records(frontier.join(pages, "url").select("page_id", "url", "html", "step_id"))
    return RuleJob(frontier, items, route_outputs(items, outputs.select("output_id", "sink", "key")))
