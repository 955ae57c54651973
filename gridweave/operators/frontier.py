"""Crawl frontier as joins: step assignment, expansion to a fixpoint, carried labels,
redirect aliases, fallbacks, lookups and diagnostics (L6-L13).

Expansion is a driver loop over *levels* (never over rows): each level is one join of
the new frontier with the edge table and an anti-join against the levels already
visited; the level is written once as a table in the shared checkpoint folder, so
lineage stays short and a lost executor recomputes one level at most. A hot source URL
is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.session import checkpoint_dir, cut_lineage


def assign_steps(frontier: DataFrame, links: DataFrame, steps: DataFrame) -> DataFrame:
    """Each page's links are tested against its step's conditions; a matching link gets
    the condition's child step, a ``next`` condition gives the page's own step. With
    several matches per destination, the last one written (greatest source URL, condition
    order, then link order) wins.

    A condition tests the link's place, where ``steps`` has a column ``selector`` (see
    :func:`gridweave.operators.selectors.matches_path`; links then carry ``path``), and its
    text, where there is a ``regex``. A condition without a selector assigns nothing then.
    Steps are configuration: they are read once and compiled into the projection, so every
    pattern is a literal.

    frontier: url, step_id; links: src_url, pos, dst_url, text [, path];
    steps: step_id, cond_ord, regex, child_step, is_next [, selector].
    """
    from gridweave.operators.selectors import matches_path

    by_step: dict = {}
    for c in steps.collect():
        by_step.setdefault(c["step_id"], []).append(c)
    found = F.array().cast("array<struct<cond_ord:int,step:string>>")
    own = F.col("step_id")
    for step, conditions in by_step.items():
        hits = []
        for c in sorted(conditions, key=lambda c: c["cond_ord"]):
            ok = F.lit(True)
            if "selector" in steps.columns:
                ok = F.lit(False) if c["selector"] is None else matches_path(F.col("path"), c["selector"], F.col("text"))
            if c["regex"] is not None:
                ok = ok & F.coalesce(F.col("text").rlike(c["regex"]), F.lit(False))
            to = own if c["is_next"] else F.lit(c["child_step"]).cast("string")
            hits.append(F.when(ok, F.struct(F.lit(c["cond_ord"]).cast("int").alias("cond_ord"), to.alias("step"))))
        found = F.when(own == step, F.array_compact(F.array(*hits))).otherwise(found)
    f = frontier.select(F.col("url").alias("src_url"), "step_id")
    j = f.join(links, "src_url").select("src_url", "pos", "dst_url", F.explode(found).alias("c"))
    return j.groupBy(F.col("dst_url").alias("url")).agg(
        F.max_by("c.step", F.struct("src_url", "c.cond_ord", "pos")).alias("step_id")
    )


def _overlay(below: Column, above: Column) -> Column:
    """Two maps as one; where both have a key, the second's value stays."""
    kept = F.map_filter(below, lambda k, v: ~F.array_contains(F.map_keys(above), k))
    return F.map_concat(kept, above)


#: Written levels are merged into one table whenever so many have come together.
MERGE_LEVELS = 8


def _next_level(frontier: DataFrame, edges: DataFrame, labels: bool, by_url=lambda df: df) -> DataFrame:
    """url (+ labels) of what the frontier's edges lead to, each once; ``by_url`` deals them."""
    step = frontier.join(edges, frontier["url"] == edges["src_url"])
    if not labels:
        return by_url(step.select(F.col("dst_url").alias("url")).where(F.col("url").isNotNull())).distinct()
    none = F.create_map().cast("map<string,string>")
    merged = _overlay(F.coalesce("labels", none), F.coalesce("label", none))
    found = step.select(F.col("dst_url").alias("url"), merged.alias("labels"), "src_url").where(F.col("url").isNotNull())
    return by_url(found).groupBy("url").agg(F.max_by("labels", "src_url").alias("labels"))


def _new_urls(level: DataFrame, edges: DataFrame, visited: DataFrame, labels: bool, buckets: int) -> DataFrame:
    """What a level leads to that was not visited; the tables are bucketed by their URL."""
    found = _next_level(level, edges, labels, lambda df: df.repartition(buckets, "url"))
    return found.join(visited.select("url"), "url", "left_anti")


def expand_bucketed(seeds: DataFrame, edges: DataFrame, labels: bool = False, buckets: int = 256) -> DataFrame:
    """:func:`expand` for graphs whose edges and visited URLs are large next to a level.

    Edges are written once bucketed by source, visited URLs bucketed by URL with a folder per
    depth, so a level's joins find both where they lie: what is shuffled in a level are the URLs
    that its own frontier leads to, neither the edges nor the visited set. ``buckets`` should be
    the cluster's tasks or a multiple of them. The tables are external ones in the shared folder;
    their names go when the walk ends, the visited files are the result."""
    spark = seeds.sparkSession
    base = os.path.join(checkpoint_dir(spark), f"gw-reach-{uuid.uuid4().hex}")
    name = "gw_" + os.path.basename(base).replace("-", "_")
    by = lambda key: lambda df: df.repartition(buckets, key)

    def save(df: DataFrame, table: str, key: str, mode: str, parts: Sequence[str] = ()) -> None:
        w = df.write.format("parquet").mode(mode).option("path", f"{base}/{table}").bucketBy(buckets, key).sortBy(key)
        (w.partitionBy(*parts) if parts else w).saveAsTable(f"{name}_{table}")

    more = ["labels"] if labels else []
    start = seeds.select("url", *more).where(F.col("url").isNotNull()).dropDuplicates(["url"]).withColumn("depth", F.lit(0))
    try:
        save(by("src_url")(edges.select("src_url", "dst_url", *(["label"] if labels else []))), "edges", "src_url", "error")
        save(by("url")(start), "visited", "url", "error", ["depth"])
        e, depth = spark.table(f"{name}_edges"), 0
        while not (level := spark.table(f"{name}_visited").where(F.col("depth") == depth)).isEmpty():
            depth += 1
            new = _new_urls(level, e, spark.table(f"{name}_visited"), labels, buckets)
            save(new.withColumn("depth", F.lit(depth)), "visited", "url", "append", ["depth"])
            spark.catalog.refreshTable(f"{name}_visited")
        return spark.read.schema(spark.table(f"{name}_visited").schema).parquet(f"{base}/visited").select("url", F.col("depth").cast("int").alias("depth"), *more)
    finally:
        for table in ("edges", "visited"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{table}")


def expand(seeds: DataFrame, edges: DataFrame, labels: bool = False) -> DataFrame:
    """L7 (+L9 with ``labels``): breadth-first reach from ``seeds`` over ``edges``, until
    nothing new is found; every URL is visited once, at its smallest depth.

    seeds: url (+ labels MAP<STRING,STRING>); edges: src_url, dst_url (+ label MAP).
    With labels, a child's map is the parent's map overlaid by the edge's (child wins);
    a URL reached from several parents at the same depth takes the parent with the
    greatest URL (deterministic "last writer").

    Edges are written once; each level is one join with them and one anti-join with the
    visited URLs, of which few tables are ever read (levels are merged as they come).
    Output: url, depth (+ labels).
    """
    cols = ["url", "depth"] + (["labels"] if labels else [])
    start = seeds.select("url", F.lit(0).cast("int").alias("depth"), *(["labels"] if labels else [])).dropDuplicates(["url"])
    e = cut_lineage(edges.select("src_url", "dst_url", *(["label"] if labels else [])))
    levels = [cut_lineage(start)]
    frontier, depth = levels[0], 0
    while not frontier.isEmpty():
        depth += 1
        nxt = _next_level(frontier, e, labels).join(_union(levels).select("url"), "url", "left_anti")
        frontier = cut_lineage(nxt.withColumn("depth", F.lit(depth).cast("int")).select(*cols))
        levels.append(frontier)
        if len(levels) > MERGE_LEVELS:
            levels = [cut_lineage(_union(levels))]
    return _union(levels)


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def follow_next(seeds: DataFrame, next_edges: DataFrame) -> DataFrame:
    """Follow "next page" links from each seed to the end; ``hop`` counts pages from
    the nearest seed.

    Where every page has one next page, jumps double: after round k the pages within
    2^k - 1 hops are known and jumps span 2^k hops, so a chain of n pages takes log2(n)
    rounds. Pages with several next pages are expanded level by level.

    next_edges: src_url, dst_url. Output: url, hop.
    """
    edges = cut_lineage(next_edges.select("src_url", "dst_url").where("src_url is not null and dst_url is not null").distinct())
    if not edges.groupBy("src_url").count().where("count > 1").isEmpty():
        return expand(seeds.select("url"), edges).select("url", F.col("depth").alias("hop"))
    reached = cut_lineage(seeds.select("url").distinct().withColumn("hop", F.lit(0).cast("int")))
    jumps, span, known = edges, 1, reached.count()
    while True:
        further = reached.join(jumps, F.col("url") == F.col("src_url")).select(F.col("dst_url").alias("url"), (F.col("hop") + span).cast("int").alias("hop"))
        reached = cut_lineage(reached.unionByName(further).groupBy("url").agg(F.min("hop").alias("hop")))
        before, known = known, reached.count()
        if known == before:
            return reached
        there = jumps.select(F.col("src_url").alias("via"), F.col("dst_url").alias("end"))
        jumps = cut_lineage(jumps.join(there, F.col("dst_url") == F.col("via")).select("src_url", F.col("end").alias("dst_url")))
        span *= 2


def apply_redirects(frontier: DataFrame, redirects: DataFrame) -> DataFrame:
    """A redirect target takes the step and labels of its source (one hop; an
    unknown source is ignored). Returns the frontier with the alias rows added.

    frontier: url, ...; redirects: from_url, to_url.
    """
    r = redirects.select(F.col("from_url").alias("url"), "to_url")
    alias = frontier.join(r, "url", "inner").drop("url").withColumnRenamed("to_url", "url")
    return frontier.unionByName(alias.select(*frontier.columns))


def fallback_self(pages: DataFrame, hits: DataFrame, label: Column) -> DataFrame:
    """Pages without any matching link become their own data page, labelled from
    their own text by ``label``; pages with hits keep their children.

    hits: src_url, dst_url, label (children). Output: src_url, url, label, kind.
    """
    children = hits.select("src_url", F.col("dst_url").alias("url"), "label", F.lit("child").alias("kind"))
    # the label first: page bodies take no part in the join
    labelled = pages.select("url", label.alias("label"))
    lonely = labelled.join(hits.select(F.col("src_url").alias("url")).distinct(), "url", "left_anti")
    selfs = lonely.select(F.col("url").alias("src_url"), F.col("url"), "label", F.lit("self").alias("kind"))
    return children.unionByName(selfs)


def lookup(df: DataFrame, table: DataFrame, on: str = "url", how: str = "left") -> DataFrame:
    """Label lookup from a literal-style table; its measured size decides how it is joined."""
    return df.join(table, on, how)


def unmatched_selectors(links: DataFrame, pages: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """(page, selector) pairs where the selector's regex hits no link text of the page.

    The literal selector list is expanded per page with a generator (no join); the
    hits are one projection of the links; the answer is an anti-join.
    """
    sel = F.array(*[F.struct(F.lit(i).alias("sel_ord"), F.lit(s).alias("selector")) for i, s in enumerate(selectors)])
    wanted = pages.select("page_id", F.inline(sel))
    hit_list = F.array_compact(
        F.array(*[F.when(F.coalesce(F.col("text").rlike(s), F.lit(False)), F.lit(i)) for i, s in enumerate(selectors)])
    )
    hits = links.select("page_id", F.explode(hit_list).alias("sel_ord")).distinct()
    return wanted.join(hits, ["page_id", "sel_ord"], "left_anti")


def pages_without_step(pages: DataFrame, frontier: DataFrame) -> DataFrame:
    """Fetched pages that no step claims."""
    return pages.join(frontier.select("url"), "url", "left_anti")
