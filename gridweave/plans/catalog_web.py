"""Registered queries over pages and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions import text as X
from gridweave.functions.urls import base_name, postfix, quote_url, resolve_url
from gridweave.operators import frontier as FR
from gridweave.operators import links as LK
from gridweave.operators import pages as PG
from gridweave.plans import fixtures as fx
from gridweave.plans.catalog import register
from gridweave.sources.pages import route_pages

# Fixed values used by the queries below (labels, patterns, selectors).
FUZZY_LABELS = ("the", "en", "ion", "sch", "é", "")
LINK_LABELS = ("the", "and", "tion", "er", "ch")
CAPITAL_RE = "^[A-Z]"
DOUBLE_VOWEL_RE = "[aeiou]{2}"
EXACT_TEXT = "and"
SELECTORS = ("^[A-Z]", "ion$", "^zz")
STEP_CONDITIONS = (
    # step_id, cond_ord, regex, child_step, is_next
    ("root", 0, "^[A-Z]", "capital", False),
    ("root", 1, "e$", "e_end", False),
    ("root", 2, "^th", None, True),
)


def _links(spark, sf):
    return fx.links(spark, sf)


# --- sources -----------------------------------------------------------------


@register("scan_pages")
def q_scan_pages(spark, sf):
    p = fx.pages(spark, sf)
    return p.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@register("route_by_postfix")
def q_route(spark, sf):
    p = fx.pages(spark, sf)
    # Stand-in header: pages addressed as .html files arrived without a content type.
    p = p.withColumn(
        "content_type",
        F.when(F.col("url").rlike(r"\.html$"), F.lit(None).cast("string")).otherwise(F.lit("text/html; charset=utf-8")),
    )
    routed, rejects = route_pages(p)
    a = routed.select("page_id", "url", "kind")
    b = rejects.select("page_id", "url", F.lit("rejected").alias("kind"))
    return a.unionByName(b)


@register("url_postfix")
def q_postfix(spark, sf):
    p = fx.pages(spark, sf)
    return p.select("page_id", postfix("url").alias("postfix"), base_name("url").alias("base_name"))


# --- predicates and expressions ------------------------------------------------


@register("fuzzy_match")
def q_fuzzy(spark, sf):
    lk = _links(spark, sf)
    labs = F.array(*[F.struct(F.lit(i).alias("label_no"), F.lit(s).alias("label")) for i, s in enumerate(FUZZY_LABELS)])
    x = lk.select("page_id", "pos", "text", F.inline(labs))
    return x.select(
        "page_id", "pos", F.col("label_no").cast("bigint").alias("label_no"), X.fuzzy_match(F.col("text"), F.col("label")).alias("matched")
    )


@register("link_filter_regex")
def q_filter(spark, sf):
    lk = _links(spark, sf)
    return lk.where(X.matches("text", CAPITAL_RE)).select("page_id", "pos", "text")


@register("link_exclude")
def q_exclude(spark, sf):
    lk = _links(spark, sf)
    return lk.where(X.not_matches("text", DOUBLE_VOWEL_RE)).select("page_id", "pos", "text")


@register("link_exact_text")
def q_exact(spark, sf):
    lk = _links(spark, sf)
    return lk.where(F.col("text") == EXACT_TEXT).select("page_id", "pos", "dst_url")


@register("regex_extract")
def q_extract(spark, sf):
    lk = _links(spark, sf)
    return lk.select(
        "page_id",
        "pos",
        X.extract("text", "([a-z]+)(en|er)$", 1).alias("stem"),
        X.extract("text", r"(\d*)e", 1).alias("digits_before_e"),
    )


@register("extract_many")
def q_extract_many(spark, sf):
    p = fx.pages(spark, sf).select("page_id", "url")
    out = X.extract_many(
        p, "url", {"host": ("//([^/]+)", 1), "lang": ("/([a-z]{2})/", 1), "num": (r"/(\d+)", 1)}
    )
    return out.select("page_id", "host", "lang", "num")


@register("digits_filter")
def q_digits(spark, sf):
    p = fx.pages(spark, sf)
    seg = F.regexp_extract("url", r"/([^/?#]*)([?#].*)?$", 1)
    x = p.select("page_id", seg.alias("seg"))
    return x.where(X.is_digits("seg")).select("page_id", "seg", X.to_int("seg").alias("num"))


@register("constant_prefix")
def q_prefix(spark, sf):
    p = fx.pages(spark, sf)
    return p.select("page_id", X.prefix("url", "page:").alias("ref"), F.lit("web").alias("source"))


@register("conditional_suffix")
def q_suffix(spark, sf):
    p = fx.pages(spark, sf).select("page_id", "url")
    p = p.withColumn("path", F.regexp_extract("url", r"^[^?#]*", 0)).withColumn("query", X.extract("url", r"\?[^#]*", 0))
    return p.withColumn("path", X.append_if("path", "query")).drop("query", "url")


@register("resolve_url")
def q_resolve(spark, sf):
    lk = _links(spark, sf)
    tail = F.substr(F.col("href"), F.lit(2))
    variants = F.array(
        F.col("href"),
        tail,
        F.concat(F.lit("../"), tail),
        F.concat(F.lit("./"), tail),
        F.concat(F.lit("//other.example.org"), F.col("href")),
        F.concat(F.lit("?q="), tail),
        F.concat(F.lit("#"), tail),
        F.lit(""),
        F.lit(None).cast("string"),
        F.concat(F.lit("a/../../"), tail),
    )
    x = lk.select("page_id", "pos", "src_url", F.posexplode(variants).alias("variant", "h"))
    return x.select("page_id", "pos", F.col("variant").cast("bigint").alias("variant"), resolve_url(F.col("src_url"), F.col("h")).alias("resolved"))


@register("quote_url")
def q_quote(spark, sf):
    lk = _links(spark, sf)
    raw = F.concat(F.col("dst_url"), F.lit("/"), F.col("text"), F.lit(" *~%#"))
    return lk.select("page_id", "pos", quote_url(raw).alias("quoted"))


# --- page structure ------------------------------------------------------------


@register("page_elements")
def q_elements(spark, sf):
    el = PG.page_elements(PG.page_tokens(fx.pages(spark, sf)))
    return el.select("page_id", "tag", "start", "end")


@register("element_attr")
def q_attr(spark, sf):
    el = PG.page_elements(PG.page_tokens(fx.pages(spark, sf)))
    return el.where(F.col("class").isNotNull()).select("page_id", "tag", "start", "class")


@register("node_text")
def q_node_text(spark, sf):
    p = fx.pages(spark, sf)
    t = PG.stored_tokens(p)
    el = PG.page_elements(t).where(F.col("tag").isin("h1", "div", "li")).select("page_id", "tag", "start", "end")
    return PG.element_text(el, t).select("page_id", "start", "tag", "text")


@register("clean_text")
def q_clean(spark, sf):
    lines = fx.lines(spark, sf)
    return lines.select("doc_id", "pos", X.clean_text("line").alias("cleaned"))


@register("container_children")
def q_children(spark, sf):
    p = fx.pages(spark, sf)
    t = PG.stored_tokens(p)
    el = PG.page_elements(t)
    kids = PG.container_children(el, "tag", "ul", ("li",))
    txt = PG.element_text(kids.select("page_id", "start", "end", "child_no"), t)
    return txt.select("page_id", "child_no", "text")


# --- links and frontier ----------------------------------------------------------


@register("extract_links")
def q_links(spark, sf):
    # runs L1 on the pages (the other link queries read its result as their input)
    return LK.extract_links(fx.pages(spark, sf)).select("page_id", "pos", "href", "dst_url", "text")


@register("links_in_container")
def q_links_in(spark, sf):
    p = fx.pages(spark, sf)
    t = PG.stored_tokens(p)
    el = PG.page_elements(t)
    out = LK.links_in(p, el, t, tag="nav")
    return out.select("page_id", "pos", "dst_url", "text")


@register("link_neighbour")
def q_neighbour(spark, sf):
    p = fx.pages(spark, sf)
    t = PG.stored_tokens(p)
    el = PG.page_elements(t)
    anchors = el.where(F.col("tag") == "a").select("page_id", "start", "end")
    out = LK.neighbour_text(anchors, el, t, "ul")
    return out.select("page_id", "start", "neighbour")


@register("label_links")
def q_label_links(spark, sf):
    return LK.label_links(_links(spark, sf), LINK_LABELS)


@register("first_link_per_key")
def q_first_per_key(spark, sf):
    lk = _links(spark, sf)
    key = F.lower(X.extract("text", r"^(\w)", 1))
    return LK.first_per_key(lk, ["page_id"], key, "pos", ["dst_url"])


def _steps(spark):
    return spark.createDataFrame(list(STEP_CONDITIONS), "step_id string, cond_ord int, regex string, child_step string, is_next boolean")


@register("assign_steps")
def q_assign(spark, sf):
    p = fx.pages(spark, sf)
    frontier = p.select("url", F.lit("root").alias("step_id"))
    lk = _links(spark, sf)
    return FR.assign_steps(frontier, lk, _steps(spark))


JOB_CONDITIONS = (
    # step_id, cond_ord, selector, regex, child_step, is_next; the last has no selector
    ("root", 0, "//nav//a", "^[A-Z]", "capital", False),
    ("root", 1, "//nav//a", "^th", None, True),
    ("root", 2, None, "^a", "never", False),
)


@register("rule_job_frontier")
def q_job(spark, sf):
    """The rule-driven job's walk over the given pages: every page is a seed, links in the
    navigation lead on by their text, targets are resolved and quoted."""
    from gridweave.operators.job import CONDITIONS, crawl

    p = fx.pages(spark, sf)
    seeds = p.select("url", F.lit("root").alias("step_id"))
    return crawl(p, seeds, spark.createDataFrame(list(JOB_CONDITIONS), CONDITIONS))


@register("link_sibling")
def q_sibling(spark, sf):
    """L3 with a sibling: beside each link of a navigation list, the text of the first list
    item of its list."""
    p = fx.pages(spark, sf)
    t = PG.stored_tokens(p)
    el = PG.page_elements(t)
    anchors = el.where(F.col("tag") == "a").select("page_id", "start", "end")
    out = LK.neighbour_text(anchors, el, t, "ul", "li")
    return out.select("page_id", "start", "neighbour")


@register("grid_files")
def q_grid_files(spark, sf):
    """The customer table written as CSV files (into the shared checkpoint folder), one
    folder per nation, and read back as cell grids; cells as they were written."""
    import os
    import uuid

    from gridweave.session import checkpoint_dir
    from gridweave.sources.pages import read_grid

    path = os.path.join(checkpoint_dir(spark), f"gw-grids-{uuid.uuid4().hex}")
    c = fx.read(spark, sf, "customer").select("c_custkey", "c_name", F.concat(F.lit("x, "), F.col("c_mktsegment")).alias("segment"), "c_nationkey")
    c.write.partitionBy("c_nationkey").option("escape", '"').csv(path)
    g = read_grid(spark, os.path.join(path, "*"))
    cell = F.col("cells")
    return g.select(F.regexp_extract("doc", "c_nationkey=([0-9]+)$", 1).cast("bigint").alias("nation"), cell[0].cast("bigint").alias("cust_key"), cell[1].alias("name"), cell[2].alias("segment"), F.size(cell).cast("bigint").alias("n_cells"))


@register("frontier_reach")
def q_reach(spark, sf):
    out = FR.expand(fx.tree_seeds(spark, sf), fx.tree_edges(spark, sf))
    return out.select("url", F.col("depth").cast("bigint").alias("depth"))


@register("inherit_labels")
def q_inherit(spark, sf):
    out = FR.expand(fx.tree_seeds(spark, sf), fx.tree_edges(spark, sf), labels=True)
    return out.select(
        "url",
        F.col("depth").cast("bigint").alias("depth"),
        F.col("labels")["region"].alias("region"),
        F.col("labels")["segment"].alias("segment"),
        F.col("labels")["priority"].alias("priority"),
        F.col("labels")["root"].alias("root"),
    )


@register("follow_next")
def q_follow(spark, sf):
    out = FR.follow_next(fx.chain_seeds(spark, sf), fx.chain_edges(spark, sf))
    return out.select("url", F.col("hop").cast("bigint").alias("hop"))


@register("redirect_alias")
def q_redirect(spark, sf):
    cust = fx.read(spark, sf, "customer")
    frontier = cust.select(
        F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("url"),
        F.lit("customer").alias("step_id"),
        F.col("c_mktsegment").alias("segment"),
    )
    red = fx.redirects(spark, sf)
    # Unknown sources are ignored: add redirects whose source is not in the frontier.
    red = red.unionByName(
        red.select(F.concat(F.lit("x/"), F.col("from_url")).alias("from_url"), F.concat(F.col("to_url"), F.lit("/x")).alias("to_url"))
    )
    return FR.apply_redirects(frontier, red)


@register("fallback_self")
def q_fallback(spark, sf):
    p = fx.pages(spark, sf)
    lk = _links(spark, sf)
    hits = lk.where(X.matches("text", "^[A-Z][a-z]+$")).select(
        "src_url", "dst_url", X.extract("text", "^[A-Z]", 0).alias("label")
    )
    label = X.extract(F.col("html"), r"<h1>([^<]*)</h1>", 1)
    return FR.fallback_self(p.select("url", "html"), hits, label)


@register("url_lookup")
def q_lookup(spark, sf):
    reach = fx.tree_edges(spark, sf).where(F.col("dst_url").startswith("c/")).select(F.col("src_url").alias("url"), F.col("dst_url"))
    return FR.lookup(reach, fx.url_labels(spark, sf), "url", "left").select("dst_url", "url", "label")


@register("unmatched_pages")
def q_unmatched(spark, sf):
    p = fx.pages(spark, sf)
    out = FR.unmatched_selectors(_links(spark, sf), p, SELECTORS)
    return out.select("page_id", F.col("sel_ord").cast("bigint").alias("sel_ord"), "selector")


@register("article_blocks")
def q_article_blocks(spark, sf):
    """T12 + T3 + E1 as in the block-class spider: the h1/p children of each article in
    document order; a heading block labels the paragraph blocks after it."""
    from gridweave.operators import shaping as SH

    p = fx.pages(spark, sf)
    t = PG.stored_tokens(p)
    el = PG.page_elements(t)
    kids = PG.container_children(el, "tag", "article", ("h1", "p"))
    txt = PG.element_text(kids.select("page_id", "c_start", "start", "end", "tag", "child_no"), t)
    out = SH.carry_forward(
        txt,
        ["page_id", "c_start"],
        "child_no",
        F.col("tag") == "h1",
        F.col("text"),
        F.floor(F.col("child_no") / F.lit(4096)),
        out="heading",
    )
    return out.select("page_id", "child_no", "heading", "text")
