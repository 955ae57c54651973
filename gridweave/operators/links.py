"""Links: extraction, container selection, labelling, first-per-key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.text import attr, decode_references, fuzzy_match_literal, strip_tags
from gridweave.functions.urls import resolve_url
from gridweave.operators.label_index import INLINE_LABELS, match_labels
from gridweave.operators.pages import contained_in, element_text, strip_blocks

# Where an anchor begins, and where its content ends.
ANCHOR_START = r"(?i)(?=<a[\s>/])"
ANCHOR_TAG = r"(?is)^<a[\s][^>]*\bhref\s*=[^>]*>"
ANCHOR_END = r"(?i)</a\s*>"


def extract_links(pages: DataFrame) -> DataFrame:
    """L1: every link of every page in order (``pos`` 0-based), with href, resolved
    destination and text. An anchor ends at its closing tag or at the next anchor; anchors
    without ``href`` are no links. One projection per page row: no join, no shuffle.

    Columns: page_id, src_url, pos, href, dst_url, text.
    """
    clean = strip_blocks("html")
    anchors = F.filter(F.split(clean, ANCHOR_START), lambda x: x.rlike(ANCHOR_TAG))
    a = pages.select("page_id", F.col("url").alias("src_url"), F.posexplode(anchors).alias("pos", "a"))
    open_tag = F.regexp_extract(F.col("a"), r"(?is)^<a\b[^>]*>", 0)
    raw = F.split(F.col("a"), ANCHOR_END, 2)[0]
    # values that later expressions use many times are columns of their own first
    a = a.select("page_id", "src_url", F.col("pos").cast("bigint").alias("pos"), attr(open_tag, "href").alias("href"), raw.alias("raw"))
    a = a.withColumn("raw", strip_tags("raw"))
    return a.select(
        "page_id", "src_url", "pos", "href", resolve_url(F.col("src_url"), F.col("href")).alias("dst_url"), decode_references("raw").alias("text")
    )


def links_in(
    pages: DataFrame,
    elements: DataFrame,
    tokens: DataFrame,
    tag: str | None = None,
    attr_name: str | None = None,
    value: str | None = None,
) -> DataFrame:
    """L2: anchors inside containers chosen by tag and/or an id/class value (the
    ``//tag[@attr=value]//a`` shape). Interval-containment join on ``page_id`` between
    the few selected containers and the page's anchors.

    Columns: page_id, src_url, c_start, pos (order inside the container), href, dst_url, text.
    """
    cont = elements
    if tag:
        cont = cont.where(F.col("tag") == tag)
    if attr_name:
        cont = cont.where(F.col(attr_name) == value)
    cont = cont.select("page_id", F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    anchors = elements.where((F.col("tag") == "a") & attr("tok", "href").isNotNull()).select("page_id", "start", "end", "tok")
    inside = contained_in(anchors, cont).withColumnRenamed("o_start", "c_start").drop("o_end")
    txt = element_text(inside, tokens)
    urls = pages.select("page_id", F.col("url").alias("src_url"))
    w = Window.partitionBy("page_id", "c_start").orderBy("start")
    rows = txt.join(urls, "page_id").withColumn("href", attr(F.col("tok"), "href"))
    return rows.select(
        "page_id",
        "src_url",
        "c_start",
        (F.row_number().over(w) - 1).cast("bigint").alias("pos"),
        "href",
        resolve_url(F.col("src_url"), F.col("href")).alias("dst_url"),
        "text",
    )


def neighbour_text(
    links: DataFrame,
    elements: DataFrame,
    tokens: DataFrame,
    parent_tag: str,
    sibling_tag: str | None = None,
) -> DataFrame:
    """L3: a value next to each link. ``links`` carry ``page_id``, ``start``, ``end``.

    Without ``sibling_tag``: the text of the innermost enclosing ``parent_tag`` element
    (the row or item the link sits in). With it: the text of the first ``sibling_tag``
    element inside that parent (a date beside a title; use a tag other than the link's).
    Containment goes through the bucketed interval join, never all pairs of a page.
    """
    par = elements.where(F.col("tag") == parent_tag).select(
        "page_id", F.col("start").alias("o_start"), F.col("end").alias("o_end")
    )
    j = contained_in(links, par).withColumnRenamed("o_start", "p_start").withColumnRenamed("o_end", "p_end")
    inner = j.groupBy(*links.columns).agg(F.max_by(F.struct("p_start", "p_end"), "p_start").alias("p"))
    inner = inner.select(*links.columns, F.col("p.p_start").alias("p_start"), F.col("p.p_end").alias("p_end"))
    if sibling_tag is None:
        targets = inner.select("page_id", "p_start", F.col("p_start").alias("start"), F.col("p_end").alias("end"))
    else:
        sib = elements.where(F.col("tag") == sibling_tag).select("page_id", "start", "end")
        parents = inner.select("page_id", F.col("p_start").alias("o_start"), F.col("p_end").alias("o_end")).distinct()
        cand = contained_in(sib, parents).withColumnRenamed("o_start", "p_start")
        first = cand.groupBy("page_id", "p_start").agg(F.min_by(F.struct("start", "end"), "start").alias("s"))
        targets = first.select("page_id", "p_start", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    txt = element_text(targets.select("page_id", "p_start", "start", "end").distinct(), tokens)
    return inner.join(txt.select("page_id", "p_start", F.col("text").alias("neighbour")), ["page_id", "p_start"], "left").drop(
        "p_start", "p_end"
    )


def label_links(links: DataFrame, labels: Sequence[str], order: Sequence[str] = ("page_id", "pos")) -> DataFrame:
    """L4: links whose text fuzzy-matches any of the labels; a link may match several,
    and per destination URL the last match (link order, then label order) wins.

    Labels are a literal list, compiled into the projection (no join); long lists are joined
    through the label index.
    Columns: dst_url, label.
    """
    if len(labels) > INLINE_LABELS:
        rows = links.sparkSession.createDataFrame([(i, lab) for i, lab in enumerate(labels)], "ord int, label string")
        met = match_labels(links.select(*order, "dst_url", "text"), rows, "text")
        return met.groupBy("dst_url").agg(F.max_by("label", F.struct(*[F.col(c) for c in order], "ord")).alias("label"))
    hits = F.array_compact(
        F.array(
            *[
                F.when(fuzzy_match_literal(F.col("text"), lab), F.struct(F.lit(i).alias("ord"), F.lit(lab).alias("label")))
                for i, lab in enumerate(labels)
            ]
        )
    )
    x = links.select(*order, "dst_url", F.explode(hits).alias("h"))
    key = F.struct(*[F.col(c) for c in order], F.col("h.ord"))
    return x.groupBy("dst_url").agg(F.max_by(F.col("h.label"), key).alias("label"))


def first_per_key(df: DataFrame, part: Sequence[str], key: Column, order: str, cols: Sequence[str]) -> DataFrame:
    """The first row per (part, key) by ``order``; rows with a null key are dropped.

    A partial-aggregating ``min_by`` rather than a sorted window.
    """
    x = df.withColumn("__key", key).where(F.col("__key").isNotNull())
    best = F.min_by(F.struct(*[F.col(c) for c in [order, *cols]]), F.col(order))
    return x.groupBy(*part, "__key").agg(best.alias("__b")).select(
        *part, F.col("__key").alias("key"), *[F.col(f"__b.{c}").alias(c) for c in [order, *cols]]
    )
