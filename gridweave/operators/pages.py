"""Pages as relational element tables.

A page is one row; it is cut into tokens (tags and text runs) with one regex, and
``posexplode`` gives every token its document position. Elements are pairs of an
opening and a closing token of the same tag found by per-tag depth; containment is
then an interval test on positions, which is what selectors become.

Every ordered step here is keyed by ``page_id`` (plus tag) and so is bounded by one
page, a single input row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.text import attr, clean_text, node_text
from gridweave.session import cut_lineage

# Blocks removed before tokenising (scripts, styles, comments).
STRIP_RE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
# How those blocks begin, and how they end.
STRIP_ENDS = ((r"<(?=script\b)", "</script>"), (r"<(?=style\b)", "</style>"), (r"<(?=!--)", "-->"))
TOKEN_RE = r"(<[^>]*>|[^<]+)"
# HTML void elements, which never take a closing tag.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


_HIDDEN = "\ufffe"  # a noncharacter, dropped from pages


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _hide_open(begin: str, end: str):
    def hidden(html: Column, n: Column, rest: Column) -> Column:
        return F.when(rest.rlike(f"(?i){begin}"), F.concat(F.substr(html, F.lit(1), n), F.regexp_replace(rest, f"(?i){begin}", _HIDDEN))).otherwise(html)

    upto = lambda html: F.length(F.regexp_extract(html, f"(?is)^.*{end}", 0))
    return lambda html: _let(upto(html), lambda n: _let(F.substr(html, n + 1), lambda rest: hidden(html, n, rest)))


def strip_blocks(html) -> Column:
    """``html`` without scripts, styles and comments, in time linear in its length: a block's
    beginning after the last end of its kind can match nothing, so its ``<`` is hidden from the
    pattern (which would look for an end from each of them) and put back. Ordinary pages, with
    nothing begun after the last end, skip that."""
    html = F.col(html) if isinstance(html, str) else html
    open_ = [F.substring_index(html, end, -1).rlike(f"(?i){begin}") for begin, end in STRIP_ENDS]
    guarded = F.translate(html, _HIDDEN, "")
    for ends in STRIP_ENDS:
        guarded = _let(guarded, _hide_open(*ends))
    strip = lambda x: F.regexp_replace(x, STRIP_RE, "")
    return F.when(open_[0] | open_[1] | open_[2], F.translate(strip(guarded), _HIDDEN, "<")).otherwise(strip(html))


def tokens_of(html) -> Column:
    """The tokens of a page: tags and text runs in order. After the last ``>`` there are only
    text runs, so every ``<`` that is tried as a tag is one, and the time is linear."""
    tags = lambda x: F.regexp_extract_all(x, F.lit(TOKEN_RE), 1)
    runs = lambda x: F.regexp_extract_all(x, F.lit("([^<]+)"), 1)
    halves = lambda x, n: F.concat(tags(F.substr(x, F.lit(1), n)), runs(F.substr(x, n + 1)))
    return _let(strip_blocks(html), lambda x: _let(F.length(x) - F.length(F.substring_index(x, ">", -1)), lambda n: halves(x, n)))


def page_tokens(pages: DataFrame) -> DataFrame:
    """page_id, pos, tok, kind ('open' | 'close' | 'text'), tag (lower case), last_pos.

    The one place that reads and cuts ``html``. What uses the tokens more than once takes
    :func:`stored_tokens`."""
    t = pages.select("page_id", tokens_of("html").alias("toks"))
    t = t.select("page_id", (F.size("toks") - 1).cast("bigint").alias("last_pos"), F.posexplode("toks").alias("pos", "tok"))
    tag = F.lower(F.regexp_extract("tok", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    kind = (
        F.when(F.col("tok").rlike(r"^</[a-zA-Z]"), F.lit("close"))
        .when(F.col("tok").rlike(r"^<[a-zA-Z]"), F.lit("open"))
        .when(F.col("tok").startswith("<"), F.lit("other"))
        .otherwise(F.lit("text"))
    )
    return t.select("page_id", F.col("pos").cast("bigint").alias("pos"), "tok", kind.alias("kind"), tag.alias("tag"), "last_pos")


def stored_tokens(pages: DataFrame) -> DataFrame:
    """The tokens of ``pages`` written once, for operators that read them several times: a
    page's html is read and cut a single time, whatever is asked of it."""
    return cut_lineage(page_tokens(pages))


def page_elements(tokens: DataFrame) -> DataFrame:
    """page_id, tag, start, end, id, class, tok.

    Closing tokens are matched within their tag by depth, where a closing token without an
    open element counts for nothing (the running depth never falls below zero): in the
    order of one tag and depth, an opening token's end is the next token, its closing one.
    An element never closed ends at the page's last token. An anchor ends at the next
    anchor at the latest. Void and self-closing elements end where they start. All windows
    run on one distribution of the tokens by page."""
    tags = tokens.where(F.col("kind").isin("open", "close") & (F.col("tag") != ""))
    # one exchange serves every window below
    tags = tags.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("page_id")))
    opens = F.col("kind") == "open"
    void = opens & (F.col("tag").isin(*VOID_TAGS) | F.col("tok").rlike(r"/\s*>$"))
    delta = F.when(void, 0).when(opens, 1).otherwise(-1)
    upto = Window.partitionBy("page_id", "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = tags.withColumn("__run", F.sum(delta).over(upto))
    x = x.withColumn("__low", F.least(F.min("__run").over(upto), F.lit(0)))
    x = x.withColumn("__before", F.col("__run") - delta - F.least(F.coalesce(F.lag("__low").over(Window.partitionBy("page_id", "tag").orderBy("pos")), F.lit(0)), F.lit(0)))
    stray = (F.col("kind") == "close") & (F.col("__before") == 0)
    depth = F.when(F.col("tag") == "a", F.lit(0)).when(opens, F.col("__before") + 1).otherwise(F.col("__before"))
    x = x.where(~stray | (F.col("tag") == "a")).withColumn("__d", F.when(void, F.lit(-1)).otherwise(depth))
    after = Window.partitionBy("page_id", "tag", "__d").orderBy("pos")
    follow = F.lead(F.struct("pos", "kind")).over(after)
    x = x.withColumn("__next", follow).where(opens)
    end = F.when(void, F.col("pos")).when(F.col("__next").isNull(), F.col("last_pos")).when(F.col("__next.kind") == "close", F.col("__next.pos")).otherwise(F.col("__next.pos") - 1)
    return x.select("page_id", "tag", F.col("pos").alias("start"), end.alias("end"), attr("tok", "id").alias("id"), attr("tok", "class").alias("class"), "tok")


def element_text(elements: DataFrame, tokens: DataFrame, bucket: int = 256) -> DataFrame:
    """T3 for chosen elements: text tokens inside each element, in order, entities
    decoded. Range join through position buckets, so a page's token list is only
    paired with the few elements asked for."""
    el = elements.withColumn(
        "bk", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)))
    )
    tx = tokens.where(F.col("kind") == "text").select(
        F.col("page_id").alias("__tp"),
        F.col("pos").alias("tpos"),
        F.col("tok").alias("ttok"),
        F.floor(F.col("pos") / bucket).alias("__tbk"),
    )
    # The range test is part of the join condition: an element without text inside
    # keeps one row (with nulls) even when its bucket holds other text.
    cond = (
        (F.col("page_id") == F.col("__tp"))
        & (F.col("bk") == F.col("__tbk"))
        & (F.col("tpos") >= F.col("start"))
        & (F.col("tpos") <= F.col("end"))
    )
    j = el.join(tx, cond, "left").drop("__tp", "__tbk")
    keys = [c for c in elements.columns]
    agg = j.groupBy(*keys).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("tpos").isNotNull(), F.struct("tpos", "ttok")))),
                lambda x: x["ttok"],
            ),
            "",
        ).alias("raw")
    )
    return agg.withColumn("text", node_text(F.col("raw"))).drop("raw")


def contained_in(inner: DataFrame, outer: DataFrame, bucket: int = 256) -> DataFrame:
    """Interval containment join inside a page: rows of ``inner`` (page_id, start, end,
    ...) paired with rows of ``outer`` (page_id, o_start, o_end, ...) where
    ``o_start < start`` and ``end <= o_end``.

    Outer intervals are spread over the position buckets they cover and inner rows join
    on the bucket of their start, so each inner row only meets the outer intervals that
    overlap its own bucket (its ancestors and a bucket's worth of siblings), never every
    interval of the page.
    """
    o = outer.withColumn(
        "__bk", F.explode(F.sequence(F.floor(F.col("o_start") / bucket), F.floor(F.col("o_end") / bucket)))
    )
    i = inner.withColumn("__bk", F.floor(F.col("start") / bucket))
    j = i.join(o, ["page_id", "__bk"])
    return j.where((F.col("o_start") < F.col("start")) & (F.col("end") <= F.col("o_end"))).drop("__bk")


def container_children(
    elements: DataFrame, attr_name: str, value: str, child_tags: tuple[str, ...]
) -> DataFrame:
    """Elements of ``child_tags`` inside containers whose ``attr_name`` equals
    ``value``, not inside another such element, in document order (``child_no``).

    Nesting is found with an ordered scan per container: a child is nested when an
    earlier child of the same container ends at or after its start.
    """
    cont = elements.where(F.col(attr_name) == value).select(
        "page_id", F.col("start").alias("o_start"), F.col("end").alias("o_end")
    )
    kids = elements.where(F.col("tag").isin(*child_tags))
    inside = contained_in(kids, cont).withColumnRenamed("o_start", "c_start").drop("o_end")
    w = Window.partitionBy("page_id", "c_start").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("__reach", F.max("end").over(w))
    top = inside.where(F.col("__reach").isNull() | (F.col("__reach") < F.col("start"))).drop("__reach")
    wn = Window.partitionBy("page_id", "c_start").orderBy("start")
    return top.withColumn("child_no", F.row_number().over(wn).cast("bigint"))


def html_tables(pages: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """T5: HTML tables to a grid (doc = page_id, table_id = table order in the page,
    row_idx = row order in the table, cells = cleaned text of each td/th, rowspans).

    A cell is a leaf: a table inside a cell is part of the cell's text and no table of its
    own. A cell ends at its closing tag or at the next cell, row or table end; a row without
    cells is a row with no cells; cells before a row's opening tag form a row; stray closing
    tags count for nothing.

    One pass over the page's tokens, on one distribution by page: running depth of tables,
    then every token takes the table, row and cell that are open where it stands.
    """
    t = tokens if tokens is not None else page_tokens(pages)
    page = Window.partitionBy("page_id").orderBy("pos")
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    is_open, is_table = F.col("kind") == "open", F.col("tag") == "table"
    delta = F.when(is_table & is_open, 1).when(is_table & (F.col("kind") == "close"), -1).otherwise(0)
    x = t.where((F.col("kind") == "text") | F.col("tag").isin("table", "tr", "td", "th"))
    x = x.withColumn("__run", F.sum(delta).over(upto))
    # depth in tables, stray closing tags not counted; a closing tag has the depth it closes
    x = x.withColumn("__low", F.least(F.min("__run").over(upto), F.lit(0)))
    x = x.withColumn("__depth", F.col("__run") - F.col("__low"))
    x = x.withColumn("__was", F.coalesce(F.lag("__depth").over(page), F.lit(0)))
    closes = (delta == -1) & (F.col("__was") == 1)
    outer = F.when(delta == -1, F.col("__was") == 1).otherwise(F.col("__depth") == 1)
    mark = outer & (F.col("tag") != "") & (F.col("kind") != "text")
    starts = mark & is_table & is_open
    x = x.withColumn("__table", F.sum(starts.cast("int")).over(upto) - 1)
    cell_tag = F.col("tag").isin("td", "th")
    # the last row event before each token: an open row's place, or none
    row_event = F.when(mark & (F.col("tag") == "tr") & is_open, F.struct(F.col("pos").alias("at"), F.lit(True).alias("real"))).when(
        mark & ((F.col("tag") == "tr") | is_table), F.struct(F.col("pos").alias("at"), F.lit(False).alias("real"))
    )
    x = x.withColumn("__row", F.last(row_event, ignorenulls=True).over(upto))
    cell_event = F.when(mark & cell_tag & is_open, F.struct(F.col("pos").alias("at"), F.col("tok").alias("tag"))).when(
        mark, F.struct(F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("string").alias("tag"))
    )
    x = x.withColumn("__cell", F.last(cell_event, ignorenulls=True).over(upto))
    in_cell = F.col("__cell.at").isNotNull() & (F.col("__depth") >= 1)
    row_start = mark & (F.col("tag") == "tr") & is_open
    x = x.where(row_start | (in_cell & ((F.col("kind") == "text") | (mark & cell_tag & is_open)))).where(F.col("__row").isNotNull() & ~closes)
    keys = ["page_id", "__table", F.col("__row.at").alias("__at")]
    cells = x.groupBy(*keys, F.col("__cell.at").alias("__c")).agg(
        F.first("__cell.tag").alias("tag"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "tok")))), lambda p: p["tok"]), "").alias("raw"),
    )
    spec = F.when(F.col("__c").isNotNull(), F.struct(F.col("__c").alias("start"), clean_text(node_text("raw")).alias("text"), attr("tag", "rowspan").alias("rs")))
    rows = cells.groupBy("page_id", "__table", "__at").agg(F.array_sort(F.collect_list(spec)).alias("spec"))
    place = F.row_number().over(Window.partitionBy("page_id", "__table").orderBy("__at")) - 1
    return rows.select(
        F.col("page_id").cast("string").alias("doc"),
        F.col("__table").cast("bigint").alias("table_id"),
        place.cast("bigint").alias("row_idx"),
        F.transform("spec", lambda c: c["text"]).alias("cells"),
        F.transform("spec", lambda c: c["rs"].try_cast("int")).alias("rowspans"),
    )


def fill_rowspan(grid: DataFrame) -> DataFrame:
    """Copy a cell with ``rowspan = n`` into the next ``n - 1`` rows of its table at
    the same index (colspan is not expanded).

    Input needs ``rowspans ARRAY<INT>`` beside ``cells``. One ``aggregate`` over the
    table's rows carries the pending copies (source row order, then column order).
    A table is one group; the grid of a page holds a handful of tables.
    """
    rows = grid.groupBy("doc", "table_id").agg(
        F.array_sort(F.collect_list(F.struct("row_idx", "cells", "rowspans"))).alias("rows")
    )
    carry_t = "struct<out:array<struct<row_idx:bigint,cells:array<string>>>,pend:array<struct<idx:int,text:string,left:int>>>"

    def step(acc, r):
        pend = acc["pend"]
        # insert pending copies in order: each at its index, clamped to the row end
        cells = F.aggregate(
            pend,
            r["cells"],
            lambda cs, p: F.concat(
                F.slice(cs, 1, F.least(p["idx"], F.size(cs))),
                F.array(p["text"]),
                F.slice(cs, F.least(p["idx"], F.size(cs)) + 1, F.greatest(F.size(cs) - p["idx"], F.lit(0))),
            ),
        )
        spans = F.aggregate(
            pend,
            F.coalesce(r["rowspans"], F.array_repeat(F.lit(None).cast("int"), F.size(r["cells"]))),
            lambda ss, p: F.concat(
                F.slice(ss, 1, F.least(p["idx"], F.size(ss))),
                F.array(F.lit(None).cast("int")),
                F.slice(ss, F.least(p["idx"], F.size(ss)) + 1, F.greatest(F.size(ss) - p["idx"], F.lit(0))),
            ),
        )
        still = F.transform(
            F.filter(pend, lambda p: p["left"] > 1), lambda p: F.struct(p["idx"].alias("idx"), p["text"].alias("text"), (p["left"] - 1).alias("left"))
        )
        numbers = F.when(F.size(cells) > 0, F.sequence(F.lit(1), F.size(cells))).otherwise(F.array().cast("array<int>"))
        new = F.filter(
            F.transform(
                numbers,
                lambda i: F.struct(
                    (i - 1).alias("idx"),
                    F.element_at(cells, i).alias("text"),
                    (F.coalesce(F.element_at(spans, i), F.lit(1)) - 1).alias("left"),
                ),
            ),
            lambda p: p["left"] > 0,
        )
        out = F.concat(acc["out"], F.array(F.struct(r["row_idx"].alias("row_idx"), cells.alias("cells"))))
        return F.struct(out.alias("out"), F.concat(still, new).alias("pend"))

    init = F.struct(
        F.array().cast("array<struct<row_idx:bigint,cells:array<string>>>").alias("out"),
        F.array().cast("array<struct<idx:int,text:string,left:int>>").alias("pend"),
    ).cast(carry_t)
    res = rows.select("doc", "table_id", F.aggregate("rows", init, step)["out"].alias("out"))
    return res.select("doc", "table_id", F.inline("out"))


def to_cells(grid: DataFrame) -> DataFrame:
    """Grid rows to path-addressed cells ``(doc, path ARRAY<BIGINT>, text)``, with
    path = [table_id, row_idx, col]."""
    return grid.select(
        "doc", "table_id", "row_idx", F.posexplode("cells").alias("col", "text")
    ).select(
        "doc",
        F.array(F.col("table_id").cast("bigint"), F.col("row_idx").cast("bigint"), F.col("col").cast("bigint")).alias("path"),
        "text",
    )


def cells_to_grid(cells: DataFrame) -> DataFrame:
    """Path-addressed cells of any depth as a grid: a row is an innermost list (its path
    without the last index), a table the rows with one path before that. Tables are
    numbered per document in path order; ``row_idx`` is the row's index in its table.

    cells: doc, path ARRAY<INT or BIGINT> (two indexes or more), text. Output as
    :func:`html_tables` without rowspans, ready for the mapping operators."""
    path = F.col("path").cast("array<bigint>")
    n = F.size("path")
    rows = cells.where(n >= 2).select(
        "doc", F.slice(path, F.lit(1), n - 2).alias("__table"), F.element_at(path, -2).alias("row_idx"), F.element_at(path, -1).alias("__c"), "text"
    )
    grid = rows.groupBy("doc", "__table", "row_idx").agg(F.array_sort(F.collect_list(F.struct("__c", "text"))).alias("x"))
    tables = grid.select("doc", "__table").distinct()
    tables = tables.withColumn("table_id", (F.row_number().over(Window.partitionBy("doc").orderBy("__table")) - 1).cast("bigint"))
    return grid.join(tables, ["doc", "__table"]).select("doc", "table_id", "row_idx", F.transform("x", lambda c: c["text"]).alias("cells"))


def children_cells(children: DataFrame) -> DataFrame:
    """T12 as cells: the child elements of each container (page_id, c_start, child_no,
    text, and optionally ``piece``, the texts of its parts) as ``(doc, path, text)`` with
    path = [container, child, part]."""
    parts = F.col("piece") if "piece" in children.columns else F.array("text")
    x = children.select(F.col("page_id").cast("string").alias("doc"), "c_start", "child_no", F.posexplode(parts).alias("part", "text"))
    return x.select("doc", F.array("c_start", F.col("child_no").cast("bigint") - 1, F.col("part").cast("bigint")).alias("path"), "text")
