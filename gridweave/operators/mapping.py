"""Header detection and column mapping over cell grids.

Input grid: ``doc STRING, table_id BIGINT, row_idx BIGINT, cells ARRAY<STRING>``; one row per
table row, ``row_idx`` dense from 0 inside ``(doc, table_id)``.
Rules: ``ord INT, kind STRING ('attr' | 'select'), source STRING, target STRING, regex STRING``.

Plan shape (per grid):

* cell hits: ``posexplode`` of the cells; each label of the (size-checked) rule set is one
  compiled regex evaluated in the scan (large sets: an equi-join with a label index);
* header rows: two partial-aggregating group-bys (cell, then row), written once as a small
  table (one row per header);
* nearest header above and the end of its data region: header rows are unioned into the
  grid stream and one two-level ordered scan (window per ``(doc, table_id, bucket)`` plus
  a per-bucket summary) finds both, so a giant table is split over many tasks and the
  grid is shuffled once;
* projection: pure array expressions on the carried header layout, no join per cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.text import extract, fuzzy_match, fuzzy_match_literal
from gridweave.operators.label_index import INLINE_LABELS, match_labels
from gridweave.operators.scan import DEFAULT_BUCKET_ROWS, carry_last, ranged_buckets, row_bucket, running_sum
from gridweave.session import cut_lineage

TKEY = ["doc", "table_id"]
RKEY = ["doc", "table_id", "row_idx"]


@dataclass(frozen=True)
class RuleSet:
    """Driver-side view of a rules DataFrame (configuration)."""

    attrs: list[tuple[int, str, str]]  # (ord, source, target)
    selects: list[tuple[int, str, str, str | None]]  # (ord, source, target, regex)

    @property
    def targets(self) -> list[str]:
        """Distinct attribute targets in rule order."""
        return list(dict.fromkeys(t for _, _, t in self.attrs))

    @property
    def output_columns(self) -> list[str]:
        """Attribute targets, then select targets, distinct, in order."""
        return list(dict.fromkeys(self.targets + [t for _, _, t, _ in self.selects]))

    @property
    def threshold(self) -> int:
        return min(len(self.targets), 3)


def load_ruleset(rules: DataFrame) -> RuleSet:
    """Collect a rules DataFrame (configuration) once; remembered on the object."""
    cached = getattr(rules, "_gw_ruleset", None)
    if cached is not None:
        return cached
    rs = _load_ruleset(rules)
    try:
        rules._gw_ruleset = rs
    except AttributeError:
        pass
    return rs


def _load_ruleset(rules: DataFrame) -> RuleSet:
    rows = rules.select("ord", "kind", "source", "target", "regex").collect()  # configuration
    rows = sorted(rows, key=lambda r: r["ord"])
    attrs = [(r["ord"], r["source"], r["target"]) for r in rows if r["kind"] == "attr"]
    selects = [
        (r["ord"], r["source"], r["target"], r["regex"]) for r in rows if r["kind"] == "select"
    ]
    return RuleSet(attrs, selects)


def _labels(rules: DataFrame) -> DataFrame:
    """Attribute labels as rows."""
    return rules.where(F.col("kind") == "attr").select(
        F.col("ord").alias("l_ord"),
        F.col("source").alias("label"),
        F.col("target").alias("l_target"),
    )


def label_hits(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` joined with every attribute label that fuzzy-matches their ``cell``: their
    columns, and ``ord`` and ``target`` of the label."""
    rs = load_ruleset(rules)
    if len(rs.attrs) <= INLINE_LABELS:
        hit = [
            F.when(fuzzy_match_literal(F.col("cell"), src), F.struct(F.lit(o).alias("ord"), F.lit(t).alias("target")))
            for o, src, t in rs.attrs
        ]
        hits = F.array_compact(F.array(*hit)) if hit else F.array().cast("array<struct<ord:int,target:string>>")
        return rows.select(*rows.columns, F.explode(hits).alias("__h")).select(*rows.columns, "__h.ord", "__h.target")
    names = list(rows.columns)
    return match_labels(rows, _labels(rules)).select(*names, F.col("l_ord").alias("ord"), F.col("l_target").alias("target"))


def cell_hits(grid: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (cell, label) pair where the label fuzzy-matches the cell.

    Columns: doc, table_id, row_idx, col, cell, n_cells, ord, target.
    """
    cells = grid.select(
        *RKEY,
        F.size("cells").alias("n_cells"),
        F.posexplode("cells").alias("col", "cell"),
    )
    return label_hits(cells, rules).select(*RKEY, "col", "cell", "n_cells", "ord", "target")


def dedup_sources(rules: DataFrame) -> DataFrame:
    """One attribute rule per distinct source label (its first), as the older mapper
    looks each source up once even when it names several targets."""
    a = rules.where(F.col("kind") == "attr")
    first = a.groupBy("source").agg(F.min("ord").alias("ord"))
    return a.join(first, ["source", "ord"], "left_semi")


def find_headers(grid: DataFrame, rules: DataFrame, dedup: bool = False) -> DataFrame:
    """M1: header rows. A row is a header when its (label, cell) hit count reaches
    ``min(#distinct targets, 3)``; a label hitting two cells counts twice.

    Columns: doc, table_id, row_idx, hits, first_ord.
    """
    rs = load_ruleset(rules)
    return (
        cell_hits(grid, dedup_sources(rules) if dedup else rules)
        .groupBy(*RKEY)
        .agg(F.count(F.lit(1)).alias("hits"), F.min("ord").alias("first_ord"))
        .where(F.col("hits") >= F.lit(rs.threshold))
    )


def header_rank_key() -> Column:
    """M2: iteration order of headers inside a document: order of first hit, i.e. the
    first label that hits the row, then the row's coordinate."""
    return F.struct(F.col("first_ord"), F.col("table_id"), F.col("row_idx"))


def header_order(grid: DataFrame, rules: DataFrame) -> DataFrame:
    """M2 as a table: doc, table_id, row_idx, rank (1-based, per document)."""
    h = find_headers(grid, rules)
    # Dense rank as a two-level running count, so a document with very many headers
    # is still numbered by many tasks.
    order = ["first_ord", "table_id", "row_idx"]
    ranked = running_sum(ranged_buckets(h, "doc", order), "doc", order, F.lit(1), "rank", "__range")
    return ranked.select(*RKEY, F.col("rank").cast("bigint").alias("rank"))


def assign_columns(grid: DataFrame, rules: DataFrame, mode: str = "last") -> DataFrame:
    """M3 (``mode='last'``): for every header cell the last matching label wins.
    M12 (``mode='first'``): the first matching label wins and may name several targets.

    Columns: doc, table_id, row_idx, col, header_text, target.
    """
    h = find_headers(grid, rules, dedup=(mode == "first")).select(*RKEY)
    hits = cell_hits(grid, rules).join(h, RKEY, "left_semi")
    if mode == "last":
        return hits.groupBy(*RKEY, "col").agg(
            F.first("cell").alias("header_text"), F.max_by("target", "ord").alias("target")
        )
    if mode == "first":
        # Older rule: the first source label (rule order) that matches a non-empty
        # header cell wins and may name several targets (several rules, one source).
        rs = load_ruleset(rules)
        sources: dict[str, list[str]] = {}
        for _, src, tgt in rs.attrs:
            sources.setdefault(src, []).append(tgt)
        if len(sources) > INLINE_LABELS:
            return _first_wins_join(grid, h, rules)
        cand = F.array_compact(
            F.array(
                *[
                    F.when(
                        fuzzy_match_literal(F.col("cell"), src),
                        F.array(*[F.lit(t) for t in tgts]),
                    )
                    for src, tgts in sources.items()
                ]
            )
        )
        cells = (
            grid.join(h, RKEY, "left_semi")
            .select(*RKEY, F.posexplode("cells").alias("col", "cell"))
            .where(F.col("cell") != "")
            .withColumn("targets", F.try_element_at(cand, F.lit(1)))
            .where(F.col("targets").isNotNull())
        )
        return cells.select(
            *RKEY, "col", F.col("cell").alias("header_text"), F.explode("targets").alias("target")
        )
    raise ValueError(mode)


def _first_wins_join(grid: DataFrame, headers: DataFrame, rules: DataFrame) -> DataFrame:
    """M12 for large label sets: the header cells against the label index."""
    lab_targets = (
        rules.where(F.col("kind") == "attr")
        .groupBy(F.col("source").alias("label"))
        .agg(
            F.min("ord").alias("src_ord"),
            F.transform(F.array_sort(F.collect_list(F.struct("ord", "target"))), lambda x: x["target"]).alias("targets"),
        )
    )
    cells = grid.join(headers, RKEY, "left_semi").select(*RKEY, F.posexplode("cells").alias("col", "cell")).where(F.col("cell") != "")
    hits = match_labels(cells, lab_targets)
    first = hits.groupBy(*RKEY, "col").agg(
        F.first("cell").alias("header_text"), F.min_by("targets", "src_ord").alias("targets")
    )
    return first.select(*RKEY, "col", "header_text", F.explode("targets").alias("target"))


def header_layout(grid: DataFrame, rules: DataFrame, mode: str = "last", materialize: bool = True) -> DataFrame:
    """One row per header with everything later stages need, as a struct ``hdr``:
    row (row_idx), n (cell count), first_ord, targets (ARRAY per column, null where the
    column is unmapped; M12 joins several targets with U+0001), mapped (texts of the
    mapped header cells in column order, for ``@hN``).

    One pass over the cell hits: per cell, then per row (both partially aggregated).
    """
    rs = load_ruleset(rules)
    hit_rules = dedup_sources(rules) if mode == "first" else rules
    per_cell = cell_hits(grid, hit_rules).groupBy(*RKEY, "col").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min("ord").alias("min_ord"),
        F.max_by("target", "ord").alias("target"),
        F.first("cell").alias("header_text"),
        F.first("n_cells").alias("n"),
    )
    per_row = per_cell.groupBy(*RKEY).agg(
        F.sum("cnt").alias("hits"),
        F.min("min_ord").alias("first_ord"),
        F.first("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("col", "target"))).alias("tmap"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("col", "header_text"))), lambda x: x["header_text"]
        ).alias("mapped"),
    ).where(F.col("hits") >= F.lit(rs.threshold))
    if mode == "first":
        cols = assign_columns(grid, rules, mode).groupBy(*RKEY, "col").agg(
            F.first("header_text").alias("header_text"),
            F.array_join(F.collect_list("target"), "\u0001").alias("target"),
        )
        multi = cols.groupBy(*RKEY).agg(
            F.map_from_entries(F.collect_list(F.struct("col", "target"))).alias("tmap"),
            F.transform(
                F.array_sort(F.collect_list(F.struct("col", "header_text"))), lambda x: x["header_text"]
            ).alias("mapped"),
        )
        per_row = per_row.drop("tmap", "mapped").join(multi, RKEY, "left")
    targets = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.try_element_at(F.col("tmap"), i),
    )
    out = per_row.select(
        *RKEY,
        F.struct(
            F.col("row_idx").alias("row"),
            F.col("n").alias("n"),
            F.col("first_ord").alias("first_ord"),
            F.when(F.col("n") > 0, targets).otherwise(F.array().cast("array<string>")).alias(
                "targets"
            ),
            F.coalesce(F.col("mapped"), F.array().cast("array<string>")).alias("mapped"),
        ).alias("hdr"),
    )
    # One row per header: small next to the grid. Writing it once (reliable checkpoint
    # in the shared folder) keeps the label matching from being re-run by every later
    # consumer and keeps the downstream plans short.
    return cut_lineage(out) if materialize else out


def data_rows(
    grid: DataFrame,
    rules: DataFrame,
    mode: str = "last",
    bucket_rows: int = DEFAULT_BUCKET_ROWS,
    layout: DataFrame | None = None,
) -> DataFrame:
    """M4: rows of each data region with their header, as ``hdr`` (see
    :func:`header_layout`).

    A region is the run of rows right after a header that have the header's cell count;
    it stops at the first row with another count, at another header, or at table end.
    """
    lay = layout if layout is not None else header_layout(grid, rules, mode)
    # One ordered pass over the grid. Header rows ride in the same stream, sorted just
    # before the row they describe, so the window's shuffle is the only one of the grid.
    # Per row it finds the nearest header above (cur) and the last "event" at or above
    # it: a header, or a row whose cell count differs from the row before. A row is data
    # iff it is not a header, has the header's cell count, and its last event is the
    # header row or the row right after it (then every row in between has that count).
    hdr_type = lay.schema["hdr"].dataType
    gb = grid.select(*RKEY, "cells", F.lit(None).cast(hdr_type).alias("hdr"), F.lit(1).alias("__k"))
    lb = lay.select(*RKEY, F.lit(None).cast("array<string>").alias("cells"), "hdr", F.lit(0).alias("__k"))
    g = gb.unionByName(lb).withColumn("__rb", row_bucket("row_idx", bucket_rows))
    part = [*TKEY, "__rb"]
    w_in = Window.partitionBy(*part).orderBy("row_idx", "__k")
    upto = w_in.rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("__lh", F.last("hdr", ignorenulls=True).over(upto))
    g = g.withColumn("__own", F.lag("hdr").over(w_in))  # header of this very row, if any
    g = g.where(F.col("__k") == 1).withColumn("__n", F.size("cells"))
    w_row = Window.partitionBy(*part).orderBy("row_idx")
    prev_n = F.lag("__n").over(w_row)
    is_h = F.col("__own").isNotNull() & (F.col("__own.row") == F.col("row_idx"))
    g = g.withColumn("__ish", is_h).withColumn(
        "__ev", F.when(F.col("__ish") | (prev_n.isNotNull() & (prev_n != F.col("__n"))), F.col("row_idx"))
    )
    g = g.withColumn("__le", F.last("__ev", ignorenulls=True).over(w_row.rowsBetween(Window.unboundedPreceding, 0)))
    # One row per bucket, read off the windowed rows (same partitioning, no exchange).
    summ = g.groupBy(*part).agg(
        F.max_by("__lh", "row_idx").alias("b_hdr"),
        F.max("__ev").alias("b_ev"),
        F.min("row_idx").alias("b_first"),
        F.min_by("__n", "row_idx").alias("b_first_n"),
        F.max_by("__n", "row_idx").alias("b_last_n"),
    )
    w_b = Window.partitionBy(*TKEY).orderBy("__rb")
    before = w_b.rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn(
        "b_first_chg", F.lag("b_last_n").over(w_b).isNotNull() & (F.lag("b_last_n").over(w_b) != F.col("b_first_n"))
    )
    summ = summ.withColumn("b_ev_all", F.coalesce("b_ev", F.when(F.col("b_first_chg"), F.col("b_first"))))
    summ = summ.select(
        *part,
        "b_first",
        "b_first_chg",
        F.last("b_hdr", ignorenulls=True).over(before).alias("in_hdr"),
        F.last("b_ev_all", ignorenulls=True).over(before).alias("in_ev"),
    )
    g = g.join(summ, part, "left")
    cur = F.coalesce(F.col("__lh"), F.col("in_hdr"))
    last_ev = F.coalesce(F.col("__le"), F.when(F.col("b_first_chg"), F.col("b_first")), F.col("in_ev"))
    g = g.withColumn("cur", cur).withColumn("__last_ev", last_ev)
    is_data = (
        ~F.col("__ish")
        & F.col("cur").isNotNull()
        & (F.col("__n") == F.col("cur.n"))
        & (F.col("__last_ev") <= F.col("cur.row") + 1)
    )
    return g.where(is_data).select(*RKEY, "cells", F.col("cur").alias("hdr"))


def _project(target: str, sep_multi: bool = False) -> Column:
    """Cell of the rightmost column mapped to ``target``; ``''`` when none is."""
    targets = F.col("hdr.targets")
    if sep_multi:
        targets = F.transform(
            targets, lambda t: F.when(F.array_contains(F.split(t, "\u0001"), F.lit(target)), F.lit(target))
        )
    p = F.array_position(F.reverse(targets), F.lit(target))
    # 0-based index of that column; ``get`` yields null (never an error) out of range.
    idx0 = (F.size("cells") - p).cast("int")
    return F.when(p > 0, F.coalesce(F.get(F.col("cells"), idx0), F.lit(""))).otherwise(F.lit(""))


def map_records(
    grid: DataFrame,
    rules: DataFrame,
    mode: str = "last",
    keep_header: bool = False,
    bucket_rows: int = DEFAULT_BUCKET_ROWS,
    layout: DataFrame | None = None,
) -> DataFrame:
    """M5: data rows projected onto the rule targets (M13 order). Two columns mapped to
    one target: the rightmost wins; a target without a column is ``''``.

    Columns: doc, table_id, row_idx, <targets...> (+ ``hdr`` when ``keep_header``).
    """
    rs = load_ruleset(rules)
    rows = data_rows(grid, rules, mode, bucket_rows, layout)
    outs = [_project(t, mode == "first").alias(t) for t in rs.targets]
    extra = ["hdr"] if keep_header else []
    return rows.select(*RKEY, *outs, *extra)


def select_values(records: DataFrame, rules: DataFrame, doc_text: DataFrame | None = None) -> DataFrame:
    """M6-M9: apply select rules to records produced with ``keep_header=True``.

    * ``@hN`` - text of the N-th mapped header cell (M6);
    * any other source - regex searched in the document text (M7, needs ``doc_text``
      with columns doc, text); the whole match is taken;
    * optional second regex over the value, null when it does not match (M8);
    * the value fills the target only when it is absent or null (M9): attribute targets
      already hold ``''``, so a select onto them changes nothing.
    """
    rs = load_ruleset(rules)
    out = records
    per_doc = {}
    regex_selects = [s for s in rs.selects if not s[1].startswith("@h")]
    if regex_selects and doc_text is None:
        # No document text: such selects find nothing (null), as in the reference.
        doc_text = records.sparkSession.createDataFrame([], "doc string, text string")
    if regex_selects:
        # Evaluate document-level selects once per document, then join the small result.
        per_doc = {f"__sel{i}": extract("text", src, 0) for i, (_, src, _, _) in enumerate(regex_selects)}
        doc_vals = doc_text.select("doc", *[c.alias(n) for n, c in per_doc.items()])
        out = out.join(doc_vals, "doc", "left")
    names = iter(per_doc)
    for _, src, target, post in rs.selects:
        if src.startswith("@h"):
            digits = src[2:]
            n = int(digits) if digits.isdigit() else 0
            val = F.try_element_at(F.col("hdr.mapped"), F.lit(n + 1))
        else:
            val = F.col(next(names))
        if post:
            val = extract(val, post, 0)
        if target in out.columns:
            out = out.withColumn(target, F.coalesce(F.col(target), val))
        else:
            out = out.withColumn(target, val)
    return out.drop(*per_doc.keys())


def region_bounds(grid: DataFrame, rules: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """Per header: its rank key and the last row of its data region (null when empty),
    plus ``break_end`` = last region row when the region stopped at a bad row (the older
    mapper's notion used by ``@tN``)."""
    lay = layout if layout is not None else header_layout(grid, rules)
    rows = data_rows(grid, rules, layout=lay)
    ends = rows.groupBy("doc", "table_id", F.col("hdr.row").alias("row_idx")).agg(
        F.max("row_idx").alias("data_end")
    )
    sizes = grid.groupBy(*TKEY).agg(F.max("row_idx").alias("table_last"))
    b = lay.join(ends, RKEY, "left").join(sizes, TKEY, "left")
    region_last = F.coalesce(F.col("data_end"), F.col("row_idx"))
    return b.select(
        *RKEY,
        F.col("hdr.first_ord").alias("first_ord"),
        "data_end",
        F.when(region_last < F.col("table_last"), region_last).alias("break_end"),
    )


def describe_table(grid: DataFrame, rules: DataFrame, bucket_rows: int = DEFAULT_BUCKET_ROWS, layout: DataFrame | None = None) -> DataFrame:
    """Text above each header (with a non-empty region): rows from the end of the
    previous non-empty region in header order (if in the same table, else the table
    start) up to the header, each row's cells joined, rows concatenated.

    Columns: doc, table_id, row_idx (header row), description.
    """
    lay = layout if layout is not None else header_layout(grid, rules)
    b = region_bounds(grid, rules, lay)
    prev = F.when(F.col("data_end").isNotNull(), F.struct(F.col("table_id").alias("t"), F.col("data_end").alias("e")))
    # Headers in rank order per document; two-level so a document with very many
    # headers still spreads out.
    b = b.withColumn("rk", F.struct("first_ord", "table_id", "row_idx"))
    order = ["first_ord", "table_id", "row_idx"]
    b = carry_last(ranged_buckets(b, "doc", order), "doc", order, prev, "prev", "__range", inclusive=False)
    start = F.when(F.col("prev.t") == F.col("table_id"), F.col("prev.e") + 1).otherwise(F.lit(0))
    heads = b.where(F.col("data_end").isNotNull()).select(*RKEY, start.alias("d_start"))
    # Range join rows [d_start, row_idx) of the same table, through row buckets.
    spans = heads.withColumn(
        "bk",
        F.explode(
            F.when(
                F.col("d_start") < F.col("row_idx"),
                F.sequence(
                    F.floor(F.col("d_start") / bucket_rows), F.floor((F.col("row_idx") - 1) / bucket_rows)
                ),
            ).otherwise(F.array(F.lit(-1).cast("bigint")))
        ),
    )
    g = grid.select(
        F.col("doc"),
        F.col("table_id"),
        F.col("row_idx").alias("r"),
        F.floor(F.col("row_idx") / bucket_rows).alias("bk"),
        F.array_join(F.col("cells"), "").alias("txt"),
    )
    inside = (F.col("r") >= F.col("d_start")) & (F.col("r") < F.col("row_idx"))
    texts = spans.join(g, ["doc", "table_id", "bk"], "left").where(inside | F.col("r").isNull())
    agg = texts.groupBy(*RKEY).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(inside, F.struct("r", "txt")))), lambda x: x["txt"]
            ),
            "",
        ).alias("description")
    )
    return heads.select(*RKEY).join(agg, RKEY, "left").select(
        *RKEY, F.coalesce("description", F.lit("")).alias("description")
    )


def select_title(grid: DataFrame, rules: DataFrame, n: int, regex: str | None = None) -> DataFrame:
    """M11 (``@tN``): first non-empty cell of the row ``n`` above each header, unless that
    row is negative or not after the previous region's stop row (older mapper rule,
    compared as row numbers in header order); optional regex takes the whole match.

    Columns: doc, table_id, row_idx (header row), title.
    """
    lay = header_layout(grid, rules)
    b = region_bounds(grid, rules, lay)
    order = ["first_ord", "table_id", "row_idx"]
    b = carry_last(ranged_buckets(b, "doc", order), "doc", order, F.col("break_end"), "prev_end", "__range", inclusive=False)
    t_row = F.col("row_idx") - F.lit(n)
    b = b.withColumn("t_row", t_row).withColumn(
        "ok", (F.col("t_row") >= 0) & (F.col("t_row") > F.coalesce(F.col("prev_end"), F.lit(-1)))
    )
    g = grid.select("doc", "table_id", F.col("row_idx").alias("t_row"), "cells")
    j = b.join(g, ["doc", "table_id", "t_row"], "left")
    first_nonempty = F.try_element_at(
        F.filter(F.col("cells"), lambda c: c.isNotNull() & (F.length(c) > 0)), F.lit(1)
    )
    title = F.when(F.col("ok"), first_nonempty)
    if regex:
        title = extract(title, regex, 0)
    return j.select(*RKEY, title.alias("title"))


def map_documents(
    grid: DataFrame,
    rules: DataFrame,
    strategies=None,
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Each document goes to the first strategy that accepts it.

    A strategy is ``(accepts(grid, rules) -> DataFrame[doc], run(grid, rules) -> DataFrame)``.
    Returns ``(records, rejects)`` where rejects lists documents nobody accepted; with
    ``strict`` a non-empty reject set raises, as the reference does.
    """
    strategies = strategies or [COLUMN_STRATEGY]
    remaining = grid
    outs = []
    for accepts, run in strategies:
        acc = accepts(remaining, rules).select("doc").distinct()
        taken = remaining.join(acc, "doc", "left_semi")
        outs.append(run(taken, rules))
        remaining = remaining.join(acc, "doc", "left_anti")
    rejects = remaining.select("doc").distinct()
    if strict and not rejects.isEmpty():
        raise RuntimeError("no mapping strategy accepts some documents")
    records = outs[0]
    for o in outs[1:]:
        records = records.unionByName(o, allowMissingColumns=True)
    return records, rejects


def _column_accepts(grid: DataFrame, rules: DataFrame) -> DataFrame:
    return find_headers(grid, rules).select("doc")


def _column_run(grid: DataFrame, rules: DataFrame) -> DataFrame:
    return map_records(grid, rules)


COLUMN_STRATEGY = (_column_accepts, _column_run)


def locate_value(cells: DataFrame, label: str) -> DataFrame:
    """All coordinates (``path``) whose text fuzzy-matches ``label``.

    Input cells: doc, path ARRAY<INT>, text."""
    return cells.where(fuzzy_match(F.col("text"), F.lit(label))).select("doc", "path")


def value_at(cells: DataFrame, coords: DataFrame) -> DataFrame:
    """Value at each requested coordinate (equi-join on doc and path)."""
    return coords.join(cells, ["doc", "path"], "left").select("doc", "path", "text")
