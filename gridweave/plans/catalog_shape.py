"""Registered queries: shaping (E*), counts (A*), routing (K1), HTML tables (T5-T11),
older-mapper column rule (M12) and strategy rejects (M14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions import text as X
from gridweave.operators import aggregates as AG
from gridweave.operators import mapping as M
from gridweave.operators import pages as PG
from gridweave.operators import shaping as SH
from gridweave.operators.scan import ranged_buckets
from gridweave.plans import fixtures as fx
from gridweave.plans.catalog import register
from gridweave.sinks.routing import route_outputs
from gridweave.sources.rules import rules_frame

# Fixed values used below.
LINE_PATTERNS = {"email": (r"[A-Za-z0-9_.+\-]+@[A-Za-z0-9\-]+\.[A-Za-z0-9.\-]+", 0), "year": (r"(19|20)[0-9]{2}", 0)}
SECTION_LEVELS = ("first", "second", "third", "fourth", "fifth")
MULTI_RULES = (
    (0, "attr", "key", "cust_key", None),
    (1, "attr", "name", "cust_name", None),
    (2, "attr", "balance", "balance", None),
    (3, "attr", "segment", "segment", None),
    (4, "attr", "segment", "segment_copy", None),
    (5, "attr", "acct", "balance", None),
)
# Output routing: documents of region 0 go to output "zero", the rest to "default".
OUTPUTS = (("default", "json", "records"), ("default", "csv", "records_csv"), ("zero", "json", "region0"))


def _records(spark, sf):
    return M.map_records(fx.grid(spark, sf), fx.grid_rules(spark))


def _items(spark, sf):
    rec = _records(spark, sf)
    return rec.withColumn("url", F.concat(F.col("doc"), F.lit("/t/"), F.col("table_id").cast("string")))


@register("carry_heading")
def q_carry(spark, sf):
    ev = ranged_buckets(fx.headed_events(spark, sf), "user_id", ["ts", "event_id"])
    out = SH.carry_forward(
        ev,
        "user_id",
        ["ts", "event_id"],
        F.col("event_type") == "signup",
        F.col("event_id").cast("string"),
        "__range",
        out="heading",
    )
    return out.select("event_id", "user_id", "heading")


@register("lines_to_records")
def q_lines(spark, sf):
    ln = fx.lines(spark, sf)
    return SH.lines_to_records(ln, "line", LINE_PATTERNS).select("doc_id", "pos", "email", "year")


@register("serial_sections")
def q_serial(spark, sf):
    s = fx.serials(spark, sf)
    out = SH.sections_by_reset(
        s, "part", ["conv_id", "turn"], "no", SECTION_LEVELS, F.floor(F.col("conv_id") / F.lit(4096))
    )
    return out.select("part", "conv_id", "turn", "level", "section")


@register("unpivot_pairs")
def q_unpivot(spark, sf):
    p = fx.order_pairs(spark, sf)
    return SH.unpivot_pairs(p, ["row_idx"], [("a1", "b1"), ("a2", "b2")], ("a", "b"), order="row_idx").select(
        F.col("row_idx").alias("o_orderkey"), F.col("pair_no").cast("bigint").alias("pair_no"), "a", "b"
    )


@register("explode_names")
def q_explode(spark, sf):
    ln = fx.lines(spark, sf)
    ln = ln.withColumn("items", F.when(F.col("line").contains(" "), F.split("line", " ")))
    out = SH.explode_names(ln, ["doc_id", "pos"], "line", "items")
    return out.select("doc_id", "pos", F.col("name_pos").cast("bigint").alias("name_pos"), "name")


@register("item_envelope")
def q_items(spark, sf):
    it = SH.to_items(_items(spark, sf), "url", ["cust_key", "cust_name", "balance", "segment"])
    return it.select("url", F.explode("data_item").alias("item_key", "item_value"))


@register("url_counts")
def q_url_counts(spark, sf):
    return AG.url_counts(_items(spark, sf))


def _routed(spark, sf):
    items = _items(spark, sf).withColumn(
        "output_id", F.when(F.col("doc") == "r/0", F.lit("zero"))
    )
    outs = spark.createDataFrame(list(OUTPUTS), "output_id string, sink string, key string")
    return route_outputs(items, outs)


@register("route_outputs")
def q_route_outputs(spark, sf):
    return _routed(spark, sf).select("url", "table_id", "row_idx", "sink", "key")


@register("url_counts_json")
def q_url_counts_json(spark, sf):
    routed = _routed(spark, sf).where(F.col("sink") == "json")
    return AG.url_counts_keyed(routed, ["doc", "table_id", "row_idx"])


@register("html_table_roundtrip")
def q_roundtrip(spark, sf):
    pg = fx.grid_html(spark, sf)
    g = PG.html_tables(pg)
    return g.select(
        F.shiftright(F.col("doc").cast("bigint"), 40).alias("table_id"),
        (F.col("doc").cast("bigint").bitwiseAND(F.lit(fx.BLOCK_MASK)) * fx.RENDER_BLOCK + F.col("row_idx")).cast("bigint").alias("row_idx"),
        F.array_join("cells", "|").alias("cells"),
    )


@register("rowspan_fill")
def q_rowspan(spark, sf):
    pg = fx.grid_html(spark, sf, rowspans=True)
    g = PG.fill_rowspan(PG.html_tables(pg))
    return g.select(
        F.shiftright(F.col("doc").cast("bigint"), 40).alias("table_id"),
        (F.col("doc").cast("bigint").bitwiseAND(F.lit(fx.BLOCK_MASK)) * fx.RENDER_BLOCK + F.col("row_idx")).cast("bigint").alias("row_idx"),
        F.array_join("cells", "|").alias("cells"),
    )


@register("grid_to_cells")
def q_cells(spark, sf):
    c = PG.to_cells(fx.grid(spark, sf))
    return c.select("doc", F.array_join("path", ".").alias("path"), "text")


@register("locate_value")
def q_locate(spark, sf):
    c = PG.to_cells(fx.grid(spark, sf))
    return M.locate_value(c, "name").select("doc", F.array_join("path", ".").alias("path"))


@register("value_at")
def q_value_at(spark, sf):
    c = PG.to_cells(fx.grid(spark, sf))
    hits = M.locate_value(c, "name")
    below = hits.select("doc", F.array(F.col("path")[0], F.col("path")[1] + 1, F.col("path")[2]).alias("path"))
    return M.value_at(c, below).select("doc", F.array_join("path", ".").alias("path"), "text")


@register("join_nested")
def q_join_nested(spark, sf):
    g = fx.grid(spark, sf)
    nested = F.array(F.slice("cells", 1, 2), F.slice("cells", 3, 100))
    return g.select(*M.RKEY, X.join_nested(nested, "").alias("joined"))


@register("distinct_ordered")
def q_distinct(spark, sf):
    ln = fx.lines(spark, sf)
    return ln.select("doc_id", "pos", F.array_join(X.distinct_ordered(F.split("line", " ")), " ").alias("words"))


@register("assign_multi")
def q_assign_multi(spark, sf):
    g = fx.grid(spark, sf)
    r = rules_frame(spark, "multi", MULTI_RULES)
    return M.map_records(g, r, mode="first")


@register("mapping_rejects")
def q_rejects(spark, sf):
    g = fx.grid(spark, sf).unionByName(fx.line_grid(spark, sf))
    _, rejects = M.map_documents(g, fx.grid_rules(spark))
    docs = g.select("doc").distinct()
    return docs.join(rejects.withColumn("rej", F.lit(True)), "doc", "left").select(
        "doc", F.col("rej").isNull().alias("accepted")
    )


@register("carry_heading_reset")
def q_carry_reset(spark, sf):
    """E1, the ``dt`` variant: a heading without a label (a signup whose value is below
    10) resets the carried label to null instead of keeping the previous one."""
    ev = fx.read(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    ev = ranged_buckets(ev, "user_id", ["ts", "event_id"])
    label = F.when(F.col("value") >= 10, F.col("event_id").cast("string"))
    out = SH.carry_forward(
        ev,
        "user_id",
        ["ts", "event_id"],
        F.col("event_type") == "signup",
        label,
        "__range",
        out="heading",
        null_sets=True,
    )
    return out.select("event_id", "user_id", "heading")


# Fixed value: a heading line is one short sentence (at most four words, one final period).
HEADING_RE = r"^[^ .]+( [^ .]+){0,3}\.$"


@register("heading_lines")
def q_heading_lines(spark, sf):
    """E1 + E2 + X6 as in the line-based spider: heading lines label the lines below
    them and emit nothing; a following line becomes a record when at least one of the
    patterns hits it (the others are '')."""
    ln = fx.lines(spark, sf)
    carried = SH.carry_forward(
        ln,
        "doc_id",
        "pos",
        F.coalesce(F.col("line").rlike(HEADING_RE), F.lit(False)),
        F.col("line"),
        F.floor(F.col("pos") / F.lit(4096)),
        out="heading",
    )
    return SH.lines_to_records(carried, "line", LINE_PATTERNS).select("doc_id", "pos", "heading", "email", "year")


@register("rowspan_pairs")
def q_rowspan_pairs(spark, sf):
    """T5 -> T6 -> E5 as in the merged-cell table spider: parse the rendered tables, fill
    rowspans down, then turn the column pairs (1, 2) and (3, 4) of every full row into two
    records each, skipping each table's first row."""
    pg = fx.grid_html(spark, sf, rowspans=True)
    g = PG.fill_rowspan(PG.html_tables(pg)).where(F.size("cells") == 5)
    g = g.select(
        F.shiftright(F.col("doc").cast("bigint"), 40).alias("table_id"),
        F.col("doc").cast("bigint").bitwiseAND(F.lit(fx.BLOCK_MASK)).alias("block"),
        "row_idx",
        *[F.col("cells")[i].alias(f"c{i}") for i in range(5)],
    )
    out = SH.unpivot_pairs(g, ["table_id", "block", "row_idx"], [("c1", "c2"), ("c3", "c4")], ("a", "b"), order="row_idx")
    return out.select(
        "table_id",
        (F.col("block") * fx.RENDER_BLOCK + F.col("row_idx")).cast("bigint").alias("row_idx"),
        F.col("pair_no").cast("bigint").alias("pair_no"),
        "a",
        "b",
    )


@register("labelled_records")
def q_labelled_records(spark, sf):
    """L7 + L9 + M5 + L12 as in the label-carrying spiders: expand the frontier from the
    region seeds one level (nation pages inherit the region label), map each nation
    page's table, and attach the label its page carried."""
    from gridweave.operators import frontier as FR

    # the wanted level, nation pages, is said of the edges
    edges = fx.tree_edges(spark, sf).where(F.col("dst_url").startswith("n/"))
    reach = FR.expand(fx.tree_seeds(spark, sf), edges, labels=True)
    rec = _records(spark, sf).withColumn("url", F.concat(F.lit("n/"), F.col("table_id").cast("string")))
    out = FR.lookup(rec, reach.select("url", F.col("labels")["region"].alias("region")), "url", "left")
    return out.select("doc", "table_id", "row_idx", "cust_key", "cust_name", "region")


ITEM_FIELDS = ("cust_key", "cust_name", "balance", "segment")


@register("json_list")
def q_json_list(spark, sf):
    """K1 -> K3: items routed to the JSON sink are written as keyed JSON lists (into the
    shared checkpoint folder) and read back as the list reader sees them."""
    import os
    import uuid

    from gridweave.session import checkpoint_dir
    from gridweave.sinks.files import write_json_list

    routed = _routed(spark, sf).where(F.col("sink") == "json")
    items = routed.withColumn(
        "data_item", F.map_from_arrays(F.array(*[F.lit(f) for f in ITEM_FIELDS]), F.array(*[F.col(f) for f in ITEM_FIELDS]))
    )
    path = os.path.join(checkpoint_dir(spark), f"gw-json-{uuid.uuid4().hex}")
    write_json_list(items, path, ["doc", "table_id", "row_idx"])
    back = spark.read.schema("seq struct<doc:string,table_id:bigint,row_idx:bigint>, record string").json(path)
    return back.select(
        "key",
        "record",
        F.col("seq.doc").alias("seq_doc"),
        F.col("seq.table_id").alias("seq_table_id"),
        F.col("seq.row_idx").alias("seq_row_idx"),
    )


@register("csv_files")
def q_csv_files(spark, sf):
    """K1 -> K2: items routed to the CSV sink are written as one CSV folder per key with
    a header row (into the shared checkpoint folder) and read back."""
    import os
    import uuid

    from gridweave.session import checkpoint_dir
    from gridweave.sinks.files import write_csv

    routed = _routed(spark, sf).where(F.col("sink") == "csv")
    path = os.path.join(checkpoint_dir(spark), f"gw-csv-{uuid.uuid4().hex}")
    cols = ["doc", "table_id", "row_idx", *ITEM_FIELDS]
    write_csv(routed, path, cols)
    schema = "doc string, table_id bigint, row_idx bigint, " + ", ".join(f"{c} string" for c in ITEM_FIELDS)
    # empty fields are values here (records default to empty strings), not nulls
    back = spark.read.option("header", True).option("nullValue", "\\N").schema(schema).csv(path)
    return back.select("key", *cols)


def _stream_dir(spark, kind: str) -> str:
    import os
    import uuid

    from gridweave.session import checkpoint_dir

    return os.path.join(checkpoint_dir(spark), f"gw-{kind}-{uuid.uuid4().hex}")


@register("stream_url_counts")
def q_stream_url_counts(spark, sf):
    """R2 + R4: mapped items arrive as files, one file per micro-batch; running counts
    per URL are kept as streaming state, and every micro-batch writes the complete
    counts under its batch id. The result is the last batch's output."""
    from gridweave.streaming import stream as S

    src, out = _stream_dir(spark, "items"), _stream_dir(spark, "counts")
    items = _items(spark, sf).select("url", "doc", "table_id", "row_idx")
    items.repartition(4, "doc", "table_id").write.parquet(src)
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (
        S.running_url_counts(stream)
        .writeStream.outputMode("complete")
        .foreachBatch(S.keyed_batch_writer(out, lambda b: b))
        .option("checkpointLocation", out + "-ckpt")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    # batch_id is a partition column of the output; keep the last one (scalar subquery)
    allb = spark.read.parquet(out)
    last = allb.agg(F.max("batch_id").alias("m")).scalar()
    return allb.where(F.col("batch_id") == last).select("url", "n")


@register("stream_seen_urls")
def q_stream_seen_urls(spark, sf):
    """Pages arrive twice (two file drops of the whole table); the stream keeps each
    URL once."""
    src, out = _stream_dir(spark, "pages"), _stream_dir(spark, "seen")
    pages = fx.pages(spark, sf).select("page_id", "url")
    pages.write.parquet(src + "/drop=1")
    pages.write.parquet(src + "/drop=2")
    from gridweave.streaming import stream as S

    stream = spark.readStream.schema("page_id bigint, url string").option("recursiveFileLookup", True).parquet(src)
    q = (
        S.drop_seen_urls(stream)
        .select("url")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", out + "-ckpt")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(out).select("url")
