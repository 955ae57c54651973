"""Physical-plan properties the operators are built around (checked on explain output)."""

import re

import __spark_entry__ as E
from gridweave.operators import mapping as M
from gridweave.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_link_extraction_is_one_narrow_stage(spark):
    p = plan(E.queries()["extract_links"](spark, SF))
    assert "Exchange" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p  # no Python UDFs


def test_column_pruning_reaches_the_scan(spark):
    p = plan(E.queries()["url_postfix"](spark, SF))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    assert schemas and all("html" not in s for s in schemas)


def test_data_regions_shuffle_the_grid_once_by_bucket(spark):
    g = fx.grid(spark, SF)
    r = fx.grid_rules(spark)
    lay = M.header_layout(g, r)  # written once; later plans read it back
    p = plan(M.data_rows(g, r, layout=lay))
    parts = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", p)
    keys = [re.sub(r"#\d+L?", "", x).rsplit(",", 1)[0].strip() for x in parts]
    # no shuffle on the row key (no join of the grid with its header info) ...
    assert "doc, table_id, row_idx" not in keys
    # ... the only grid-sized shuffle is by (doc, table_id, bucket)
    assert all(k in ("doc, table_id, __rb", "doc, table_id") for k in keys), keys
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_label_matching_needs_no_join_for_small_rule_sets(spark):
    p = plan(M.cell_hits(fx.grid(spark, SF), fx.grid_rules(spark)))
    assert "Join" not in p and "Exchange" not in p


def test_no_python_udfs_anywhere(spark):
    for name in ["map_records", "resolve_url", "quote_url", "rowspan_fill", "fuzzy_match"]:
        p = plan(E.queries()[name](spark, SF))
        assert "EvalPython" not in p and "PythonUDF" not in p, name


def test_page_queries_read_html_once(spark):
    from gridweave.operators import pages as PG
    from gridweave.operators.selectors import placed_links
    from gridweave.plans.fixtures import pages

    p = pages(spark, SF)
    for df in (PG.page_elements(PG.page_tokens(p)), PG.html_tables(p)):
        text = plan(df)
        assert len(re.findall(r"ReadSchema: struct<[^>]*html", text)) == 1
        assert text.count("Exchange hashpartitioning") == 1  # by page, for every window and group
    for name in ("node_text", "links_in_container", "link_neighbour", "article_blocks", "container_children"):
        assert "html:string" not in plan(E.queries()[name](spark, SF)), name  # reads the stored tokens
    text = plan(placed_links(p))  # one pass over the pages
    assert len(re.findall(r"ReadSchema: struct<[^>]*html", text)) == 1 and "Exchange" not in text


def test_range_buckets_split_a_hot_key_and_bound_the_summary(spark):
    from pyspark.sql import functions as F

    from gridweave.operators.scan import carry_last, ranged_buckets

    rows = spark.range(20_000).select(F.when(F.col("id") < 8_000, F.lit(0)).otherwise(F.col("id") % 3_000).alias("k"), "id")
    b = ranged_buckets(rows.repartition(8), "k", "id")
    pairs = b.select("k", "__range").distinct().count()
    keys, ranges = b.select("k").distinct().count(), b.select("__range").distinct().count()
    assert pairs <= keys + ranges
    assert b.where("k = 0").select("__range").distinct().count() > 1 or ranges == 1
    got = carry_last(b, "k", "id", F.when(F.col("id") % 50 == 0, F.col("id")), "v", "__range").where("k = 0 and v <> id - id % 50")
    assert got.where("id < 8000").count() == 0
