import json
import os
import tempfile

from pyspark.sql import functions as F

from gridweave.operators.aggregates import url_counts, url_counts_keyed
from gridweave.operators.shaping import to_items
from gridweave.sinks.files import read_json_list, write_all, write_csv, write_json_list
from gridweave.sinks.routing import route_outputs
from gridweave.streaming import stream as S


def _items(spark):
    rec = spark.createDataFrame(
        [("u1", 0, "张三", "1"), ("u1", 1, "b", "2"), ("u2", 2, "c", "3")], "url string, i bigint, name string, n string"
    )
    return rec


def test_routing_and_files(spark):
    rec = _items(spark).withColumn("output_id", F.when(F.col("url") == "u2", F.lit("special")).when(F.col("i") == 0, F.lit("nope")))
    outs = spark.createDataFrame([("default", "csv", "c1"), ("default", "json", "j1"), ("special", "json", "j2")], "output_id string, sink string, key string")
    routed = route_outputs(rec, outs)
    got = sorted((r.url, r.i, r.sink, r.key) for r in routed.collect())
    assert got == [("u1", 0, "csv", "c1"), ("u1", 0, "json", "j1"), ("u1", 1, "csv", "c1"), ("u1", 1, "json", "j1"), ("u2", 2, "json", "j2")]
    base = tempfile.mkdtemp(prefix="gw-out-")
    items = to_items(routed, "url", ["name", "n"]).withColumn("i", F.col("url")).select("url", "data_item")
    routed_items = routed.withColumn("data_item", F.create_map(F.lit("name"), F.col("name"), F.lit("n"), F.col("n")))
    write_json_list(routed_items.where(F.col("sink") == "json"), os.path.join(base, "json"), ["i"])
    lst = [json.loads(r.record) for r in read_json_list(spark, os.path.join(base, "json"), "j1").collect()]
    assert lst == [{"name": "b", "n": "2"}, {"name": "张三", "n": "1"}]  # newest first, non-ASCII kept
    write_csv(routed.where(F.col("sink") == "csv"), os.path.join(base, "csv"), ["name", "n"])
    back = spark.read.option("header", True).csv(os.path.join(base, "csv")).collect()
    assert sorted((r.name, r.n, r.key) for r in back) == [("b", "2", "c1"), ("张三", "1", "c1")]
    assert items.count() == 5


def test_counts_keyed_and_fanout(spark):
    rec = _items(spark).withColumn("key", F.when(F.col("i") == 0, F.lit("first")).otherwise(F.lit("other")))
    got = sorted((r.key, r.url, r.n) for r in url_counts_keyed(rec, ["i"]).collect())
    assert got == [("urls_first", "u1", 2), ("urls_first", "u2", 1)]
    blank = rec.withColumn("key", F.when(F.col("i") == 0, F.lit(" ")).otherwise(F.lit("x")))
    assert url_counts_keyed(blank, ["i"]).count() == 0
    outs = spark.createDataFrame([("default", "csv", "c1"), ("default", "json", "j1")], "output_id string, sink string, key string")
    routed = route_outputs(_items(spark).withColumn("output_id", F.lit(None).cast("string")), outs).withColumn(
        "data_item", F.create_map(F.lit("name"), F.col("name"))
    )
    base = tempfile.mkdtemp(prefix="gw-all-")
    write_all(_items(spark), routed, base, ["name", "n"], ["i"])
    counts = spark.read.json(os.path.join(base, "counts")).collect()
    assert sorted((r.key, r.url, r.n) for r in counts) == [("urls_j1", "u1", 2), ("urls_j1", "u2", 1)]


def test_streaming_matches_batch(spark):
    from gridweave.operators.mapping import map_records
    from gridweave.operators.pages import html_tables
    from gridweave.sources.rules import rules_frame

    src = tempfile.mkdtemp(prefix="gw-stream-src-")
    out = tempfile.mkdtemp(prefix="gw-stream-out-")
    html = "<table><tr><td>id</td><td>name</td><td>age</td></tr><tr><td>1</td><td>a</td><td>2</td></tr></table>"
    pages = spark.createDataFrame([(1, "u1", html), (2, "u2", html.replace(">a<", ">b<")), (3, "u1", html)], "page_id bigint, url string, html string")
    pages.repartition(3).write.mode("overwrite").parquet(src)
    rules = rules_frame(spark, "r", [(0, "attr", "id", "id", None), (1, "attr", "name", "name", None), (2, "attr", "age", "age", None)])
    stream = S.read_pages_stream(spark, src, max_files=1)
    q = S.map_pages_stream(stream, rules, out, name=f"map-{os.path.basename(out)}").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.doc, r.name) for r in spark.read.parquet(out).collect())
    batch = map_records(html_tables(pages).select("doc", "table_id", "row_idx", "cells"), rules)
    assert got == sorted((r.doc, r.name) for r in batch.collect())

    # R2 running counts, R3 URL dedupe
    cnt = S.running_url_counts(stream).writeStream.outputMode("complete").format("memory").queryName("gw_counts").start()
    cnt.processAllAvailable()
    cnt.stop()
    assert sorted((r.url, r.n) for r in spark.sql("SELECT * FROM gw_counts").collect()) == [("u1", 2), ("u2", 1)]
    dd = S.drop_seen_urls(stream).writeStream.format("memory").queryName("gw_dedupe").start()
    dd.processAllAvailable()
    dd.stop()
    assert sorted(r.url for r in spark.sql("SELECT url FROM gw_dedupe").collect()) == ["u1", "u2"]


def test_keyed_batch_writer_is_idempotent(spark):
    out = tempfile.mkdtemp(prefix="gw-r4-")
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    w = S.keyed_batch_writer(out, lambda b: b)
    w(df, 7)
    w(df, 7)  # replay of the same batch replaces its own output
    assert spark.read.parquet(out).count() == 1


def test_dedupe_within_watermark(spark):
    src = tempfile.mkdtemp(prefix="gw-wm-src-")
    rows = [("u1", "2024-01-01 00:00:00"), ("u1", "2024-01-01 00:10:00"), ("u2", "2024-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "url string, t string").selectExpr("url", "cast(t as timestamp) as arrived")
    df.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = S.drop_seen_urls(stream, arrival="arrived", delay="1 hour").writeStream.format("memory").queryName("gw_wm").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.url for r in spark.sql("SELECT url FROM gw_wm").collect()) == ["u1", "u2"]


def test_csv_bom_and_route_without_content_type(spark):
    from gridweave.sources.pages import route_pages

    base = tempfile.mkdtemp(prefix="gw-bom-")
    df = spark.createDataFrame([("a", "1", "k")], "name string, n string, key string")
    write_csv(df, base, ["name", "n"], bom=True)
    part = [f for f in os.listdir(os.path.join(base, "key=k")) if f.endswith(".csv")][0]
    with open(os.path.join(base, "key=k", part), "rb") as f:
        assert f.read().startswith("﻿name,n".encode("utf-8"))
    ok, rej = route_pages(spark.createDataFrame([(1, "http://a/x.pdf")], "page_id bigint, url string"))
    assert [r.kind for r in ok.collect()] == ["pdf"] and rej.count() == 0
