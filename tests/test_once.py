"""All sinks in one write, against the csv and json modules writing item by item."""

from __future__ import annotations

import csv
import glob
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from gridweave.sinks.once import read_lines, sink_lines, write_once
from gridweave.sources.pages import read_grid

ITEM = "url string, i bigint, sink string, key string, data_item map<string,string>"


def model(items, routed):
    """Items one by one, as a single process would: {(sink, key): text or list or dict}."""
    lists, tables, writers, counts, run_key = {}, {}, {}, {}, None
    for url, i in sorted(items, key=lambda x: x[1]):
        mine = sorted((r for r in routed if r[1] == i), key=lambda r: r[2] == "csv")
        lost = False
        for _, _, sink, key, data in mine:
            if not key:
                continue
            if sink == "json":
                run_key = run_key or key
                lists.setdefault(("json", key), []).insert(0, data)
            else:
                if key not in writers:
                    tables[key] = io.StringIO(newline="")
                    tables[key].write("﻿")
                    writers[key] = csv.DictWriter(tables[key], fieldnames=list(data))
                    writers[key].writeheader()
                try:
                    writers[key].writerow(data)
                except ValueError:
                    lost = True
        if not lost and run_key is not None and run_key.strip() and url is not None:
            counts[url] = counts.get(url, 0) + 1
    out = {**lists, **{("csv", k): t.getvalue() for k, t in tables.items()}}
    return out | ({("counts", f"urls_{run_key}"): counts} if run_key and run_key.strip() and counts else {})


def read_back(base):
    out = {}
    for folder in glob.glob(os.path.join(base, "sink=*", "key=*")):
        sink, key = (x.split("=", 1)[1] for x in folder.split(os.sep)[-2:])
        text = "".join(open(f, encoding="utf-8", newline="").read() for f in sorted(glob.glob(os.path.join(folder, "part-*"))))
        # a CSV line ends in CR LF, the others in LF
        out[sink, key] = [json.loads(x) for x in text.splitlines()] if sink == "json" else json.loads(text) if sink == "counts" else text
    return out


def run(spark, tmp_path, items, routed, name="o"):
    base = str(tmp_path / name)
    # through lists, as a dict on its way to the JVM loses its order
    rows = spark.createDataFrame([(*r[:4], list(r[4]), list(r[4].values())) for r in routed], "url string, i bigint, sink string, key string, ks array<string>, vs array<string>")
    rows = rows.select("url", "i", "sink", "key", F.map_from_arrays("ks", "vs").alias("data_item"))
    write_once(spark.createDataFrame(items, "url string, i bigint"), rows, base, ["i"])
    return base, read_back(base)


VALUES = ["", "a", "x,y", 'q"q', "l\nm", " s ", "é中", "\r", None]


def test_against_item_by_item(spark, tmp_path):
    items = [(f"http://u/{i % 7}\"é" if i % 11 else None, i) for i in range(300)]
    routed = []
    for url, i in items:
        data = {"b": VALUES[i % len(VALUES)], "a": str(i)} if i % 3 else {"only": VALUES[i % len(VALUES)]}
        if i > 4:
            routed.append((url, i, "json", f"j{i % 2}", data))
        routed.append((url, i, "csv", f"c{i % 3}", data if i != 30 else {**data, "more": "x"}))
        if i % 5 == 0:
            routed.append((url, i, "csv", "", data))
    base, got = run(spark, tmp_path, items, routed)
    assert got == model(items, routed)
    cells = {r.row_idx: list(r.cells) for r in read_grid(spark, base + "/sink=csv/key=c1").where("table_id = 0").collect()}
    assert cells[0] == ["b", "a"]
    lines = read_lines(spark, base).where("sink = 'json' and key = 'j0'").orderBy("no").collect()
    assert [json.loads(r.line) for r in lines] == got["json", "j0"] and [r.no for r in lines] == list(range(len(lines)))
    run(spark, tmp_path, items, routed)  # again: the same files' contents
    assert read_back(base) == got


def test_a_key_over_many_files(spark, tmp_path):
    """One key with nearly all items is dealt to several tasks; its files by name are one CSV."""
    items = [(f"u{i}", i) for i in range(3000)]
    routed = [(u, i, s, "hot" if i % 100 else "cold", {"n": str(i), "t": "v" * 50}) for u, i in items for s in ("csv", "json")]
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        base, got = run(spark, tmp_path, items, routed)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)
    assert len(glob.glob(base + "/sink=csv/key=hot/part-*")) > 1 and len(glob.glob(base + "/sink=counts/*/part-*")) > 1
    assert got == model(items, routed)


def test_one_write_and_one_reading_of_the_items(spark, tmp_path):
    items = spark.createDataFrame([("u", 1)], "url string, i bigint")
    reads = spark.sparkContext.accumulator(0)

    def seen(x):
        reads.add(1)
        return x

    rows = spark.createDataFrame([("u", 1, s, "k", {"a": "1"}) for s in ("csv", "json")], ITEM)
    source = rows.withColumn("url", F.udf(seen, "string")("url")).withColumn("data_item", F.when(F.col("url").isNotNull(), F.col("data_item")))
    lines = sink_lines(items, source, ["i"]).repartitionByRange("sink", "key")
    lines.collect()
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "seen" not in plan  # all lines come from the written table
    assert reads.value == 2


def test_nothing_to_write(spark, tmp_path):
    _, got = run(spark, tmp_path, [("u", 1)], [])
    assert got == {}
    _, got = run(spark, tmp_path, [("u", 1), ("v", 2)], [("u", 1, "json", " ", {"a": "1"}), ("v", 2, "json", "x", {"a": "2"})], "blank")
    assert {k for k in got if k[0] == "counts"} == set()
    with pytest.raises(ValueError):
        run(spark, tmp_path, [("u", 1)], [("u", 1, "tape", "k", {"a": "1"})], "bad")
