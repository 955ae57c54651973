"""The rule-driven job from XML files to written sinks; sources and sinks in detail."""

import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from gridweave.operators.aggregates import url_counts_keyed
from gridweave.operators.job import run_rules
from gridweave.sinks.files import write_all, write_csv
from gridweave.sources.pages import read_grid
from gridweave.sources.rules import read_rules

XML = """<spider id="s">
  <url value="http://s.org/" >
    <url xpath="//div[@id='years']//a" regex="^20">
      <url xpath="//li/a" mapping="m" output="o"/>
      <next xpath="//a[@class='next']"/>
    </url>
    <url regex="^20"/>
  </url>
  <mapping id="m"><table><col attri="name">NAME</col><col attri="age">AGE</col><col attri="city">CITY</col></table></mapping>
  <outputs id="o"><csv>people</csv><redis>list</redis></outputs>
</spider>"""


def table(*rows):
    return "<table><tr><th>name</th><th>age</th><th>city</th></tr>" + "".join(f"<tr><td>{a}</td><td>{b}</td><td>{c}</td></tr>" for a, b, c in rows) + "</table>"


PAGES = {
    "http://s.org/": '<div id="years"><a href="/2019">2019</a><a href="/about">about</a></div><a href="/2018">2018</a>',
    "http://s.org/2019": '<ul><li><a href="/d 1">d1</a></li></ul><a class="next" href="/2019?p=2">more</a>',
    "http://s.org/2019?p=2": '<ul><li><a href="/d2">d2</a></li></ul><a class="next" href="/2019">back</a>',
    "http://s.org/2018": '<ul><li><a href="/no">no</a></li></ul>',
    "http://s.org/d%201": table(("ann", 1, "x, y"), ("bob", 2, 'say "hi"')),
    "http://s.org/moved": table(("cid", 3, "z")),
    "http://s.org/no": table(("no", 0, "no")),
}


def test_rules_to_sinks(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "s.xml").write_text(XML)
    steps, rules, outputs = read_rules(spark, str(tmp_path / "r"))
    pages = spark.createDataFrame([(i, u, f"<html><body>{h}</body></html>") for i, (u, h) in enumerate(PAGES.items())], "page_id bigint, url string, html string")
    redirects = spark.createDataFrame([("http://s.org/d2", "http://s.org/moved")], "from_url string, to_url string")
    job = run_rules(pages, steps, rules, outputs, redirects)
    assert {(r.url, r.step_id) for r in job.frontier.collect()} == {
        ("http://s.org/", "0"), ("http://s.org/2019", "0/0"), ("http://s.org/2019?p=2", "0/0"),
        ("http://s.org/d%201", "0/0/0"), ("http://s.org/d2", "0/0/0"), ("http://s.org/moved", "0/0/0"),
    }
    items = job.items.withColumns({c: F.col("data_item")[c] for c in ("NAME", "AGE", "CITY")})
    routed = job.routed.withColumns({c: F.col("data_item")[c] for c in ("NAME", "AGE", "CITY")})
    order = ["page_id", "table_id", "row_idx"]
    write_all(items, routed, str(tmp_path / "out"), ["NAME", "AGE", "CITY"], order)
    rows = [r for f in glob.glob(str(tmp_path / "out/csv/key=people/*.csv")) for r in list(csv.reader(open(f, encoding="utf-8")))[1:]]
    # cells are cleaned of spaces when they are read from the page
    assert sorted(rows) == [["ann", "1", "x,y"], ["bob", "2", 'say"hi"'], ["cid", "3", "z"]]
    lists = [json.loads(line) for f in glob.glob(str(tmp_path / "out/redis/key=list/*.json")) for line in open(f, encoding="utf-8")]
    assert sorted(json.loads(x["record"])["NAME"] for x in lists) == ["ann", "bob", "cid"]
    counts = {r.url: (r.key, r.n) for r in spark.read.json(str(tmp_path / "out/counts")).collect()}
    assert counts == {"http://s.org/d%201": ("urls_list", 2), "http://s.org/moved": ("urls_list", 1)}


def test_deep_rules_and_any_sink(spark, tmp_path):
    deep = "".join(f'<url xpath="//a" regex="r{i}">' for i in range(8)) + "</url>" * 8
    (tmp_path / "d.xml").write_text(f'<spider id="d"><!-- <url> --><url value="u">{deep}</url><url value="v"/><outputs><mysql>t &amp; u</mysql><csv>c</csv></outputs></spider>')
    steps, _, outputs = read_rules(spark, str(tmp_path / "d.xml"))
    assert sorted(len(r.step_id) for r in steps.collect()) == [1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert sorted(tuple(r) for r in outputs.collect()) == [("d", "default", "csv", "c"), ("d", "default", "mysql", "t & u")]


def test_unknown_sinks_are_errors_and_writers_can_be_given(spark, tmp_path):
    items = spark.createDataFrame([(1, "u", "a")], "i int, url string, name string")
    routed = items.withColumns({"sink": F.lit("mysql"), "key": F.lit("k"), "data_item": F.create_map(F.lit("n"), F.col("name"))})
    with pytest.raises(ValueError):
        write_all(items, routed, str(tmp_path / "a"), ["name"], ["i"])
    seen = []
    write_all(items, routed, str(tmp_path / "b"), ["name"], ["i"], {"mysql": lambda rows, path: seen.append(rows.count())})
    assert seen == [1]


def test_counts_begin_with_the_first_key(spark):
    rows = spark.createDataFrame([(0, "u0", None), (1, "u1", "k"), (2, "u1", None), (3, "u2", "z")], "i int, url string, key string")
    assert sorted(tuple(r) for r in url_counts_keyed(rows, ["i"]).collect()) == [("urls_k", "u1", 2), ("urls_k", "u2", 1)]
    assert url_counts_keyed(rows.where("key is null"), ["i"]).count() == 0


def test_csv_keeps_values(spark, tmp_path):
    made = [(" a ", 'say "hi"'), ("", "x,y"), ("é", " ")]
    write_csv(spark.createDataFrame([(*r, "k") for r in made], "a string, b string, key string"), str(tmp_path / "c"), ["a", "b"])
    back = [tuple(r) for f in glob.glob(str(tmp_path / "c/key=k/*.csv")) for r in list(csv.reader(open(f, encoding="utf-8")))[1:]]
    assert sorted(back) == sorted(made)


def test_grid_files(spark, tmp_path):
    folder = tmp_path / "book"
    folder.mkdir()
    (folder / "b.csv").write_text('a,"b,c",d\n"say ""x""", e ,\n')
    (folder / "a.csv").write_text("1,2\n")
    got = sorted((r.table_id, r.row_idx, r.cells) for r in read_grid(spark, str(folder)).collect())
    assert got == [(0, 0, ["1", "2"]), (1, 0, ["a", "b,c", "d"]), (1, 1, ['say "x"', " e ", ""])]
    from gridweave.operators.pages import to_cells

    assert to_cells(read_grid(spark, str(folder))).count() == 8
    assert os.path.basename(read_grid(spark, str(folder)).first()["doc"]) == "book"


def test_routing_by_an_expression(spark):
    from gridweave.sinks.routing import route_outputs

    items = spark.createDataFrame([("http://a/x",), ("http://b/y",), ("http://c/z",)], "url string")
    outs = spark.createDataFrame([("A", "csv", "ka"), ("default", "csv", "kd")], "output_id string, sink string, key string")
    got = route_outputs(items, outs, lambda d: F.when(d.url.contains("//a/"), F.lit("A")).otherwise(F.lit("none")))
    assert sorted((r.url, r.key) for r in got.collect()) == [("http://a/x", "ka"), ("http://b/y", "kd"), ("http://c/z", "kd")]
