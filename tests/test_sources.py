import os
import tempfile

import pytest
from pyspark.sql import functions as F

from gridweave.sources.pages import read_grid, read_pages, route_pages
from gridweave.sources.rules import check_seeds, read_rules, rules_from_dict, seeds, select_rules

XML = """<spider id="s1" class="g1" is_active="True">
  <url value=" http://a.org/start " mapping="m1" output="o1">
    <url xpath="//a" regex="^2019" mapping="m1">
      <next xpath="//a[@class='n']" regex="next"/>
    </url>
    <next xpath="//a" regex="more"/>
  </url>
  <mapping id="m1"><table><col attri="name">NAME</col><col attri="age">AGE</col><col select="@h1" regex="[0-9]+">H</col></table></mapping>
  <outputs id="o1"><csv>out1</csv><redis>k1</redis></outputs>
  <outputs><csv>default_csv</csv></outputs>
</spider>
"""
XML_OFF = """<spider id="s2" class="g1" is_active="False"><url value="http://b.org/"/></spider>"""
XML_BLANK = """<spider id="s3"><url value="  "/></spider>"""


@pytest.fixture(scope="module")
def rule_dir():
    d = tempfile.mkdtemp(prefix="gw-rules-")
    for name, text in (("a.xml", XML), ("b.xml", XML_OFF), ("c.xml", XML_BLANK)):
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(text)
    return d


def test_read_rules(spark, rule_dir):
    steps, rules, outputs = read_rules(spark, os.path.join(rule_dir, "a.xml"))
    st = {tuple(r.step_id): r for r in steps.collect() if not r.is_next}
    assert st[(0,)].url == "http://a.org/start" and st[(0,)].mapping_id == "m1" and st[(0,)].output_id == "o1"
    child = [r for k, r in st.items() if k == (0, 0) and not r.is_next][0]
    assert child.regex == "^2019" and child.xpath == "//a"
    nxt = [r for r in steps.collect() if r.is_next]
    assert sorted((tuple(r.step_id), r.cond_ord, r.regex) for r in nxt) == [((0,), 1, "more"), ((0, 0), 0, "next")]
    rl = sorted((r.rule_id, r.ord, r.kind, r.source, r.target, r.regex) for r in rules.collect())
    assert rl == [("m1", 0, "attr", "name", "NAME", None), ("m1", 1, "attr", "age", "AGE", None),
                  ("m1", 2, "select", "@h1", "H", "[0-9]+")]
    outs = sorted((r.output_id, r.sink, r.key) for r in outputs.collect())
    assert outs == [("default", "csv", "default_csv"), ("o1", "csv", "out1"), ("o1", "redis", "k1")]


def test_select_rules_and_seeds(spark, rule_dir):
    steps, _, _ = read_rules(spark, rule_dir)
    active = select_rules(steps, group="g1")
    assert {r.spider_id for r in active.collect()} == {"s1"}
    assert {r.spider_id for r in select_rules(steps).collect()} == {"s1", "s3"}  # absent flag = active
    with pytest.raises(ValueError):
        select_rules(steps, rule_set_id="s2")
    ok = seeds(select_rules(steps, rule_set_id="s1"))
    assert [r.url for r in check_seeds(ok).collect()] == ["http://a.org/start"]
    with pytest.raises(ValueError):
        check_seeds(seeds(select_rules(steps, rule_set_id="s3")))


def test_rules_from_dict(spark):
    r = rules_from_dict(spark, "x", {"城市名称": "CITY", "@h0": "H"}).orderBy("ord").collect()
    assert [(x.kind, x.source, x.target) for x in r] == [("attr", "城市名称", "CITY"), ("select", "@h0", "H")]


def test_read_grid_and_pages(spark):
    d = tempfile.mkdtemp(prefix="gw-grid-")
    os.makedirs(os.path.join(d, "book"))
    with open(os.path.join(d, "book", "s1.csv"), "w") as f:
        f.write("id,name\n1,a\n2,b\n")
    with open(os.path.join(d, "book", "s2.csv"), "w") as f:
        f.write("x\n")
    g = read_grid(spark, os.path.join(d, "book"))
    rows = sorted((r.row_idx, tuple(r.cells)) for r in g.collect())
    assert rows == [(0, ("id", "name")), (0, ("x",)), (1, ("1", "a")), (2, ("2", "b"))]
    with open(os.path.join(d, "p.html"), "w") as f:
        f.write("<html>x</html>")
    pg = read_pages(spark, os.path.join(d, "p.html"), fmt="text").first()
    assert pg.html == "<html>x</html>" and pg.url.endswith("p.html")


def test_route_pages(spark):
    df = spark.createDataFrame(
        [(1, "http://a/x.docx", None), (2, "http://a/y", "text/html"), (3, "http://a/z.xlsx", None), (4, "http://a/q", None)],
        "page_id bigint, url string, content_type string",
    )
    ok, rej = route_pages(df)
    assert sorted((r.page_id, r.kind) for r in ok.collect()) == [(1, "docx"), (2, "html"), (3, "xls")]
    assert [r.page_id for r in rej.collect()] == [4]
