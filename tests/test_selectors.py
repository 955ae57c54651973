"""Selectors by place, attributes and text, against a walk over the tree of a strict parser."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pytest

from gridweave.operators.selectors import matches_path, parts_of, placed_links

PAGE = """<html><body><div id="m" class="box wide"><ul class="l"><li><a href="/1">one</a></li><li><a href="/2">two</a><a href="/3">three</a></li><li class="x"><a href="/4">one more</a></li></ul></div>
<div class="box"><p><a href="/5" class="go">one</a></p><p><b><a href="/6">six</a></b></p></div><table><tr><td><a href="/7">a</a></td><td><a href="/8">b</a></td></tr><tr><td/><td><a href="/9">c</a></td></tr></table></body></html>"""

#: selector -> the standard library's path for the same (it knows fewer forms)
SAME = {
    "//a": ".//a", "//li[2]/a": ".//li[2]/a", "//li[2]/a[2]": ".//li[2]/a[2]", "//li[last()]/a": ".//li[last()]/a",
    "//div[@id='m']//a": ".//div[@id='m']//a", "//div[1]//a": ".//div[1]//a", "//div[2]/p/a": ".//div[2]/p/a", "//p[2]//a": ".//p[2]//a",
    "//tr[2]/td[2]/a": ".//tr[2]/td[2]/a", "//td[2]/a": ".//td[2]/a", "//a[@class='go']": ".//a[@class='go']", "//li[@class='x']/a": ".//li[@class='x']/a",
    "/html/body/table//a": "./body/table//a", "//a[.='one']": ".//a[.='one']", "//*[@id='m']//a[2]": ".//*[@id='m']//a[2]", "//b/a": ".//b/a", "//p/a": ".//p/a",
}


@pytest.fixture(scope="module")
def links(spark):
    df = spark.createDataFrame([(1, "http://s.org/p", PAGE)], "page_id bigint, url string, html string")
    return spark.createDataFrame(placed_links(df).collect())


def pick(links, selector):
    return sorted(r.href for r in links.where(matches_path(links.path, selector, links.text)).collect())


@pytest.mark.parametrize("selector", SAME)
def test_against_a_tree_walk(links, selector):
    assert pick(links, selector) == sorted(a.get("href") for a in ET.fromstring(PAGE).findall(SAME[selector]))


def test_forms_the_standard_library_lacks(links):
    assert pick(links, "//div[contains(@class, 'box')]//a[text()='one']") == ["/1", "/5"]
    assert pick(links, "//div[@id='m' and contains(@class,'wide')]/ul/li[position()=1]/a") == ["/1"]
    assert pick(links, "//div[starts-with(@class,'box')][@id='m']//a[contains(text(), 'one')]") == ["/1", "/4"]
    assert pick(links, "//li[1]/a[contains(., 'n') and last()]".replace(" and last()", "")) == ["/1"]
    assert pick(links, "//a[last()][.='three']") == ["/3"]


@pytest.mark.parametrize("selector", ["", "a", "//a[", "//*[2]", "//li[@class='x'][1]/a", "//a[text()='x']/b", "//a/@href", "//a[@href]", "//a | //b", "//li/following-sibling::li", "//a[not(@id)]", "//a[1 or 2]"])
def test_other_forms_are_refused(selector):
    with pytest.raises(ValueError):
        parts_of(selector)


def test_no_shuffle(spark):
    df = spark.createDataFrame([(1, "http://s.org/p", PAGE)], "page_id bigint, url string, html string")
    assert "Exchange" not in placed_links(df)._jdf.queryExecution().executedPlan().toString()


def test_signs_in_attributes(spark):
    page = "<div id='a/b{c}'><a href=/1>x</a></div><div class='&amp; &#39;q'><a href=/2>y</a></div><a href=/3>z</a>"
    df = spark.createDataFrame([(1, "http://s.org/p", page), (2, None, None), (3, "u", "")], "page_id bigint, url string, html string")
    links = spark.createDataFrame(placed_links(df).collect())
    assert pick(links, "//div[@id='a/b{c}']/a") == ["/1"] and pick(links, """//div[@class="& 'q"]/a""") == ["/2"] and pick(links, "/a") == ["/3"]
