from urllib.parse import quote, urljoin

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import fuzzy
from gridweave.functions import text as X
from gridweave.functions.urls import base_name, postfix, quote_url, resolve_url

X1_CASES = [("aab", "ba", True), ("ba", "ab", False), ("ba", "aa", True), ("a", "", True), ("", "a", False),
            (None, "a", False), ("a", None, False), ("中文字符", "文符", True), ("name of customer", "name", True)]


def test_fuzzy_cases(spark):
    df = spark.createDataFrame([(s, r) for s, r, _ in X1_CASES], "s string, r string")
    got = df.select(X.fuzzy_match("s", "r").alias("m")).collect()
    assert [g.m for g in got] == [e for _, _, e in X1_CASES]
    lit = [row.m for row in df.select(*[X.fuzzy_match_literal("s", r).alias("m") for r in ["ba"]]).collect()]
    assert lit == [fuzzy(s, "ba") for s, _, _ in X1_CASES]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("ab.*\\ 中", max_size=6), st.text("ab.*\\ 中", max_size=4)), min_size=1, max_size=30))
def test_fuzzy_property(spark, pairs):
    df = spark.createDataFrame(pairs, "s string, r string")
    got = [r.m for r in df.select(X.fuzzy_match("s", "r").alias("m")).collect()]
    assert got == [fuzzy(s, r) for s, r in pairs]
    for r in {r for _, r in pairs}:
        lit = [x.m for x in df.select(X.fuzzy_match_literal("s", r).alias("m")).collect()]
        assert lit == [fuzzy(s, r) for s, _ in pairs]


def test_clean_and_text(spark):
    df = spark.createDataFrame([("a b\tc\n\r d　e",), (None,)], "s string")
    assert [r.c for r in df.select(X.clean_text("s").alias("c")).collect()] == ["abcde", None]
    h = spark.createDataFrame([("<p>a &amp; <b>b</b>&lt;</p>",)], "h string")
    assert h.select(X.node_text("h").alias("t")).first().t == "a & b<"


def test_extract_and_digits(spark):
    df = spark.createDataFrame([("2019年",), ("年",), ("none",), ("1.0",), ("12",)], "s string")
    rows = df.select(
        X.extract("s", r"(\d*)年", 1).alias("y"),
        X.extract("s", r"(?<=20)\d\d", 0).alias("look"),
        X.is_digits("s").alias("d"),
        X.to_int("s").alias("n"),
    ).collect()
    assert [r.y for r in rows] == ["2019", "", None, None, None]
    assert rows[0].look == "19"
    assert [r.d for r in rows] == [False, False, False, False, True]
    assert rows[4].n == 12


def test_append_if_observed_and_intended(spark):
    df = spark.createDataFrame([("a", ""), ("a", "x"), ("a", None)], "c string, o string")
    assert [r.v for r in df.select(X.append_if("c", "o").alias("v")).collect()] == ["a", "ax", "a"]
    assert [r.v for r in df.select(X.append_if("c", "o", True).alias("v")).collect()] == ["a", "ax", "a"]


URLS = ["http://h.example.com/en/825?page=2&ref=x", "https://m.x.net/en/25#top", "https://b.org/en/853/",
        "http://h.com", "http://h.com/a/b/c.html"]
HREFS = [None, "", "/x", "x", "../x", "./x", "../../../x", "//other.org/p", "?q=1", "#f", "a/./b/../c", "https://z.org/y",
         "x/..", "x/.", "a//b", "/a/../b"]


def test_resolve_matches_urljoin(spark):
    pairs = [(u, h) for u in URLS for h in HREFS]
    df = spark.createDataFrame(pairs, "u string, h string")
    got = [r.v for r in df.select(resolve_url("u", "h").alias("v")).collect()]
    want = [urljoin(u, h) if h else u for u, h in pairs]
    assert got == want


def test_quote_matches_python(spark):
    vals = ["http://a.org/路径 x*~%#?a=1&b=2", "plain", "", "é/ü"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.q for r in df.select(quote_url("v").alias("q")).collect()]
    assert got == [quote(v, safe=";/?:@&=+$,", encoding="utf-8") for v in vals]


def test_postfix_and_base_name(spark):
    vals = ["http://a/b/file.docx", "http://a/b/file", None, "", "x.tar.gz?v=1"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    rows = df.select(postfix("v").alias("p"), base_name("v").alias("b")).collect()
    assert [r.p for r in rows] == ["docx", "", "", "", "gz?v=1"]
    assert [r.b for r in rows] == ["file", "file", "", "", "x.tar"]


SEG = st.sampled_from(["a", "b", ".", "..", "", "x.html"])


@settings(max_examples=20, deadline=None)
@given(
    st.lists(st.tuples(st.lists(SEG, max_size=4), st.lists(SEG, max_size=4), st.booleans(), st.sampled_from(["", "?q=1", "#f", "?a#b"])),
             min_size=1, max_size=20)
)
def test_resolve_property(spark, cases):
    pairs = []
    for base_segs, href_segs, absolute, tail in cases:
        base = "http://h.org/" + "/".join(base_segs)
        href = ("/" if absolute else "") + "/".join(href_segs) + tail
        pairs.append((base, href))
    df = spark.createDataFrame(pairs, "u string, h string")
    got = [r.v for r in df.select(resolve_url("u", "h").alias("v")).collect()]
    assert got == [urljoin(u, h) if h else u for u, h in pairs]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), max_size=8), min_size=1, max_size=20))
def test_quote_property(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.q for r in df.select(quote_url("v").alias("q")).collect()]
    assert got == [quote(v, safe=";/?:@&=+$,", encoding="utf-8") for v in vals]
