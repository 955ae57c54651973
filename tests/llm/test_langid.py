"""Language fusion against plain sums over the pages; long and broken pages."""

from __future__ import annotations

import math
import re
import time
from collections import Counter

import numpy as np
import pytest

from gridweave.llm import langid
from gridweave.llm.common import read

from .test_brute import SF


def parts_of(url):
    m = re.search(r"^(?:[a-z]+:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "", re.I)
    host = m[1].lower() if m else ""
    labels = host.split(".")
    return host, ".".join(labels[-2:]) if len(labels) > 1 else "", labels[-1] if len(labels) > 1 else ""


def brute(pages, langs, table):
    k, rows = len(langs), []
    for page, url, html in pages:
        tag = re.search(r"<html(\s[^>]*)", html or "", re.I)
        lang = re.search(r"\slang\s*=\s*[\"']?([a-z]{2,3})", tag[1] if tag else "", re.I)
        bins = langid.trigrams(langid.visible(html or ""))
        ll = table[:, bins].sum(1) * (min(1, 40 / len(bins)) if len(bins) else 0)
        p = np.exp(ll - ll.max()) / np.exp(ll - ll.max()).sum()
        rows.append((page, *parts_of(url), lang[1].lower() if lang else "", p))
    seen = {i: {} for i in range(1, 5)}
    for r in rows:
        for i in range(1, 5):
            seen[i][r[i]] = seen[i].get(r[i], 0) + r[5]
    every, out = sum(r[5] for r in rows), Counter()
    for page, host, domain, suffix, declared, p in rows:
        prior = (every - p + 0.5) / (len(rows) - 1 + 0.5 * k)
        for i, v in ((2, domain), (1, host)):
            prior = (seen[i][v] - p + 5 * prior) / (seen[i][v].sum() - 1 + 5)
        said = lambda i, v, p=p: 0 if v == "" else np.log((seen[i][v] - p + 0.5) / (every - p + 0.5 * len(seen[i])))
        s = np.log(np.maximum(p, 1e-30)) + np.log(prior) + said(4, declared) + 5 / (seen[2][domain].sum() - 1 + 5) * said(3, suffix)
        out[page, langs[int(np.argmax(s))], round(float(1 / np.exp(s - s.max()).sum()), 6), declared, suffix, host] += 1
    return out


@pytest.mark.parametrize("which", ["given", "made"])
def test_fusion(spark, which):
    model = langid.learn_text(read(spark, SF, "documents"))
    rows = [(r.page_id, r.url, r.html) for r in read(spark, SF, "pages").collect()]
    if which == "made":
        text = {k: re.sub("<[^>]*>", " ", rows[k][2])[:400] for k in range(12)}
        rows = [(i, f"http://h{i % 3}.{'one' if i % 4 else 'two'}.{('de', 'fr', 'com')[i % 3]}/p{i}", f"<html lang={('de', 'fr', 'en')[i % 3]}>{text[i % 12]}") for i in range(40)]
        rows += [(50, None, None), (51, "", "x"), (52, "http://h0.two.de/q", ""), (53, "http://only.se/", text[1]), (53, "http://only.se/", text[1])]
    schema = "page_id long, url string, html string"
    got = langid.identify(spark.createDataFrame(rows, schema), *model).collect()
    assert Counter((r.page_id, r.lang, round(r.confidence, 6), r.declared, r.suffix, r.host) for r in got) == brute(rows, *model)


def test_the_suffix_speaks(spark):
    """Two pages without words: what tells them apart is the suffix of hosts seen once."""
    model = langid.learn_text(read(spark, SF, "documents"))
    docs = [r for r in read(spark, SF, "documents").where("lang in ('de', 'fr')").collect() if r.n_chars > 300]
    rows = [(i, f"http://a{i}.x{i}.{r.lang}/", f"<p>{r.text}") for i, r in enumerate(docs)]
    rows += [(1000, "http://n1.new1.de/", "<p>1"), (1001, "http://n2.new2.fr/", "<p>1")]
    got = {r.page_id: r.lang for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), *model).collect()}
    assert (got[1000], got[1001]) == ("de", "fr")


@pytest.mark.parametrize("html", ["<" * 1_000_000, "<script>" * 130_000, "<!--" * 250_000, "<html " * 150_000, "<style>x</script>" * 60_000, "</script " * 100_000, "word " * 400_000], ids=lambda h: h[:8])
def test_long_and_broken_pages(spark, html):
    model = langid.learn_text(read(spark, SF, "documents"))
    t = time.time()
    r = langid.identify(spark.createDataFrame([(1, "http://h.de/", html)], "page_id long, url string, html string"), *model).first()
    assert r.page_id == 1 and math.isfinite(r.confidence) and time.time() - t < 30


def test_visible():
    see = lambda h: langid.visible(h).split()
    assert see("a<script>x</script>b<SCRIPT q>y</Script >c<!-- z -->d<style>e") == ["a", "b", "c", "d", "e"]
    assert see("<!-- a <script> b --> c </script> d") == ["c", "d"] and see("a > b < c") == ["a", ">", "b", "<", "c"]
    assert see("<script>a<!-- b</script>c-->d") == ["c-->d"] and see("x&amp;y") == ["x&y"]
