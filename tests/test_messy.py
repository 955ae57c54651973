"""Broken markup: expected results by hand, and against the standard library's parser."""

from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from gridweave.operators import frontier as FR
from gridweave.operators import links as LK
from gridweave.operators import pages as PG


def frame(spark, *htmls):
    return spark.createDataFrame([(i, "http://s.org/d/p", h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")


def elements(spark, html, tag):
    return sorted((r.id, r.start, r.end) for r in PG.page_elements(PG.page_tokens(frame(spark, html))).where(f"tag = '{tag}'").collect())


def test_stray_close_tags_pair_nothing(spark):
    assert elements(spark, "</div><div id=a>x</div><div id=b>y</div>", "div") == [("a", 1, 3), ("b", 4, 6)]
    assert elements(spark, "<div id=a></div></div></div><div id=b><div id=c></div></div>", "div") == [("a", 0, 1), ("b", 4, 7), ("c", 5, 6)]
    assert elements(spark, "<a id=x><p><a id=y>t</a></a>", "a") == [("x", 0, 1), ("y", 2, 4)]


def test_references_in_links(spark):
    html = '<a href="/p?a=1&amp;b=2">&eacute; &#20013;</a><a name="top"><p>t</p><a href="/x">x</a><a href=/y>y<a href=/z>z'
    got = [(r.pos, r.href, r.dst_url, r.text) for r in LK.extract_links(frame(spark, html)).orderBy("pos").collect()]
    assert got == [
        (0, "/p?a=1&b=2", "http://s.org/p?a=1&b=2", "é 中"),
        (1, "/x", "http://s.org/x", "x"), (2, "/y", "http://s.org/y", "y"), (3, "/z", "http://s.org/z", "z"),
    ]


def grid(spark, html):
    return PG.html_tables(frame(spark, html))


def rows(g):
    return {(r.table_id, r.row_idx): r.cells for r in g.collect()}


def test_tables_of_broken_markup(spark):
    assert rows(grid(spark, "<table><tr><td rowspan=2>a</td></tr><tr></tr><tr><td>c</td></tr></table>")) == {(0, 0): ["a"], (0, 1): [], (0, 2): ["c"]}
    assert rows(grid(spark, "<table><tr><td>a<td>b<tr><td>c</table>tail")) == {(0, 0): ["a", "b"], (0, 1): ["c"]}
    assert rows(grid(spark, "</table><table><td>a</td></td><td>b</td></table></table><table><tr><td>c")) == {(0, 0): ["a", "b"], (1, 0): ["c"]}
    assert rows(grid(spark, "<table><tr><td>o<table><tr><td>i</td></tr></table></td><td>p</td></tr></table>")) == {(0, 0): ["oi", "p"]}
    assert rows(grid(spark, "<table></table><table><tr><th>x</th></tr></table>")) == {(1, 0): ["x"]}
    filled = PG.fill_rowspan(grid(spark, "<table><tr><td rowspan=2>a</td></tr><tr></tr><tr><td>c</td></tr></table>"))
    assert rows(filled) == {(0, 0): ["a"], (0, 1): ["a"], (0, 2): ["c"]}


class Links(HTMLParser):
    """Links as (href, text): an anchor ends at its closing tag or the next anchor."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.open = [], False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = dict(attrs).get("href")
            self.open = href is not None
            if self.open:
                self.links.append([href, ""])

    def handle_endtag(self, tag):
        self.open = self.open and tag != "a"

    def handle_data(self, data):
        if self.open:
            self.links[-1][1] += data


PART = st.sampled_from(['<a href="/x?a&amp;b">', "<a href='/y'>", "<a name=n>", "</a>", "<div>", "</div>", "<b>", "</p>", "t1", " &eacute; ", "&#233;", "<br>", "<li>", "u &lt; v"])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(PART, max_size=14), min_size=12, max_size=12))
def test_links_property(spark, pages):
    want = []
    for i, parts in enumerate(pages):
        p = Links()
        p.feed("".join(parts))
        p.close()
        want += [(i, h, t) for h, t in p.links]
    got = LK.extract_links(frame(spark, *["".join(x) for x in pages])).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.href, r.text) for r in got] == want


def test_long_chain_takes_few_rounds(spark):
    n = 100
    edges = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(n)], "src_url string, dst_url string")
    seeds = spark.createDataFrame([("p0",), ("p50",)], "url string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {r.url: r.hop for r in FR.follow_next(seeds, edges).collect()}
    jobs = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("", "")
    assert got == {f"p{i}": i if i < 50 else i - 50 for i in range(n + 1)}
    assert jobs < 90  # some ten jobs in each of log2(n) rounds, not in each of n
    branch = edges.limit(12).union(spark.createDataFrame([("p3", "q")], "src_url string, dst_url string"))
    got = {r.url: r.hop for r in FR.follow_next(seeds.limit(1), branch).collect()}
    assert got["q"] == 4 and got["p12"] == 12


def test_selectors(spark):
    from gridweave.operators.selectors import matches_path, placed_links

    html = '<div id="m"><ul class="l"><li><a href="/1">one</a></li></ul></div><p><a href="/2 é">two</a></p><ul><a href="/3">three</a></ul>'
    lk = placed_links(p := frame(spark, html), PG.stored_tokens(p)).cache()
    pick = lambda s: sorted(r.text for r in lk.where(matches_path(lk.path, s)).collect())
    assert pick("//a") == ["one", "three", "two"]
    assert pick("//div[@id='m']//a") == ["one"]
    assert pick("//ul[@class='l']/li/a") == ["one"] and pick("//ul/a") == ["three"] and pick("/p/a") == ["two"] and pick("//*[@id='m']/a") == []
    assert {r.dst_url for r in lk.collect()} == {"http://s.org/1", "http://s.org/2%20%C3%A9", "http://s.org/3"}


def test_other_layouts_map_like_tables(spark):
    """A list page: T12 children, split at a sign, become cells and are mapped; deeper
    paths make the same grid."""
    from pyspark.sql import functions as F

    from gridweave.operators.mapping import map_records
    from gridweave.sources.rules import rules_frame

    html = "<ul class=x><li>name: age: city</li><li>ann: 1: x</li><li>bob: 2: y</li></ul>"
    t = PG.stored_tokens(frame(spark, html))
    kids = PG.container_children(PG.page_elements(t), "class", "x", ("li",))
    txt = PG.element_text(kids.select("page_id", "c_start", "start", "end", "child_no"), t)
    cells = PG.children_cells(txt.withColumn("piece", F.split("text", ": ")))
    rules = rules_frame(spark, "r", [(0, "attr", "name", "N", None), (1, "attr", "age", "A", None), (2, "attr", "city", "C", None)])
    want = [("ann", "1", "x"), ("bob", "2", "y")]
    assert sorted((r.N, r.A, r.C) for r in map_records(PG.cells_to_grid(cells), rules).collect()) == want
    deep = cells.withColumn("path", F.concat(F.array(F.lit(7).cast("bigint"), F.lit(3).cast("bigint")), "path"))
    assert sorted((r.N, r.A, r.C) for r in map_records(PG.cells_to_grid(deep), rules).collect()) == want
