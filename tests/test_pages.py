from pyspark.sql import functions as F

from gridweave.operators import links as LK
from gridweave.operators import pages as PG

HTML = """<html><body><nav id="top"><ul><li><a href="/a">A one</a></li><li><a href='b.html'>B &amp; b</a></li></ul></nav>
<!-- <a href="/hidden">x</a> --><script>var s="<a href='/no'>";</script>
<div class="box"><p>para <b>bold<p>second</div>
<table><tr><th>h1</th><th>h 2</th></tr><tr><td rowspan="2">x</td><td>y<table><tr><td>in</td></tr></table></td></tr><tr><td>z</td></tr></table>
</body></html>"""


def pages(spark):
    return spark.createDataFrame([(1, "http://s.org/dir/page", HTML)], "page_id bigint, url string, html string")


def test_links_and_containers(spark):
    p = pages(spark)
    lk = LK.extract_links(p).orderBy("pos").collect()
    assert [(r.href, r.dst_url, r.text) for r in lk] == [
        ("/a", "http://s.org/a", "A one"),
        ("b.html", "http://s.org/dir/b.html", "B & b"),
    ]
    t = PG.stored_tokens(p)
    el = PG.page_elements(t)
    inside = LK.links_in(p, el, t, attr_name="id", value="top").orderBy("pos").collect()
    assert [r.text for r in inside] == ["A one", "B & b"]
    kids = PG.container_children(el, "tag", "ul", ("li",)).orderBy("child_no").collect()
    assert [k.child_no for k in kids] == [1, 2]
    box = el.where(F.col("class") == "box").collect()
    assert len(box) == 1


def test_html_tables_and_rowspan(spark):
    g = PG.html_tables(pages(spark))
    rows = {(r.table_id, r.row_idx): r.cells for r in g.collect()}
    assert rows[(0, 0)] == ["h1", "h2"]
    assert rows[(0, 1)] == ["x", "yin"]
    assert rows[(0, 2)] == ["z"]
    assert (1, 0) not in rows  # a table in a cell is the cell's text
    filled = {(r.table_id, r.row_idx): r.cells for r in PG.fill_rowspan(g).collect()}
    assert filled[(0, 2)] == ["x", "z"]


def test_rowspan_edge_cases(spark):
    # two rowspans in one row, and a span longer than the remaining rows
    rows = [
        ("d", 0, 0, ["a", "b", "c"], [2, None, 5]),
        ("d", 0, 1, ["e"], [None]),
        ("d", 0, 2, ["f", "g"], [None, None]),
    ]
    g = spark.createDataFrame(rows, "doc string, table_id bigint, row_idx bigint, cells array<string>, rowspans array<int>")
    out = {r.row_idx: r.cells for r in PG.fill_rowspan(g).collect()}
    assert out[1] == ["a", "e", "c"]
    assert out[2] == ["f", "g", "c"]  # index 2 clamps to the row end


def test_neighbour_sibling(spark):
    html = "<ul><li><a href='/x'>Title one</a><span>2019-01-02</span></li><li><a href='/y'>Two</a><span>2020</span><span>x</span></li></ul>"
    p = spark.createDataFrame([(1, "http://s.org/", html)], "page_id bigint, url string, html string")
    t = PG.stored_tokens(p)
    el = PG.page_elements(t)
    anchors = el.where(F.col("tag") == "a").select("page_id", "start", "end")
    sib = sorted((r.start, r.neighbour) for r in LK.neighbour_text(anchors, el, t, "li", "span").collect())
    assert [n for _, n in sib] == ["2019-01-02", "2020"]
    par = sorted((r.start, r.neighbour) for r in LK.neighbour_text(anchors, el, t, "li").collect())
    assert [n for _, n in par] == ["Title one2019-01-02", "Two2020x"]


from hypothesis import given, settings
from hypothesis import strategies as st

CELL = st.text("abcXYZ019&<>#é", max_size=4)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.lists(CELL, min_size=1, max_size=4), min_size=1, max_size=5), min_size=1, max_size=3))
def test_html_tables_roundtrip_property(spark, tables):
    def esc(x):
        return x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    html = "<html><body>" + "".join(
        "<p>t</p><table>" + "".join("<tr>" + "".join(f"<td>{esc(c)}</td>" for c in row) + "</tr>" for row in t) + "</table>"
        for t in tables
    ) + "</body></html>"
    p = spark.createDataFrame([(7, "http://x/", html)], "page_id bigint, url string, html string")
    got = {(r.table_id, r.row_idx): list(r.cells) for r in PG.html_tables(p).collect()}
    want = {(t, r): row for t, tb in enumerate(tables) for r, row in enumerate(tb)}
    assert got == want


def _fill_model(rows):
    rows = [list(r) for r in rows]
    for ri in range(len(rows)):
        for ci, (text, span) in enumerate(list(rows[ri])):
            if span and span > 1:
                for k in range(1, span):
                    if ri + k >= len(rows):
                        break
                    rows[ri + k].insert(ci, (text, 0))
    return [[t for t, _ in r] for r in rows]


@settings(max_examples=12, deadline=None)
@given(
    st.lists(
        st.lists(st.tuples(st.text("abc01", min_size=1, max_size=3), st.sampled_from([None, None, 1, 2, 3, 5])), min_size=1, max_size=4),
        min_size=1,
        max_size=6,
    )
)
def test_rowspan_fill_property(spark, rows):
    def td(text, span):
        return f'<td rowspan="{span}">{text}</td>' if span is not None else f"<td>{text}</td>"

    html = "<table>" + "".join("<tr>" + "".join(td(t, s) for t, s in r) + "</tr>" for r in rows) + "</table>"
    p = spark.createDataFrame([(3, "http://x/", html)], "page_id bigint, url string, html string")
    got = {r.row_idx: list(r.cells) for r in PG.fill_rowspan(PG.html_tables(p)).collect()}
    want = _fill_model(rows)
    assert [got[i] for i in range(len(rows))] == want


from html.parser import HTMLParser
from urllib.parse import urljoin


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self._cur = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self._cur = [dict(attrs).get("href"), ""]

    def handle_endtag(self, tag):
        if tag == "a" and self._cur is not None:
            self.out.append(tuple(self._cur))
            self._cur = None

    def handle_data(self, data):
        if self._cur is not None:
            self._cur[1] += data


WORD = st.text("abcXY019é&<>", min_size=0, max_size=5)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["/p", "q.html", "../r", "", "?x=1"]), WORD, WORD), min_size=1, max_size=6))
def test_extract_links_matches_stdlib_parser(spark, anchors):
    def esc(x):
        return x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    body = "".join(f'<li><a href="{h}">{esc(t)}<b>{esc(u)}</b></a></li>' for h, t, u in anchors)
    html = f"<html><body><!-- <a href='/c'>no</a> --><ul>{body}</ul><script>var a='<a href=\"/s\">';</script></body></html>"
    base = "http://s.org/d/e"
    p = spark.createDataFrame([(1, base, html)], "page_id bigint, url string, html string")
    got = [(r.href, r.dst_url, r.text) for r in LK.extract_links(p).orderBy("pos").collect()]
    ref = _Anchors()
    ref.feed(html)
    want = [(h, urljoin(base, h) if h else base, t) for h, t in ref.out]
    assert got == want
