"""Element trees, whole-body cells and mapping at any depth, against recursive models."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import fuzzy, map_nested, texts_of
from gridweave.operators import deep, trees
from gridweave.operators import mapping as M
from gridweave.operators import pages as PG
from gridweave.sources.rules import rules_frame


def frame(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id bigint, html string")


def cells_of(spark, *htmls):
    out = [{} for _ in htmls]
    for r in trees.body_cells(frame(spark, *htmls)).collect():
        out[int(r.doc)][tuple(r.path)] = r.text
    return out


def nested(cells):
    """Cells back to nested lists."""
    if set(cells) == {()}:
        return cells[()]
    n = 1 + max(p[0] for p in cells)
    return [nested({p[1:]: t for p, t in cells.items() if p[0] == i}) for i in range(n)]


GOLDEN = [
    ("<body><nav><ul><li><a>A</a><li><a>B</a></ul></nav><div> ad </div></body>", [["A", "B"], "ad"]),
    ("<body><h1>T</h1><p><b>x<br><p>y<div>z</div></body>", ["T", "x", "y", "z"]),
    ("<table><tr><td>a<td>b<tr><td><i>c</i><b>d</b></table>", [["a", "b"], "cd"]),
    ("<table><tr><th><i>c</i><b>d</b><th>e<tr><td>1<td>2</table>", [[["c", "d"], "e"], ["1", "2"]]),
    ("<div>lead <p>x</p></div><p>y", ["leadx", "y"]),
    ("<p>only", "only"),
    ("<div></span></p><b>x</b></i><i>y</i></div><u>z", [["x", "y"], "z"]),
    ("<div><table><tr><td>in</div>side</td><td>b</td></tr></table></div><p>z", [["inside", "b"], "z"]),
    ("<table><tr><td rowspan=2>a<td rowspan='3'>b<td>c<tr><td>d<tr><td>e<td>f</table>", [["a", "b", "c"], ["a", "b", "d"], ["e", "b", "f"]]),
    ("<table><tr><td rowspan=2>a<td>b<tr><td rowspan=2>c<tr><td>d</table>", [["a", "b"], ["a", "c"], ["d", "c"]]),
    ("<html><head><title>t</title></head><body>\n<p>a</p>\n<p>&lt;b&#62;</p></body></html>", ["a", "<b>"]),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><dl><dt>k<dd>v<dt>l</dl>", [["abc", "d"], ["k", "v", "l"]]),
    ("<div><br/><hr></div><img>", [["", ""], ""]),
    ("<!DOCTYPE html><script>var x='<p>no</p>'</script><p>a<!-- <p>no --><p>b", ["a", "b"]),
]


def test_golden_pages(spark):
    got = cells_of(spark, *[h for h, _ in GOLDEN])
    for (html, want), cells in zip(GOLDEN, got):
        assert nested(cells) == want, html


def test_nothing_and_null(spark):
    assert cells_of(spark, "", None, "   ") == [{}, {}, {(): ""}]
    assert trees.page_tree(frame(spark, "", None)).collect() == []


class Stack(HTMLParser):
    """The rules of nesting once more, on the standard library's tokens: nodes are
    [tag, texts and nodes...]."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = ["body"]
        self.open = [self.root]
        self.feed(html)
        self.close()

    def up_to(self, tags, walls):
        """The outermost open element of ``tags`` that no wall hides."""
        found = None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in walls:
                break
            found = k if self.open[k][0] in tags else found
        return found

    def handle_starttag(self, tag, attrs):
        ended = {"li": ({"li"}, {"ul", "ol", "table", "td", "th"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "a": ({"a"}, {"table", "td", "th"})}
        tags, walls = ended.get(tag, ({"p"}, {"table", "td", "th"}) if tag in {"p", "div", "ul", "table"} else (set(), set()))
        if (k := self.up_to(tags, walls)) is not None:
            del self.open[k:]
        node = [tag]
        self.open[-1].append(node)
        if tag != "br":
            self.open.append(node)

    def handle_endtag(self, tag):
        rank = lambda t: {"p": 10, "div": 150, "td": 160, "th": 160, "tr": 170, "table": 190}.get(t, 100)
        higher = {n[0] for n in self.open if n[0] != tag and rank(n[0]) > rank(tag)}
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in higher:
                return

    def handle_data(self, data):
        self.open[-1].append(data)


def shape(node):
    """The leaf rule and the collapse, by recursion."""
    kids = [x for x in node[1:] if isinstance(x, list)]
    whole = lambda n: "".join(x if isinstance(x, str) else whole(x) for x in n[1:])
    lead = "".join(x for x in node[1 : 1 + next((i for i, x in enumerate(node[1:]) if isinstance(x, list)), len(node))] if isinstance(x, str))
    if not kids or lead.strip() or node[0] == "td":
        return whole(node).replace(" ", "")
    return shape(kids[0]) if len(kids) == 1 else [shape(k) for k in kids]


PIECE = st.sampled_from("<div> </div> <p> </p> <ul> <li> </li> </ul> <table> <tr> <td> <th> </td> </tr> </table> <a> </a> <b> </b> <br> t u".split() + [" ", "x "])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(PIECE, min_size=1, max_size=24), min_size=25, max_size=25))
def test_random_markup_against_a_stack(spark, pages):
    htmls = ["<p>s</p>" + "".join(p) for p in pages]
    for html, cells in zip(htmls, cells_of(spark, *htmls)):
        assert nested(cells) == shape(Stack(html).root), html


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(PIECE, min_size=1, max_size=30), min_size=20, max_size=20))
def test_tree_intervals_nest(spark, pages):
    rows = trees.page_tree(frame(spark, *["".join(p) for p in pages])).collect()
    by_page: dict = {}
    for r in rows:
        by_page.setdefault(r.page_id, {})[r.start] = r
    for nodes in by_page.values():
        for r in nodes.values():
            if r.parent >= 0:
                p = nodes[r.parent]
                assert p.start < r.start <= r.end <= p.end and r.level == p.level + 1
            kids = sorted((k.start, k.ordinal, k.end) for k in nodes.values() if k.parent == r.start)
            assert [o for _, o, _ in kids] == list(range(len(kids))) and all(a[2] < b[0] for a, b in zip(kids, kids[1:]))


@pytest.mark.parametrize("html", ["<" * 1_000_000, "<script>" * 130_000, "<!--" * 250_000, "<div><i></i>" * 80_000, "<td>" * 250_000, "<p>" * 300_000 + "x" * 100_000], ids=lambda h: h[:8])
def test_a_megabyte_of_broken_markup(spark, html):
    t = time.time()
    trees.body_cells(frame(spark, html)).count()
    PG.page_tokens(frame(spark, html)).count()
    assert time.time() - t < 30


def test_deeper_elements_belong_to_the_deepest(spark):
    html = "".join(f"<div><i>{k}</i>" for k in range(30))
    got = {tuple(r.path): r.text for r in trees.body_cells(frame(spark, html), max_depth=5).collect()}
    assert "".join(got.values()) == "".join(map(str, range(30))) and max(map(len, got)) <= 5


# ---- mapping

RULES = [("id", "id"), ("name", "name"), ("age", "age"), ("years", "age")]


def rules_of(spark, rules=RULES):
    return rules_frame(spark, "t", [(i, "attr", s, t, None) for i, (s, t) in enumerate(rules)])


def as_cells(spark, docs):
    rows = [(d, list(p), t) for d, data in docs.items() for p, t in texts_of(data)]
    return spark.createDataFrame(rows, "doc string, path array<bigint>, text string")


def mapped(spark, docs, rules=RULES):
    c, r = as_cells(spark, docs), rules_of(spark, rules)
    targets = list(dict.fromkeys(t for _, t in rules))
    got = sorted((x.doc, tuple(x.path), *[x[t] for t in targets]) for x in deep.map_cells(c, r, bucket_rows=2).collect())
    told = sorted((x.doc, tuple(x.path), x.description) for x in deep.describe_cells(c, r, bucket_rows=2).collect())
    return got, told


def model(docs, rules=RULES):
    targets = list(dict.fromkeys(t for _, t in rules))
    got, told = [], []
    for d, data in docs.items():
        records, texts = map_nested(data, rules)
        got += [(d, p, *[r[t] for t in targets]) for p, r in records]
        told += [(d, p, x) for p, x in texts]
    return sorted(got), sorted(told)


def test_nested_tables(spark):
    people = [["id", "name", "age"], ["1", ["a", ["n", "n"]], "3"], "end", "abc", ["id", "name", "years"], "xyz", ["2", "bo", "4"]]
    docs = {
        "two": ["t", people],
        "deep": ["a", ["b", ["c", people, "tail"]], [["h", "h"], people]],
        "in a row": [["id", "name", "age"], [["id", "name", "age"], ["7", "u", "8"]], ["1", "2", "3"], ["4", ["id", "name", "age"], "6"]],
        "list header": ["x", [["i", "d"], "name id", "name age"], ["1", "2", "3"]],
        "none": ["id", "name", "age"],
    }
    got = mapped(spark, docs)
    assert got == model(docs)
    assert ("two", (1, 1), "1", "ann", "3") in got[0] and ("two", (1, 5), "x", "y", "z") in got[0]


def test_equal_to_the_grid_operators_on_two_levels(spark):
    tables = [[["cap", ""], ["id", "name", "age"], ["1", "ann", "3"], ["2", "bob", "4"], ["id", "age"], ["3", "c"]], [["x", "name", "age", "id"], ["9", "z", "1", "8"]]]
    grid = spark.createDataFrame([("d", t, r, c) for t, rows in enumerate(tables) for r, c in enumerate(rows)], "doc string, table_id bigint, row_idx bigint, cells array<string>")
    want = sorted((r.table_id, r.row_idx, r.id, r.name, r.age) for r in M.map_records(grid, rules_of(spark)).collect())
    assert [(*p, *v) for _, p, *v in mapped(spark, {"d": tables})[0]] == want and want


WORD = st.sampled_from(["id", "name", "age", "years", "x", "ab", "xyz", "", "nameage"])
DATA = st.recursive(WORD, lambda inner: st.lists(inner, min_size=1, max_size=4), max_leaves=25)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(DATA, min_size=1, max_size=6), min_size=6, max_size=6))
def test_mapping_against_recursion(spark, docs):
    docs = {f"d{i}": d for i, d in enumerate(docs)}
    assert mapped(spark, docs) == model(docs)


def test_page_to_records(spark):
    """A page's own layout, not cut to its tables: T5, T6, T7 and M1-M5 in one go."""
    html = "<h1>People</h1><div><table><tr><th>id<th>name<th>age<tr><td rowspan=2>1<td>ann<td>3<tr><td><b>b</b><i>ob</i><td>4</table></div>"
    cells = trees.body_cells(frame(spark, html))
    got = sorted((tuple(r.path), r.id, r.name, r.age) for r in deep.map_cells(cells, rules_of(spark)).collect())
    assert got == [((1, 1), "1", "ann", "3"), ((1, 2), "1", "bob", "4")]


def test_many_labels(spark):
    rules = [(f"key{i}", f"t{i % 5}") for i in range(80)] + RULES
    docs = {"d": ["x", [["id", "name", "key7", "age"], ["1", "2", "3", "4"]]]}
    assert mapped(spark, docs, rules) == model(docs, rules)


def test_cells_with_gaps_and_nulls(spark):
    rows = [("d", [0, 0, 0], "id"), ("d", [0, 0, 2], "name"), ("d", [0, 1, 0], None), ("d", [0, 1, 2], "v"), ("d", None, "x"), (None, [0, 0, 0], "id")]
    c = spark.createDataFrame(rows, "doc string, path array<int>, text string")
    got = deep.map_cells(c, rules_of(spark, RULES[:2])).collect()
    assert [(r.doc, r.path, r.id, r.name) for r in got] == [("d", [0, 1], "", "v")]
    assert deep.map_cells(c.limit(0), rules_of(spark)).collect() == []


def test_closed_form():
    assert [fuzzy("aab", "ba"), fuzzy("ba", "ab"), fuzzy("ba", "aa"), fuzzy("a", ""), fuzzy("", "a"), fuzzy(None, "a")] == [True, False, True, True, False, False]
