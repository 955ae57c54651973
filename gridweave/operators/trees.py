"""Whole pages as nested data (T5, T6, T7): the element tree of a page, and its leaves as cells.

A page is one row. Its tokens come from the JVM's regular expressions; the one step that has to
walk them in order, which element is open where, is a small Arrow function, so a page never
leaves its task and nothing is shuffled. What it yields per page is the tree's nodes, or the
leaves of the body with their paths; texts are decoded and cleaned by the JVM again.

Elements nest by a stack. A closing tag ends the nearest open element of its name and all
inside it, unless an element that outranks it lies between (a ``</div>`` inside a cell does not
end the ``div`` around the table); one that ends nothing counts for nothing. Some opening tags end
open elements first: a list item ends the item before it, a row the row, a cell the cell, a block
the paragraph, an anchor the anchor. What is never closed ends with the element around it.
Elements deeper than ``max_depth`` are part of the one at that depth, their text included.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.text import attr, clean_text, node_text
from gridweave.operators.pages import VOID_TAGS, tokens_of
from gridweave.session import ship

# How strongly an open element holds against closing tags of other names; a
# closing tag does not reach past an element of a higher rank than its own. Others: 100.
RANK = {"p": 10, "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}
# Opening tag -> the open elements it ends, and those it does not look past.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "table", "td", "th")),
    "dt": (("dt", "dd"), ("dl", "table", "td", "th")),
    "dd": (("dt", "dd"), ("dl", "table", "td", "th")),
    "option": (("option",), ("select", "datalist")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "tr"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr"), ("table",)),
    "a": (("a",), ("table", "td", "th")),
}
# Blocks, which end an open paragraph.
BLOCKS = (
    "address article aside blockquote center details dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul"
).split()
for _b in BLOCKS:
    ENDS[_b] = (("p",), ("table", "td", "th", "button", "caption"))
# Children of the root that belong to a page's head, not to its body.
HEAD_TAGS = ("head", "title", "meta", "link", "base", "style", "script")

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_SPAN = re.compile(r"""\srowspan\s*=\s*["']?\s*(\d{1,6})""", re.I)


@dataclass(eq=False, slots=True)
class Node:
    tag: str
    start: int  # its opening token
    end: int = -1  # its last token
    span: int = 0
    lead: bool = False  # has text of its own before its first child
    children: list[Node] = field(default_factory=list)
    frame: list[tuple[str, int]] = field(default_factory=list)  # of the root: html and body tags


def nest(toks: list[str], max_depth: int = 256) -> Node:
    """The tree of a page's tokens under a root for the body."""
    root = Node("body", -1, len(toks) - 1)
    stack = [root]

    def close(at: int, last: int) -> None:
        for n in stack[at:]:
            n.end = last
        del stack[at:]

    for i, tok in enumerate(toks):
        if tok[0] != "<":
            top = stack[-1]
            if not top.children and not tok.isspace():
                top.lead = True
            continue
        m = _TAG.match(tok)
        if not m:
            continue
        name = m[2].lower()
        if name in ("html", "body"):
            if not m[1] and name not in dict(root.frame):
                root.frame.append((name, i))
            if name == "body" and not m[1] and len(stack) == 1:  # what stood before was no part of it
                root.children, root.lead = [], False
            continue
        if m[1]:
            rank = RANK.get(name, 100)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    close(k, i)
                    break
                if RANK.get(stack[k].tag, 100) > rank:
                    break
            continue
        ends, bars = ENDS.get(name, ((), ()))
        if ends:
            last = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bars:
                    break
                if stack[k].tag in ends:
                    last = k
            if last:
                close(last, i - 1)
        if len(stack) > max_depth:
            continue
        span = _SPAN.search(tok) if "owspan" in tok or "OWSPAN" in tok else None
        node = Node(name, i, i, int(span[1]) if span else 0)
        stack[-1].children.append(node)
        if name not in VOID_TAGS and not tok.endswith("/>"):
            stack.append(node)
    close(1, len(toks) - 1)
    root.children = [c for c in root.children if c.tag not in HEAD_TAGS]
    return root


def spread_spans(root: Node) -> None:
    """T6 on the tree: an element with ``rowspan = n`` is put into the next ``n - 1`` siblings of
    its parent as well, at its own place among the children (at the end of shorter ones)."""
    todo = [(root, None, 0)]
    while todo:
        node, up, own = todo.pop()  # the parent's siblings (itself included) and its place there
        if up is not None:
            at = 0
            while at < len(node.children):
                child = node.children[at]
                for row in up[own + 1 : own + child.span]:
                    row.children.insert(at, child)
                child.span = 0
                at += 1
        kids = node.children
        todo.extend((k, kids, i) for i, k in reversed(list(enumerate(kids))))


def leaves(root: Node) -> Iterator[tuple[list[int], Node]]:
    """(path, node) of every leaf of the body in order. A leaf is a node without children, with
    text of its own before them, or a ``td``; a node with one child stands for that child and
    adds nothing to the path."""
    todo = [([], root)]
    while todo:
        path, node = todo.pop()
        while len(node.children) == 1 and not node.lead and node.tag != "td":
            node = node.children[0]
        if not node.children or node.lead or node.tag == "td":
            yield path, node
        else:
            todo.extend((path + [i], c) for i, c in reversed(list(enumerate(node.children))))


def _cells_column(max_depth: int):
    def cells(pages: pa.Array) -> pa.Array:
        out = []
        for page in pages:
            toks = page.as_py()
            if not toks:
                out.append([])
                continue
            root = nest(toks, max_depth)
            spread_spans(root)
            out.append([(p, "".join(t for t in toks[max(n.start, 0) : n.end + 1] if t[0] != "<")) for p, n in leaves(root)])
        cell = pa.struct([("path", pa.list_(pa.int64())), ("raw", pa.string())])
        return pa.array([[{"path": p, "raw": r} for p, r in rows] for rows in out], pa.list_(cell))

    return F.arrow_udf(cells, "array<struct<path:array<bigint>,raw:string>>")


def body_cells(pages: DataFrame, max_depth: int = 256) -> DataFrame:
    """The whole body of every page as path-addressed cells ``(doc, path, text)``.

    Lists, blocks and tables alike are nested lists of texts: a path has an index for every
    element with several children. ``rowspan`` is filled first (T6). Texts are those of all
    below the leaf, references decoded, cleaned. A body that is one leaf has the empty path;
    a null or empty page has no cells."""
    ship(pages.sparkSession)
    toks = pages.select(F.col("page_id").cast("string").alias("doc"), tokens_of("html").alias("toks"))
    rows = toks.select("doc", F.explode(_cells_column(max_depth)("toks")).alias("c"))
    return rows.select("doc", F.col("c.path").alias("path"), F.col("c.raw").alias("raw")).select("doc", "path", clean_text(node_text("raw")).alias("text"))


_VALUE = {n: re.compile(rf"""\s{n}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I) for n in ("id", "class")}
#: Signs that paths are made of stand for themselves nowhere else.
PLAIN = str.maketrans("/{}", "\x01\x02\x03")


def _step(tag: str, tok: str, place: int, last: bool) -> str:
    """One element of a path: its tag, id, class, place among siblings of its tag, ``l`` for the last."""
    found = [m and next(g for g in m.groups() if g is not None) for m in (_VALUE[n].search(tok) for n in ("id", "class"))]
    own = [html.unescape(v or "").translate(PLAIN) for v in found]
    return f"/{tag}{{{own[0]}}}{{{own[1]}}}{{{place}}}{{{'l' if last else ''}}}"


def _paths_column(tag: str, max_depth: int):
    def paths(pages: pa.Array) -> pa.Array:
        out = []
        for page in pages:
            toks, rows = page.as_py(), []
            root = nest(toks, max_depth) if toks else Node("body", -1)
            todo = [(root, "".join(_step(n, toks[i], 1, True) for n, i in root.frame))]
            while todo:
                node, above = todo.pop()
                if node.tag == tag and node is not root:
                    rows.append({"pos": node.start, "tok": toks[node.start], "raw": "".join(t for t in toks[node.start : node.end + 1] if t[0] != "<"), "path": above})
                of: dict[str, int] = {}
                many = Counter(c.tag for c in node.children)
                for c in node.children:
                    of[c.tag] = of.get(c.tag, 0) + 1
                    todo.append((c, above + _step(c.tag, toks[c.start], of[c.tag], of[c.tag] == many[c.tag])))
            out.append(rows)
        kind = pa.struct([("pos", pa.int64()), ("tok", pa.string()), ("raw", pa.string()), ("path", pa.string())])
        return pa.array(out, pa.list_(kind))

    return F.arrow_udf(paths, "array<struct<pos:bigint,tok:string,raw:string,path:string>>")


def placed(pages: DataFrame, tag: str, max_depth: int = 256) -> DataFrame:
    """Elements of one tag with their places: the columns of ``pages`` but ``html``, and pos (the
    opening token), tok, raw (the text inside, references as written), path (a step for every
    element around it and for itself, see :mod:`selectors`)."""
    ship(pages.sparkSession)
    rest = [c for c in pages.columns if c != "html"]
    toks = pages.select(*rest, tokens_of("html").alias("__toks"))
    return toks.select(*rest, F.explode(_paths_column(tag, max_depth)("__toks")).alias("__e")).select(*rest, "__e.*")


def _nodes_column(max_depth: int):
    names = ("start", "end", "parent", "level", "ordinal", "tag", "tok")

    def nodes(pages: pa.Array) -> pa.Array:
        out = []
        for page in pages:
            toks, rows = page.as_py(), []
            todo = [(c, -1, 1, i) for i, c in enumerate(nest(toks, max_depth).children)] if toks else []
            while todo:
                n, parent, level, place = todo.pop()
                rows.append(dict(zip(names, (n.start, n.end, parent, level, place, n.tag, toks[n.start]))))
                todo.extend((c, n.start, level + 1, i) for i, c in enumerate(n.children))
            out.append(rows)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
        return pa.array(out, pa.list_(pa.struct(list(zip(names, kinds)))))

    return F.arrow_udf(nodes, "array<struct<start:bigint,end:bigint,parent:bigint,level:int,ordinal:int,tag:string,tok:string>>")


def page_tree(pages: DataFrame, max_depth: int = 256) -> DataFrame:
    """The body's elements as a tree: page_id, start, end, parent (the ``start`` of the element
    around it, -1 at the top), level (1 at the top), ordinal (0-based place among the parent's
    children), tag, id, class, tok. Intervals nest: an element holds another when its
    interval holds the other's."""
    ship(pages.sparkSession)
    toks = pages.select("page_id", tokens_of("html").alias("toks"))
    flat = toks.select("page_id", F.explode(_nodes_column(max_depth)("toks")).alias("n")).select("page_id", "n.*")
    return flat.select("page_id", "start", "end", "parent", "level", "ordinal", "tag", attr("tok", "id").alias("id"), attr("tok", "class").alias("class"), "tok")
