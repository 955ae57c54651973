"""Selectors of links by their place in the page: the usual shapes of element paths.

A link's place is its path from the root: for every element around it, and then itself,
``/tag{id}{class}{place}{last}``, where place counts the siblings of its tag from 1 and last is ``l`` for
the last of them. A selector becomes one regular expression over that path, and conditions on
the link's text. It has steps by ``/`` or ``//``, a tag or ``*``, and any number of tests:

* ``[@id='..']``, ``[@class='..']``, ``[contains(@class, '..')]``, ``[starts-with(@id, '..')]``;
* ``[2]``, ``[position()=2]``, ``[last()]`` on a tag, before its other tests (after them it would count
  only what passes them);
* ``[text()='..']``, ``[contains(text(), '..')]``, ``[contains(., '..')]`` on the last step;
* several of them joined by ``and``.

Other expressions are refused: there is no general path evaluator.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.text import attr, decode_references
from gridweave.functions.urls import quote_url, resolve_url
from gridweave.operators.trees import PLAIN, placed

_QUOTED = r"""('[^']*'|"[^"]*")"""
_STEP = re.compile(r"(//?)([A-Za-z][A-Za-z0-9]*|\*)")
_TEST = re.compile(
    rf"\s*(?:@(id|class)\s*=\s*{_QUOTED}|(contains|starts-with)\(\s*@(id|class)\s*,\s*{_QUOTED}\s*\)"
    rf"|(?:position\(\)\s*=\s*)?(\d+)|(last\(\))|(?:text\(\)|\.)\s*=\s*{_QUOTED}|contains\(\s*(?:text\(\)|\.)\s*,\s*{_QUOTED}\s*\))\s*"
)
_ANY = "[^{}/]*"


def _literal(quoted: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", quoted[1:-1].translate(PLAIN))


def parts_of(selector: str) -> tuple[str, list[tuple[str, str]]]:
    """(the regular expression of the paths, the conditions on the text: ('is' or 'has', text))."""
    text, at, out, said = selector.strip(), 0, "^", []

    def refuse():
        raise ValueError(f"selector not supported: {selector!r}")

    while at < len(text) or out == "^":
        m = _STEP.match(text, at)
        if not m or said:  # a text is tested on the last step only
            refuse()
        axis, tag = m.groups()
        at = m.end()
        want = {"id": [], "class": []}
        place, last = r"\d+", "l?"
        tested = False
        while text[at : at + 1] == "[":
            at += 1
            while True:
                t = _TEST.match(text, at)
                if not t:
                    refuse()
                name, equal, how, of, part, number, final, is_, has = t.groups()
                at = t.end()
                if name:
                    want[name].append(_literal(equal))
                elif how:
                    want[of].append((_ANY if how == "contains" else "") + _literal(part) + _ANY)
                elif number or final:
                    if tag == "*" or tested:
                        refuse()
                    place, last = (number.lstrip("0") or "0", last) if number else (place, "l")
                else:
                    said.append(("is", is_[1:-1]) if is_ else ("has", has[1:-1]))
                tested = tested or not (number or final)
                if text.startswith("and ", at):
                    at += 4
                elif text[at : at + 1] == "]":
                    at += 1
                    break
                else:
                    refuse()
        # every test of an attribute looks ahead at it
        field = lambda k: "".join(rf"(?={x}\}})" for x in want[k]) + _ANY
        out += ("(?:/[^/]*)*" if axis == "//" else "") + "/" + (r"[a-z0-9]+" if tag == "*" else tag.lower())
        out += rf"\{{{field('id')}\}}\{{{field('class')}\}}\{{{place}\}}\{{{last}\}}"
    return out + "$", said


def path_pattern(selector: str) -> str:
    """The regular expression of the paths that a selector chooses."""
    return parts_of(selector)[0]


def matches_path(path: Column, selector: str, text: Column | None = None) -> Column:
    pattern, said = parts_of(selector)
    if said and text is None:
        raise ValueError(f"selector tests a text that is not at hand: {selector!r}")
    ok = path.rlike(pattern)
    for how, value in said:
        ok = ok & (text == value if how == "is" else text.contains(value))
    return F.coalesce(ok, F.lit(False))


def placed_links(pages: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Links with their places: page_id, src_url, pos, href, dst_url (resolved and quoted),
    text, path. Anchors without ``href`` are no links. One pass over the pages, no join and no
    shuffle (``tokens`` are not needed any more)."""
    rows = placed(pages.select("page_id", F.col("url").alias("src_url"), "html"), "a")
    rows = rows.select("page_id", "src_url", "pos", attr("tok", "href").alias("href"), "raw", "path").where(F.col("href").isNotNull())
    rows = rows.withColumn("to", resolve_url(F.col("src_url"), F.col("href")))
    return rows.select("page_id", "src_url", "pos", "href", quote_url("to").alias("dst_url"), decode_references("raw").alias("text"), "path")
