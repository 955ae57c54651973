"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Kinds ``email``, ``ip``, ``card`` and ``phone`` follow fixed patterns (leftmost, not
overlapping within a kind; a match that fails its check is dropped without another try) and
are always kept. Two more kinds need more evidence: ``iban`` (shape, cut to its country's
length, check digits by mod-97) and ``ssn`` (shape, ranges never issued left out); they are
kept only where score and context words reach ``MIN_SCORE``.

A span's score starts at its kind's prior, rises when a checksum confirms it and moves by
context words within ``CONTEXT`` characters on either side. All patterns scan in linear
time, so one very long token cannot stall a task; whole texts are searched.

Defined results: a null or empty text has no spans; offsets are code points, end exclusive;
rows are independent, so repeated rows give repeated results; all columns of the input stay.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import text_or_empty

# Kinds in their order of listing.
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + EXTRA_KINDS

PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "ssn": 0.3}
CHECKED = {"card": 0.3, "iban": 0.4}  # added when the checksum holds
CONTEXT = 40
CONTEXT_UP, CONTEXT_DOWN, MIN_SCORE = 0.3, 0.3, 0.6
# Words that speak for a kind, and words that speak against any.
FOR = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "iban": ("iban", "bank", "account", "transfer", "konto"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = ("version", "example", "sample", "isbn", "order", "serial")

_LEFT = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run either starts a match or none of its later digits does: so anchoring at the
# run's start finds the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
# Lengths of countries' numbers. A code without one takes all that fits _IBAN.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_OF = {c: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n, cs in _IBAN_LENGTHS.items() for c in cs.split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[a-z]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LEFT:
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            yield left, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str):
    at = 0
    while head := _IBAN_HEAD.search(text, at):
        at = head.end()
        m = _IBAN_OF.get(head[0][:2], _IBAN).match(text, head.start())
        if m and mod97(m[0]):
            yield m.span()
            at = m.end()


def _ssns(text: str):
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


_FINDERS = (("email", _emails), ("ip", _ips), ("card", _cards), ("phone", _phones), ("iban", _ibans), ("ssn", _ssns))


def span_score(text: str, kind: str, start: int, end: int) -> float:
    near = set(_WORD.findall((text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower()))
    up = CONTEXT_UP if near.intersection(FOR[kind]) else 0.0
    down = CONTEXT_DOWN if near.intersection(AGAINST) else 0.0
    return min(1.0, max(0.0, PRIOR[kind] + CHECKED.get(kind, 0.0) + up - down))


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """All kept spans of a text, by kind as listed, then start."""
    at, digit = "@" in text, _DIGIT.search(text) is not None
    if not at and not digit:
        return []
    out = []
    for kind, finder in _FINDERS:
        if at if kind == "email" else digit:
            for s, e in finder(text):
                score = span_score(text, kind, s, e)
                if kind in BASE_KINDS or score >= MIN_SCORE:
                    out.append((kind, s, e, score))
    return out


def mask(text: str) -> str:
    """The text with every found span replaced by its kind in brackets; of spans that
    overlap, the one that starts first (then the longer) names the union."""
    spans = sorted(find_spans(text), key=lambda x: (x[1], -x[2]))
    out, done, k = [], 0, 0
    while k < len(spans):
        kind, s, e, _ = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < e:
            e = max(e, spans[k][2])
            k += 1
        out += [text[done:s], "[", kind.upper(), "]"]
        done = e
    return "".join(out) + text[done:] if out else text


SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _spans(texts: pa.Array) -> pa.Array:
    names = ("kind", "start", "end", "score")
    return pa.array([[dict(zip(names, s)) for s in find_spans(t)] for t in texts.to_pylist()], _ARROW)


def _masked(texts: pa.Array) -> pa.Array:
    return pa.array([mask(t) for t in texts.to_pylist()], pa.string())


def find_pii(docs: DataFrame, out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: the kept spans (kind, start, end, score)."""
    return docs.withColumn(out, F.arrow_udf(_spans, SPAN)(text_or_empty()))


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span masked in ``text``; a null text stays null. ``n_chars``,
    where there is one, follows the new text."""
    masked = docs.withColumn("text", F.when(F.col("text").isNotNull(), F.arrow_udf(_masked, "string")(text_or_empty())))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, digest of the base spans and all spans as text."""
    found = find_pii(docs.select("doc_id", "text"), "__p")
    p = F.col("__p")
    return found.select(
        "doc_id",
        *[_count(p, k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(F.filter(p, lambda s: s["kind"].isin(*BASE_KINDS))).cast("binary"), 256).alias("base_sha256"),
        _joined(p).alias("spans"),
    )
