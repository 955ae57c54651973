"""String predicates and extractors as plain Column expressions.

Everything here compiles to Catalyst expressions; nothing runs in Python per row.
Higher-order functions (``forall``/``transform``) are interpreted rather than
code-generated, so callers pre-filter with cheap length checks where it matters.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed by the cleaning rule (T4), in this order:
# line feed, tab, carriage return, no-break space U+00A0, ideographic space U+3000, space.
CLEAN_CHARS = "\n\t\r\u00a0\u3000 "

#: Named character references of HTML 4 (the standard library's list) and ``apos``, as
#: ``;name=c;name=c...``: looked up by position, one short literal in a plan.
_NAMED = "".join(f";{n}={chr(c)}" for n, c in sorted({**name2codepoint, "apos": 39}.items()))
#: What the numbers 128 to 159 stand for: Windows-1252, by its codec.
_WINDOWS = "".join(bytes([n]).decode("cp1252", "replace") for n in range(128, 160))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fuzzy_match(s, r) -> Column:
    """Loose label match (X1): ``r`` matches ``s`` when ``len(r) <= len(s)`` and for
    every position ``i`` the character ``r[i]`` occurs somewhere in ``s[i:]``.

    Null on either side is false; the empty label matches any non-null string.
    """
    s, r = _c(s), _c(r)
    return (
        F.when(s.isNull() | r.isNull() | (F.length(r) > F.length(s)), F.lit(False))
        .when(F.length(r) == 0, F.lit(True))
        .otherwise(
            F.forall(
                F.sequence(F.lit(1), F.length(r)),
                lambda i: F.instr(F.substr(s, i), F.substr(r, i, F.lit(1))) > 0,
            )
        )
    )


def _java_literal(ch: str) -> str:
    if ch.isascii() and not ch.isalnum():
        return "\\" + ch if ch not in "\n\r\t" else {"\n": "\\n", "\r": "\\r", "\t": "\\t"}[ch]
    return ch


def fuzzy_pattern(label: str) -> str:
    """Java regex equivalent to ``fuzzy_match(s, label)`` for a literal label: one
    look-ahead per label position ``i`` requiring ``label[i]`` at or after ``i``.
    The last look-ahead also enforces ``len(label) <= len(s)``."""
    parts = [f"(?=.{{{i}}}.*{_java_literal(ch)})" for i, ch in enumerate(label)]
    return "(?s)^" + "".join(parts)


def fuzzy_match_literal(s, label: str) -> Column:
    """X1 against a literal label, compiled to one regex (code-generated, no lambda)."""
    s = _c(s)
    return F.coalesce((F.length(s) >= F.lit(len(label))) & s.rlike(fuzzy_pattern(label)), F.lit(False))


def clean_text(c) -> Column:
    """T4: delete LF, TAB, CR, U+00A0, U+3000 and every space."""
    return F.translate(_c(c), CLEAN_CHARS, "")


# A reference: a number, or a name with its semicolon, or a name that ends a word.
_REFERENCE = r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[a-zA-Z][a-zA-Z0-9]*;?)"


def _reference(x: Column) -> Column:
    bare = F.rtrim(F.substr(x, F.lit(2)), F.lit(";"))
    number = F.when(bare.rlike("^#[xX]"), F.conv(F.substr(bare, F.lit(3)), 16, 10)).otherwise(F.substr(bare, F.lit(2))).try_cast("bigint")
    char = (
        F.when(number.between(128, 159), F.substr(F.lit(_WINDOWS), number.cast("int") - 127, F.lit(1)))
        .when((number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    )
    at = F.instr(F.lit(_NAMED), F.concat(F.lit(";"), bare, F.lit("=")))
    named = F.when(at > 0, F.substr(F.lit(_NAMED), at + F.length(bare) + 2, F.lit(1))).otherwise(x)
    return F.when(x.startswith("&#"), char).otherwise(named)


def decode_references(c) -> Column:
    """HTML character references decoded: decimal and hexadecimal numbers, and the named
    ones of HTML 4. What is none (an unknown name, a lone ``&``) stays as it is. Give a
    column rather than an expression: it is used more than once."""
    c = _c(c)
    parts = F.regexp_extract_all(c, F.lit(f"({_REFERENCE}|[^&]+|&)"), 1)
    one = lambda x: F.when(x.rlike(f"^{_REFERENCE}$"), _reference(x)).otherwise(x)
    return F.when(c.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(c)


def strip_tags(c) -> Column:
    """``c`` without its tags, in time linear in its length: after the last ``>`` there is no
    tag, and no ``<`` there is tried as one. Give a column rather than an expression."""
    c = _c(c)
    tail = F.substring_index(c, ">", -1)
    tags = lambda x: F.regexp_replace(x, r"<[^>]*>", "")
    return F.when(tail.contains("<"), F.concat(tags(F.substr(c, F.lit(1), F.length(c) - F.length(tail))), tail)).otherwise(tags(c))


def node_text(c) -> Column:
    """All text under an element: drop tags, decode character references."""
    return decode_references(strip_tags(c))


def attr(tag_token, name: str) -> Column:
    """Value of attribute ``name`` in an opening-tag token, references decoded; null
    when absent."""
    tok = _c(tag_token)
    pat = r"""(?i)\s""" + name + r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    val = F.concat(
        F.regexp_extract(tok, pat, 1), F.regexp_extract(tok, pat, 2), F.regexp_extract(tok, pat, 3)
    )
    return F.when(tok.rlike(pat), decode_references(val))


def matches(c, regex: str) -> Column:
    """Regex search as a predicate (null-safe: null text never matches)."""
    return F.coalesce(_c(c).rlike(regex), F.lit(False))


def not_matches(c, regex: str) -> Column:
    """Drop-if-matched predicate; null text is kept."""
    return ~matches(c, regex)


def extract(c, regex: str, group: int = 0) -> Column:
    """First match of ``regex`` (whole match or ``group``), null when nothing matches.

    An empty capture of a successful match stays ``''``; Java regex, so look-around works.
    """
    c = _c(c)
    return F.when(c.rlike(regex), F.regexp_extract(c, regex, group))


def extract_many(df, source, patterns: dict[str, tuple[str, int] | str]):
    """Several named captures of one text column in one projection."""
    cols = {}
    for name, spec in patterns.items():
        regex, group = (spec, 0) if isinstance(spec, str) else spec
        cols[name] = extract(source, regex, group)
    return df.withColumns(cols)


def is_digits(c) -> Column:
    """All-ASCII-digit test (``'1.0'`` and ``''`` fail)."""
    return F.coalesce(_c(c).rlike("^[0-9]+$"), F.lit(False))


def to_int(c) -> Column:
    """Digits to BIGINT, null for anything else."""
    c = _c(c)
    return F.when(is_digits(c), c.try_cast("bigint"))


def prefix(c, pre: str) -> Column:
    """Constant prefix."""
    return F.concat(F.lit(pre), _c(c))


def append_if(c, other, only_if_nonempty: bool = False) -> Column:
    """``c`` with ``other`` appended when ``other`` is present.

    The observed behaviour appends even an empty ``other``; ``only_if_nonempty``
    switches to the evidently intended guard.
    """
    c, other = _c(c), _c(other)
    guard = other.isNotNull()
    if only_if_nonempty:
        guard = guard & (F.length(other) > 0)
    return F.when(guard, F.concat(c, other)).otherwise(c)


def join_nested(c, sep: str = "") -> Column:
    """Flatten an ARRAY<ARRAY<STRING>> (or ARRAY<STRING>) into one string."""
    return F.array_join(F.flatten(_c(c)), sep)


def distinct_ordered(c) -> Column:
    """Order-preserving distinct of an array (first occurrence kept)."""
    return F.array_distinct(_c(c))
