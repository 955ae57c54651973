"""URL expressions (X10, X11, S8), all native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters `quote` leaves alone: letters, digits, `_.-~` and the
# configured safe set `;/?:@&=+$,`.
QUOTE_SAFE_CLASS = r"[A-Za-z0-9_.~;/?:@&=+$,\-]"

# scheme(1) ':' '//' authority(3) path(4) query(5) fragment(6)
URL_RE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def postfix(url) -> Column:
    """Text after the last '.', '' when there is none (query not stripped)."""
    return F.regexp_extract(F.coalesce(_c(url), F.lit("")), r"\.([^.]*)$", 1)


def base_name(path) -> Column:
    """Last path part without its postfix."""
    name = F.substring_index(F.coalesce(_c(path), F.lit("")), "/", -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def quote_url(c) -> Column:
    """X11: percent-encode UTF-8 bytes of every character outside the safe set."""
    chars = F.regexp_extract_all(_c(c), F.lit("(?s)(.)"), 1)
    enc = F.transform(
        chars,
        lambda ch: F.when(ch.rlike("^" + QUOTE_SAFE_CLASS + "$"), ch).otherwise(
            F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")
        ),
    )
    return F.when(_c(c).isNotNull(), F.array_join(enc, ""))


def _remove_dots(path: Column, relative: Column) -> Column:
    """Drop empty middle segments (relative references only) and resolve ``.``/``..``.

    The segment stack (an ``aggregate`` lambda, which is interpreted) only runs for
    the rare paths that contain dot segments; every other path is one regex.
    """
    squeezed = F.when(relative, F.regexp_replace(path, "/{2,}", "/")).otherwise(path)
    segs = F.split(squeezed, "/")
    stack = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        )
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    stack = F.when(squeezed.rlike(r"/\.\.?$"), F.concat(stack, F.array(F.lit("")))).otherwise(stack)
    joined = F.array_join(stack, "/")
    resolved = F.when(joined == "", F.lit("/")).when(joined.startswith("/"), joined).otherwise(
        F.concat(F.lit("/"), joined)
    )
    return F.when(squeezed.rlike(r"(^|/)\.\.?(/|$)"), resolved).otherwise(squeezed)


def resolve_url(base, href) -> Column:
    """Resolve ``href`` against the page URL ``base`` (urljoin rules); a null or
    empty ``href`` gives the page URL itself."""
    base, raw = _c(base), _c(href)
    # "//" followed by no authority is not a network-path reference: what follows is a
    # path, query or fragment on the base's own host ("//" alone keeps the base minus
    # its fragment).
    no_auth = raw.rlike(r"^//([/?#]|$)")
    href = F.when(no_auth, F.substr(raw, F.lit(3))).otherwise(raw)
    scheme = F.regexp_extract(base, URL_RE, 1)
    auth = F.regexp_extract(base, URL_RE, 2)
    bpath = F.regexp_extract(base, URL_RE, 4)
    root = F.concat(scheme, F.lit(":"), auth)
    hpath = F.regexp_extract(href, r"^([^?#]*)", 1)
    hrest = F.substr(href, F.length(hpath) + 1)
    bdir = F.regexp_replace(bpath, r"[^/]*$", "")
    merged = F.when(hpath.startswith("/"), hpath).otherwise(
        F.concat(F.when(bdir == "", F.lit("/")).otherwise(bdir), hpath)
    )
    path = _remove_dots(merged, ~hpath.startswith("/"))
    return (
        F.when(raw.isNull() | (raw == ""), base)
        .when(no_auth & (href == ""), F.regexp_replace(base, "#.*$", ""))
        .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
        .when(raw.rlike(r"^//[^/?#]"), F.concat(scheme, F.lit(":"), raw))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(root, bpath, href))
        .otherwise(F.concat(root, path, hrest))
    )
