"""Column-level helpers (no Python UDFs)."""

from gridweave.functions.text import (  # noqa: F401
    append_if,
    attr,
    clean_text,
    distinct_ordered,
    extract,
    extract_many,
    fuzzy_match,
    fuzzy_match_literal,
    is_digits,
    join_nested,
    matches,
    node_text,
    not_matches,
    prefix,
    to_int,
)
from gridweave.functions.urls import base_name, postfix, quote_url, resolve_url  # noqa: F401
