"""The scalar helpers as SQL functions.

Their bodies are the very Column expressions, printed as SQL: temporary functions with a SQL body,
which the optimiser inlines, so a query through ``spark.sql`` has the plan of the Column form and
no Python in it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridweave.functions import text, urls

#: name -> (parameters, result, the Column form)
FUNCTIONS: dict[str, tuple[tuple[str, ...], str, Callable[..., Column]]] = {
    "label_match": (("s", "r"), "BOOLEAN", text.fuzzy_match),
    "clean_text": (("s",), "STRING", text.clean_text),
    "node_text": (("s",), "STRING", text.node_text),
    "resolve_url": (("base", "href"), "STRING", urls.resolve_url),
    "quote_url": (("s",), "STRING", urls.quote_url),
    "url_postfix": (("s",), "STRING", urls.postfix),
    "url_base_name": (("s",), "STRING", urls.base_name),
}

_LITERAL = re.compile(r"('(?:[^'\\]|\\.)*')", re.S)
# a function called by the name of an operator or of a keyword must be quoted
_OPERATOR = re.compile(r"(?<![\w`])(and|or|not|case|if|div|mod|[=<>!+*/%&|^~-]+)\(")


def sql_text(expression: Column) -> str:
    """A Column of plain names, functions and literals as SQL."""
    parts = _LITERAL.split(expression._jc.node().sql())
    return "".join(p if i % 2 else _OPERATOR.sub(r"`\1`(", p) for i, p in enumerate(parts))


def register_sql(spark: SparkSession, prefix: str = "gw_") -> list[str]:
    """Create (or replace) the session's functions; their names."""
    names = []
    for name, (params, result, form) in FUNCTIONS.items():
        body = sql_text(form(*[F.col(p) for p in params]))
        given = ", ".join(f"{p} STRING" for p in params)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({given}) RETURNS {result} RETURN {body}")
        names.append(prefix + name)
    return names
