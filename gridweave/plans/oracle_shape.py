"""DuckDB oracles for shaping, counts, routing, HTML round trips, M12 and M14."""

from __future__ import annotations

from gridweave.plans.catalog_shape import HEADING_RE, LINE_PATTERNS, MULTI_RULES, OUTPUTS, SECTION_LEVELS
from gridweave.plans.fixtures import GRID_RULES, RENDER_BLOCK
from gridweave.plans.oracle import GRID_CTES, WITH_MAP, extract, fuzzy, q
from gridweave.plans.oracle_web import clean

LINES_CTE = """lines AS (
  SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""

ITEMS = ", items AS (SELECT *, doc || '/t/' || CAST(table_id AS VARCHAR) AS url FROM records)"

OUTPUTS_VALUES = "(VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in OUTPUTS) + ") AS o(output_id, sink, key)"

ROUTED = (
    ITEMS
    + f""",
outs AS (SELECT * FROM {OUTPUTS_VALUES}),
it2 AS (SELECT *, CASE WHEN doc = 'r/0' THEN 'zero' END AS output_id FROM items),
it3 AS (SELECT *, CASE WHEN output_id IN (SELECT output_id FROM outs) THEN output_id ELSE 'default' END AS eff FROM it2),
routed AS (SELECT it3.*, outs.sink, outs.key FROM it3 JOIN outs ON outs.output_id = it3.eff)"""
)

LEVELS = "[" + ", ".join(q(x) for x in SECTION_LEVELS) + "]"

CLEANED_GRID = "array_to_string(list_transform(cells, lambda c: " + clean("c") + "), '|')"


def _labels(rows, dedup: bool) -> str:
    attrs = [(o, s, t) for o, k, s, t, _ in rows if k == "attr"]
    if dedup:
        seen, out = set(), []
        for o, s, t in attrs:
            if s not in seen:
                seen.add(s)
                out.append((o, s, t))
        attrs = out
    return "(VALUES " + ", ".join(f"({o}, {q(s)}, {q(t)})" for o, s, t in attrs) + ")"


MULTI_TARGETS = list(dict.fromkeys(t for _, k, _, t, _ in MULTI_RULES if k == "attr"))

MULTI_SQL = (
    "WITH "
    + GRID_CTES
    + f""",
src(ord, source, target) AS {_labels(MULTI_RULES, True)},
alltg(ord, source, target) AS {_labels(MULTI_RULES, False)},
ex AS (
  SELECT doc, table_id, row_idx, len(cells) AS n_cells,
         generate_subscripts(cells, 1) - 1 AS col, unnest(cells) AS cell
  FROM grid),
hits AS (SELECT ex.*, src.ord, src.source FROM ex JOIN src ON {fuzzy('ex.cell', 'src.source')}),
hdr AS (
  SELECT doc, table_id, row_idx, max(n_cells) AS n FROM hits GROUP BY doc, table_id, row_idx
  HAVING count(*) >= (SELECT least(count(DISTINCT target), 3) FROM alltg)),
firstsrc AS (
  SELECT h.doc, h.table_id, h.row_idx AS hrow, h.col, arg_min(h.source, h.ord) AS source
  FROM hits h JOIN hdr USING (doc, table_id, row_idx)
  WHERE h.cell <> ''
  GROUP BY h.doc, h.table_id, h.row_idx, h.col),
colmap AS (SELECT f.doc, f.table_id, f.hrow, f.col, a.target FROM firstsrc f JOIN alltg a ON a.source = f.source),
g2 AS (
  SELECT g.*, h.row_idx IS NOT NULL AS is_h, h.n AS hn
  FROM grid g LEFT JOIN hdr h USING (doc, table_id, row_idx)),
g3 AS (
  SELECT *,
    last_value(CASE WHEN is_h THEN row_idx END IGNORE NULLS) OVER w AS cur_row,
    last_value(hn IGNORE NULLS) OVER w AS cur_n
  FROM g2 WINDOW w AS (PARTITION BY doc, table_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g4 AS (
  SELECT *, last_value(CASE WHEN is_h OR (cur_row IS NOT NULL AND len(cells) <> cur_n) THEN row_idx END
               IGNORE NULLS) OVER w AS last_bad
  FROM g3 WINDOW w AS (PARTITION BY doc, table_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
drows AS (SELECT doc, table_id, row_idx, cells, cur_row FROM g4 WHERE NOT is_h AND cur_row IS NOT NULL AND last_bad = cur_row),
dcells AS (
  SELECT doc, table_id, row_idx, cur_row, generate_subscripts(cells, 1) - 1 AS col, unnest(cells) AS cell FROM drows),
vals AS (
  SELECT d.doc, d.table_id, d.row_idx, m.target, max_by(d.cell, d.col) AS v
  FROM dcells d JOIN colmap m ON d.doc = m.doc AND d.table_id = m.table_id AND d.cur_row = m.hrow AND d.col = m.col
  GROUP BY d.doc, d.table_id, d.row_idx, m.target)
SELECT d.doc, d.table_id, d.row_idx, """
    + ", ".join(
        f"coalesce(max(CASE WHEN v.target = {q(t)} THEN v.v END), '') AS {t}" for t in MULTI_TARGETS
    )
    + """
FROM drows d LEFT JOIN vals v USING (doc, table_id, row_idx) GROUP BY d.doc, d.table_id, d.row_idx"""
)

REJECTS_SQL = (
    "WITH "
    + GRID_CTES
    + ", "
    + LINES_CTE
    + f""",
allgrid AS (
  SELECT doc, table_id, row_idx, cells FROM grid
  UNION ALL SELECT 'd/' || CAST(doc_id AS VARCHAR), CAST(0 AS BIGINT), pos, [line] FROM lines),
labels(ord, source, target) AS {_labels(GRID_RULES, False)},
ex AS (SELECT doc, table_id, row_idx, unnest(cells) AS cell FROM allgrid),
hits AS (SELECT ex.* FROM ex JOIN labels ON {fuzzy('ex.cell', 'labels.source')}),
hdr AS (
  SELECT DISTINCT doc FROM (
    SELECT doc, table_id, row_idx FROM hits GROUP BY doc, table_id, row_idx
    HAVING count(*) >= (SELECT least(count(DISTINCT target), 3) FROM labels)))
SELECT DISTINCT a.doc, a.doc IN (SELECT doc FROM hdr) AS accepted FROM allgrid a"""
)

SHAPE_SQL = {
    "carry_heading": """WITH e AS (
  SELECT event_id, user_id, event_type,
    last_value(CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) END IGNORE NULLS) OVER (
      PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading
  FROM events)
SELECT event_id, user_id, heading FROM e WHERE event_type <> 'signup'""",
    "lines_to_records": "WITH "
    + LINES_CTE
    + f""",
x AS (SELECT doc_id, pos, {extract("line", LINE_PATTERNS["email"][0], 0)} AS email,
             {extract("line", LINE_PATTERNS["year"][0], 0)} AS year FROM lines)
SELECT doc_id, pos, coalesce(email, '') AS email, coalesce(year, '') AS year FROM x
WHERE email IS NOT NULL OR year IS NOT NULL""",
    "serial_sections": f"""WITH s AS (
  SELECT conv_id % 8 AS part, conv_id, turn, CAST(turn AS VARCHAR) AS no FROM conversations),
k AS (SELECT *, CAST(no AS BIGINT) AS n FROM s WHERE regexp_matches(no, '^[0-9]+$')),
p AS (SELECT *, lag(n) OVER (PARTITION BY part ORDER BY conv_id, turn) AS prev FROM k),
r AS (
  SELECT *, sum(CASE WHEN n < coalesce(prev, 100) THEN 1 ELSE 0 END) OVER (
    PARTITION BY part ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec
  FROM p)
SELECT part, conv_id, turn, CASE WHEN sec > 0 THEN {LEVELS}[CAST(sec AS BIGINT)] END AS level, CAST(sec AS BIGINT) AS section
FROM r WHERE sec <= {len(SECTION_LEVELS)}""",
    "unpivot_pairs": """SELECT o_orderkey, CAST(0 AS BIGINT) AS pair_no, o_orderstatus AS a, o_orderpriority AS b
FROM orders WHERE o_orderkey > 0
UNION ALL
SELECT o_orderkey, 1, CAST(o_custkey AS VARCHAR), CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders WHERE o_orderkey > 0""",
    "explode_names": "WITH "
    + LINES_CTE
    + """,
n AS (SELECT doc_id, pos, CASE WHEN contains(line, ' ') THEN string_split(line, ' ') ELSE [line] END AS ns FROM lines)
SELECT doc_id, pos, CAST(generate_subscripts(ns, 1) - 1 AS BIGINT) AS name_pos, unnest(ns) AS name FROM n""",
    "item_envelope": WITH_MAP
    + ITEMS
    + """
SELECT url, 'cust_key' AS item_key, cust_key AS item_value FROM items
UNION ALL SELECT url, 'cust_name', cust_name FROM items
UNION ALL SELECT url, 'balance', balance FROM items
UNION ALL SELECT url, 'segment', segment FROM items""",
    "url_counts": WITH_MAP + ITEMS + "\nSELECT url, count(*) AS n FROM items GROUP BY url",
    "route_outputs": WITH_MAP + ROUTED + "\nSELECT url, table_id, row_idx, sink, key FROM routed",
    "url_counts_json": WITH_MAP
    + ROUTED
    + """,
js AS (SELECT * FROM routed WHERE sink = 'json'),
rk AS (SELECT arg_min(key, {'d': doc, 't': table_id, 'r': row_idx}) AS run_key FROM js)
SELECT 'urls_' || rk.run_key AS key, js.url, count(*) AS n FROM js, rk
WHERE rk.run_key IS NOT NULL AND trim(rk.run_key) <> ''
GROUP BY rk.run_key, js.url""",
    "html_table_roundtrip": "WITH " + GRID_CTES + f"\nSELECT table_id, row_idx, {CLEANED_GRID} AS cells FROM grid",
    "rowspan_fill": "WITH " + GRID_CTES + f"\nSELECT table_id, row_idx, {CLEANED_GRID} AS cells FROM grid",
    "grid_to_cells": "WITH "
    + GRID_CTES
    + """,
c AS (SELECT doc, table_id, row_idx, generate_subscripts(cells, 1) - 1 AS col, unnest(cells) AS text FROM grid)
SELECT doc, CAST(table_id AS VARCHAR) || '.' || CAST(row_idx AS VARCHAR) || '.' || CAST(col AS VARCHAR) AS path, text FROM c""",
    "locate_value": "WITH "
    + GRID_CTES
    + f""",
c AS (SELECT doc, table_id, row_idx, generate_subscripts(cells, 1) - 1 AS col, unnest(cells) AS text FROM grid)
SELECT doc, CAST(table_id AS VARCHAR) || '.' || CAST(row_idx AS VARCHAR) || '.' || CAST(col AS VARCHAR) AS path
FROM c WHERE {fuzzy("text", "'name'")}""",
    "value_at": "WITH "
    + GRID_CTES
    + f""",
c AS (SELECT doc, table_id, row_idx, generate_subscripts(cells, 1) - 1 AS col, unnest(cells) AS text FROM grid),
h AS (SELECT doc, table_id, row_idx + 1 AS row_idx, col FROM c WHERE {fuzzy("text", "'name'")})
SELECT h.doc, CAST(h.table_id AS VARCHAR) || '.' || CAST(h.row_idx AS VARCHAR) || '.' || CAST(h.col AS VARCHAR) AS path, c.text
FROM h LEFT JOIN c ON c.doc = h.doc AND c.table_id = h.table_id AND c.row_idx = h.row_idx AND c.col = h.col""",
    "join_nested": "WITH " + GRID_CTES + "\nSELECT doc, table_id, row_idx, array_to_string(cells, '') AS joined FROM grid",
    "distinct_ordered": "WITH "
    + LINES_CTE
    + """,
w AS (SELECT doc_id, pos, string_split(line, ' ') AS ws FROM lines)
SELECT doc_id, pos, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ' ') AS words FROM w""",
    "assign_multi": MULTI_SQL,
    "mapping_rejects": REJECTS_SQL,
    "carry_heading_reset": """WITH e AS (
  SELECT event_id, user_id, event_type,
    last_value(CASE WHEN event_type = 'signup'
                    THEN {'v': CASE WHEN value >= 10 THEN CAST(event_id AS VARCHAR) END} END IGNORE NULLS) OVER (
      PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h
  FROM events)
SELECT event_id, user_id, h.v AS heading FROM e WHERE event_type <> 'signup'""",
    "heading_lines": "WITH "
    + LINES_CTE
    + f""",
h AS (
  SELECT *, coalesce(regexp_matches(line, {q(HEADING_RE)}), false) AS is_h FROM lines),
c AS (
  SELECT *, last_value(CASE WHEN is_h THEN line END IGNORE NULLS) OVER (
      PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading
  FROM h),
x AS (
  SELECT doc_id, pos, heading, {extract("line", LINE_PATTERNS["email"][0], 0)} AS email,
         {extract("line", LINE_PATTERNS["year"][0], 0)} AS year
  FROM c WHERE NOT is_h)
SELECT doc_id, pos, heading, coalesce(email, '') AS email, coalesce(year, '') AS year FROM x
WHERE email IS NOT NULL OR year IS NOT NULL""",
    "rowspan_pairs": "WITH "
    + GRID_CTES
    + f""",
c AS (
  SELECT table_id, row_idx, list_transform(cells, lambda x: {clean("x")}) AS cl
  FROM grid WHERE len(cells) = 5 AND row_idx % {RENDER_BLOCK} <> 0)
SELECT table_id, row_idx, CAST(0 AS BIGINT) AS pair_no, cl[2] AS a, cl[3] AS b FROM c
UNION ALL
SELECT table_id, row_idx, CAST(1 AS BIGINT), cl[4], cl[5] FROM c""",
    "labelled_records": WITH_MAP
    + """SELECT r.doc, r.table_id, r.row_idx, r.cust_key, r.cust_name, x.r_name AS region
FROM records r LEFT JOIN nation n ON n.n_nationkey = r.table_id LEFT JOIN region x ON x.r_regionkey = n.n_regionkey""",
    "json_list": WITH_MAP
    + ROUTED
    + """
SELECT key, CAST(to_json(map(['cust_key', 'cust_name', 'balance', 'segment'], [cust_key, cust_name, balance, segment])) AS VARCHAR) AS record,
       doc AS seq_doc, table_id AS seq_table_id, row_idx AS seq_row_idx
FROM routed WHERE sink = 'json'""",
    "csv_files": WITH_MAP
    + ROUTED
    + """
SELECT key, doc, table_id, row_idx, cust_key, cust_name, balance, segment FROM routed WHERE sink = 'csv'""",
    "stream_url_counts": WITH_MAP + ITEMS + "\nSELECT url, count(*) AS n FROM items GROUP BY url",
    "stream_seen_urls": "SELECT DISTINCT url FROM pages",
}
