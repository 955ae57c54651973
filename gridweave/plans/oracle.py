"""DuckDB oracle SQL: the same fixtures and the same semantics written independently as
plain single-node SQL (windows over whole partitions, joins, conditional pivots).

Every statement runs against the driver's pre-registered views.
"""

from __future__ import annotations

from gridweave.plans.fixtures import GRADE_SPLIT, GRID_RULES, HEADER_VARIANTS


def q(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def fuzzy(s: str, r: str) -> str:
    """X1 in DuckDB SQL."""
    return (
        f"(CASE WHEN {s} IS NULL OR {r} IS NULL OR length({r}) > length({s}) THEN false "
        f"WHEN length({r}) = 0 THEN true "
        f"ELSE list_bool_and(list_transform(range(1, length({r}) + 1), "
        f"lambda i: instr(substr({s}, i), substr({r}, i, 1)) > 0)) END)"
    )


def extract(c: str, regex: str, group: int = 0) -> str:
    return f"(CASE WHEN regexp_matches({c}, {q(regex)}) THEN regexp_extract({c}, {q(regex)}, {group}) END)"


def _list(vals) -> str:
    return "[" + ", ".join(q(v) for v in vals) + "]"


HV = "hv(v, cells) AS (VALUES " + ", ".join(
    f"({i}, {_list(v)})" for i, v in enumerate(HEADER_VARIANTS)
) + ")"

LABELS = "labels(ord, source, target) AS (VALUES " + ", ".join(
    f"({o}, {q(s)}, {q(t)})" for o, k, s, t, _ in GRID_RULES if k == "attr"
) + ")"

GRID_CTES = f"""
cust0 AS (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
         CASE WHEN c_acctbal >= {GRADE_SPLIT} THEN 'A' ELSE 'B' END AS grade
  FROM customer),
cust AS (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey, grade ORDER BY c_custkey) AS k FROM cust0),
cnt AS (
  SELECT c_nationkey, sum(CASE WHEN grade = 'A' THEN 1 ELSE 0 END) AS n_a,
         sum(CASE WHEN grade = 'B' THEN 1 ELSE 0 END) AS n_b
  FROM cust0 GROUP BY c_nationkey),
nat AS (
  SELECT n_nationkey, n_name, n_regionkey,
         CAST(coalesce(n_a, 0) AS BIGINT) AS n_a, CAST(coalesce(n_b, 0) AS BIGINT) AS n_b,
         'r/' || CAST(n_regionkey AS VARCHAR) AS doc
  FROM nation LEFT JOIN cnt ON n_nationkey = c_nationkey),
{HV},
grid AS (
  SELECT doc, CAST(n_nationkey AS BIGINT) AS table_id, CAST(0 AS BIGINT) AS row_idx,
         [n_name || ' grade A'] AS cells FROM nat
  UNION ALL
  SELECT doc, n_nationkey, 1, hv.cells FROM nat JOIN hv ON hv.v = n_nationkey % 3
  UNION ALL
  SELECT doc, n_nationkey, n_a + 2, [n_name || ' grade B'] FROM nat
  UNION ALL
  SELECT doc, n_nationkey, n_a + 3, hv.cells FROM nat JOIN hv ON hv.v = (n_nationkey + 1) % 3
  UNION ALL
  SELECT doc, n_nationkey, n_a + n_b + 4, ['end of ' || n_name] FROM nat
  UNION ALL
  SELECT nat.doc, n_nationkey, CASE WHEN grade = 'A' THEN k + 1 ELSE n_a + 3 + k END,
         [CAST(c_custkey AS VARCHAR), c_name, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR),
          c_mktsegment, n_name]
  FROM cust JOIN nat ON c_nationkey = n_nationkey)"""

# Header detection and regions over `grid`, as CTEs following GRID_CTES.
MAP_CTES = f""",
{LABELS},
ex AS (
  SELECT doc, table_id, row_idx, len(cells) AS n_cells,
         generate_subscripts(cells, 1) - 1 AS col, unnest(cells) AS cell
  FROM grid),
hits AS (
  SELECT ex.*, labels.ord, labels.target FROM ex JOIN labels ON {fuzzy('ex.cell', 'labels.source')}),
hdr AS (
  SELECT doc, table_id, row_idx, count(*) AS hits, min(ord) AS first_ord, max(n_cells) AS n
  FROM hits GROUP BY doc, table_id, row_idx
  HAVING count(*) >= (SELECT least(count(DISTINCT target), 3) FROM labels)),
colmap AS (
  SELECT h.doc, h.table_id, h.row_idx AS hrow, h.col, max_by(h.target, h.ord) AS target,
         any_value(h.cell) AS header_text
  FROM hits h JOIN hdr USING (doc, table_id, row_idx)
  GROUP BY h.doc, h.table_id, h.row_idx, h.col),
g2 AS (
  SELECT g.*, h.row_idx IS NOT NULL AS is_h, h.n AS hn, h.first_ord
  FROM grid g LEFT JOIN hdr h USING (doc, table_id, row_idx)),
g3 AS (
  SELECT *,
    last_value(CASE WHEN is_h THEN row_idx END IGNORE NULLS) OVER w AS cur_row,
    last_value(hn IGNORE NULLS) OVER w AS cur_n
  FROM g2 WINDOW w AS (PARTITION BY doc, table_id ORDER BY row_idx
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g4 AS (
  SELECT *,
    last_value(CASE WHEN is_h OR (cur_row IS NOT NULL AND len(cells) <> cur_n) THEN row_idx END
               IGNORE NULLS) OVER w AS last_bad
  FROM g3 WINDOW w AS (PARTITION BY doc, table_id ORDER BY row_idx
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
drows AS (
  SELECT doc, table_id, row_idx, cells, cur_row FROM g4
  WHERE NOT is_h AND cur_row IS NOT NULL AND last_bad = cur_row),
dcells AS (
  SELECT doc, table_id, row_idx, cur_row, generate_subscripts(cells, 1) - 1 AS col,
         unnest(cells) AS cell
  FROM drows),
vals AS (
  SELECT d.doc, d.table_id, d.row_idx, m.target, max_by(d.cell, d.col) AS v
  FROM dcells d JOIN colmap m
    ON d.doc = m.doc AND d.table_id = m.table_id AND d.cur_row = m.hrow AND d.col = m.col
  GROUP BY d.doc, d.table_id, d.row_idx, m.target),
mapped_hdr AS (
  SELECT doc, table_id, hrow, list(header_text ORDER BY col) AS mapped
  FROM colmap GROUP BY doc, table_id, hrow),
records AS (
  SELECT d.doc, d.table_id, d.row_idx, d.cur_row,
    coalesce(max(CASE WHEN v.target = 'cust_key' THEN v.v END), '') AS cust_key,
    coalesce(max(CASE WHEN v.target = 'cust_name' THEN v.v END), '') AS cust_name,
    coalesce(max(CASE WHEN v.target = 'balance' THEN v.v END), '') AS balance,
    coalesce(max(CASE WHEN v.target = 'segment' THEN v.v END), '') AS segment
  FROM drows d LEFT JOIN vals v USING (doc, table_id, row_idx)
  GROUP BY d.doc, d.table_id, d.row_idx, d.cur_row),
bounds AS (
  SELECT h.doc, h.table_id, h.row_idx, h.first_ord, e.data_end, t.table_last,
         CASE WHEN coalesce(e.data_end, h.row_idx) < t.table_last
              THEN coalesce(e.data_end, h.row_idx) END AS break_end
  FROM hdr h
  LEFT JOIN (SELECT doc, table_id, cur_row AS row_idx, max(row_idx) AS data_end
             FROM drows GROUP BY ALL) e USING (doc, table_id, row_idx)
  LEFT JOIN (SELECT doc, table_id, max(row_idx) AS table_last FROM grid GROUP BY ALL) t
    USING (doc, table_id)),
ranked AS (
  SELECT *,
    last_value(CASE WHEN data_end IS NOT NULL THEN {{'t': table_id, 'e': data_end}} END IGNORE NULLS)
      OVER (PARTITION BY doc ORDER BY first_ord, table_id, row_idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
    last_value(break_end IGNORE NULLS)
      OVER (PARTITION BY doc ORDER BY first_ord, table_id, row_idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end
  FROM bounds)"""

WITH_MAP = "WITH " + GRID_CTES + MAP_CTES + "\n"

MAPPING_SQL = {
    "find_headers": WITH_MAP
    + "SELECT doc, table_id, row_idx, hits, CAST(first_ord AS BIGINT) AS first_ord FROM hdr",
    "header_order": WITH_MAP
    + """SELECT doc, table_id, row_idx,
  row_number() OVER (PARTITION BY doc ORDER BY first_ord, table_id, row_idx) AS rank FROM hdr""",
    "assign_columns": WITH_MAP
    + "SELECT doc, table_id, hrow AS row_idx, CAST(col AS BIGINT) AS col, header_text, target FROM colmap",
    "data_rows": WITH_MAP
    + """SELECT doc, table_id, row_idx, cur_row AS header_row, array_to_string(cells, '|') AS cells
FROM drows""",
    "map_records": WITH_MAP
    + "SELECT doc, table_id, row_idx, cust_key, cust_name, balance, segment FROM records",
    "table_description": WITH_MAP
    + """, heads AS (
  SELECT doc, table_id, row_idx,
         CASE WHEN prev.t = table_id THEN prev.e + 1 ELSE 0 END AS d_start
  FROM ranked WHERE data_end IS NOT NULL)
SELECT h.doc, h.table_id, h.row_idx,
  coalesce(string_agg(CASE WHEN g.row_idx >= h.d_start AND g.row_idx < h.row_idx
                           THEN array_to_string(g.cells, '') END, '' ORDER BY g.row_idx), '')
    AS description
FROM heads h JOIN grid g ON g.doc = h.doc AND g.table_id = h.table_id
GROUP BY h.doc, h.table_id, h.row_idx""",
    "select_title": WITH_MAP
    + """SELECT r.doc, r.table_id, r.row_idx,
  CASE WHEN r.row_idx - 1 >= 0 AND r.row_idx - 1 > coalesce(r.prev_end, -1)
       THEN list_filter(g.cells, lambda c: c IS NOT NULL AND length(c) > 0)[1] END AS title
FROM ranked r LEFT JOIN grid g
  ON g.doc = r.doc AND g.table_id = r.table_id AND g.row_idx = r.row_idx - 1""",
    "award_level": WITH_MAP
    + """, heads AS (
  SELECT doc, table_id, row_idx,
         CASE WHEN prev.t = table_id THEN prev.e + 1 ELSE 0 END AS d_start
  FROM ranked WHERE data_end IS NOT NULL),
descr AS (
  SELECT h.doc, h.table_id, h.row_idx,
    coalesce(string_agg(CASE WHEN g.row_idx >= h.d_start AND g.row_idx < h.row_idx
                             THEN array_to_string(g.cells, '') END, '' ORDER BY g.row_idx), '')
      AS description
  FROM heads h JOIN grid g ON g.doc = h.doc AND g.table_id = h.table_id
  GROUP BY h.doc, h.table_id, h.row_idx)
SELECT r.doc, r.table_id, r.row_idx, r.cust_key, r.cust_name,
       """
    + extract("d.description", "grade ([AB])", 1)
    + """ AS level
FROM records r JOIN descr d ON d.doc = r.doc AND d.table_id = r.table_id AND d.row_idx = r.cur_row
WHERE """
    + extract("d.description", "grade ([AB])", 1)
    + " IS NOT NULL",
    "select_header": WITH_MAP
    + """SELECT r.doc, r.table_id, r.row_idx, m.mapped[2] AS name_header
FROM records r JOIN mapped_hdr m ON m.doc = r.doc AND m.table_id = r.table_id AND m.hrow = r.cur_row""",
    "select_post": WITH_MAP
    + """SELECT r.doc, r.table_id, r.row_idx, """
    + extract("m.mapped[1]", "key", 0)
    + """ AS key_header
FROM records r JOIN mapped_hdr m ON m.doc = r.doc AND m.table_id = r.table_id AND m.hrow = r.cur_row""",
    "fill_select": WITH_MAP
    + """SELECT r.doc, r.table_id, r.row_idx, coalesce(r.segment, m.mapped[4]) AS segment
FROM records r JOIN mapped_hdr m ON m.doc = r.doc AND m.table_id = r.table_id AND m.hrow = r.cur_row""",
    "select_text": WITH_MAP
    + """SELECT r.doc, r.table_id, r.row_idx, """
    + extract(extract("x.r_name", "[A-Z]+", 0), "^[A-Z]{2}", 0)
    + """ AS region_word
FROM records r LEFT JOIN region x ON r.doc = 'r/' || CAST(x.r_regionkey AS VARCHAR)""",
}
