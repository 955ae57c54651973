"""Quality rules whose thresholds follow the data: DataFrame functions only.

Every text gets fixed statistics. Four of them, as ratios, are summarised per language and
source by mergeable quantile sketches: counts in logarithmic bins (relative width
``WIDTH``), which add up exactly in any order, so reruns and lost tasks change nothing. A
ratio's upper threshold is ``q75 + SPAN * max(q75 - q25, its least spread)``, word length has a
lower one as well; groups with fewer than ``LEAST`` texts use their language's sketch, and
languages with fewer use that of all texts. The thresholds are joined back and filter.

Texts that fail the two fixed rules (fewer than 50 words; over half of the words in
repeated three-word windows) are rejected at once and left out of the sketches.

A window is told by a 64-bit hash: two different windows of one text of n words meet by
chance with a probability under n * n / 2^65.

Defined results: a null or empty text has no words and fails; null languages and sources
are groups of their own; repeated rows are each counted and returned; with an empty table
nothing is returned; other columns are neither read nor returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import cut_lineage, text_or_empty, words

WIDTH, SPAN, LEAST = 1.02, 3.0, 200
#: ratio -> least spread that counts as spread (its scale's resolution)
SPREAD = {"word_length": 1.0, "symbols": 0.05, "dup_lines": 0.1, "repeats": 0.1}
ZERO = -100_000  # the bin of zeros


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` narrowed to doc_id, lang, source and the fixed statistics of the whole text."""
    t = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_or_empty().alias("t"))
    t = t.withColumn("w", words(F.col("t"))).withColumn("n_words", F.size("w").cast("long"))
    w = F.col("w")
    window = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    t = t.withColumn("h", F.when(F.size(w) >= 3, window).otherwise(F.array().cast("array<bigint>")))
    t = t.withColumn("sorted", F.sort_array("h"))
    h, s = F.col("h"), F.col("sorted")
    t = t.withColumn("twice", F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))
    twice = F.col("twice")
    # where repeated windows begin: few of them are looked up, many are found by sorting
    few = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(twice, F.get(h, i)))
    t = t.withColumn("pairs", F.when(F.size(twice) > 64, F.sort_array(F.arrays_zip(h.alias("x"), F.sequence(F.lit(0), F.size(h) - 1).alias("i")))))
    p = F.col("pairs")
    many = F.transform(F.filter(p, lambda x, k: (x["x"] == F.get(p, k + 1)["x"]) | (x["x"] == F.get(p, k - 1)["x"])), lambda x: x["i"])
    at = F.when(F.size(twice) == 0, F.array().cast("array<int>")).when(F.size(twice) <= 64, few).otherwise(many)
    t = t.withColumn("at", at)
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    t = t.withColumn("lines", lines)
    return t.select(
        "doc_id", "lang", "source", "n_words",
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.flatten(F.transform("at", lambda i: F.array(i, i + 1, i + 2))))).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return {"word_length": F.col("word_chars") / n, "symbols": F.col("n_symbols") / n, "dup_lines": F.col("n_dup_lines") / lines, "repeats": F.col("n_repeat_words") / n}


def sketches(stats: DataFrame) -> DataFrame:
    """``level, lang, source, ratio, bin, n``: the bins of every group (level 0), language
    (1) and of all (2), each summed from the one below."""
    bin_ = lambda v: F.when(v <= 0, F.lit(ZERO)).otherwise(F.ceil(F.log(v) / math.log(WIDTH)).cast("int"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), bin_(v).alias("bin")) for k, v in ratios().items()])).alias("x")
    own = stats.where(~base_failed()).select("lang", "source", each).groupBy("lang", "source", "x.ratio", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    own = cut_lineage(own)
    no = F.lit(None).cast("string")
    lang = own.groupBy("lang", "ratio", "bin").agg(F.sum("n").alias("n"))
    every = own.groupBy("ratio", "bin").agg(F.sum("n").alias("n"))
    cols = ["level", "lang", "source", "ratio", "bin", "n"]
    return (
        own.withColumn("level", F.lit(0)).select(cols)
        .unionByName(lang.withColumns({"level": F.lit(1), "source": no}).select(cols))
        .unionByName(every.withColumns({"level": F.lit(2), "source": no, "lang": no}).select(cols))
    )


def quantiles(sketch: DataFrame) -> DataFrame:
    """Per group and ratio: n, q25 and q75 (each the upper end of its bin)."""
    keys = ["level", "lang", "source", "ratio"]
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    value = F.when(F.col("bin") == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(WIDTH), F.col("bin")))
    q = lambda share: F.min(F.when(F.col("upto") >= share * F.col("total"), value))
    return rows.groupBy(*keys).agg(F.max("total").alias("total"), q(0.25).alias("q25"), q(0.75).alias("q75"))


def thresholds(stats: DataFrame) -> DataFrame:
    """``lang, source`` and for every ratio its upper threshold, and ``word_length_low``."""
    q = quantiles(sketches(stats))
    spread = F.element_at(F.create_map(*[F.lit(x) for kv in SPREAD.items() for x in kv]), F.col("ratio"))
    reach = SPAN * F.greatest(F.col("q75") - F.col("q25"), spread)
    q = q.withColumn("hi", F.col("q75") + reach).withColumn("lo", F.col("q25") - reach)
    wide = q.groupBy("level", "lang", "source").agg(
        F.max("total").alias("total"), *[F.max(F.when(F.col("ratio") == r, F.col("hi"))).alias(f"{r}_high") for r in SPREAD], F.max(F.when(F.col("ratio") == "word_length", F.col("lo"))).alias("word_length_low")
    )
    names = [f"{r}_high" for r in SPREAD] + ["word_length_low"]
    own = wide.where("level = 0")
    level = lambda k: wide.where(f"level = {k}").select(F.col("lang").alias("l2"), F.col("total").alias(f"t{k}"), *[F.col(c).alias(f"{c}{k}") for c in names])
    rows = own.join(level(1), F.col("lang").eqNullSafe(F.col("l2")), "left").drop("l2")
    rows = rows.join(F.broadcast(level(2).drop("l2")), F.lit(True), "left")  # one row
    pick = lambda c: F.when(F.col("total") >= LEAST, F.col(c)).when(F.col("t1") >= LEAST, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(c)
    return rows.select("lang", "source", *[pick(c) for c in names])


def apply_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept for every row of ``docs``."""
    stats = cut_lineage(statistics(docs))
    t = thresholds(stats)
    t = t.select(F.col("lang").alias("l"), F.col("source").alias("s"), *[c for c in t.columns if c not in ("lang", "source")])
    rows = stats.join(t, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    ok = F.lit(True)
    for k, v in ratios().items():
        ok = ok & (v <= F.col(f"{k}_high"))
    ok = ok & (ratios()["word_length"] >= F.col("word_length_low"))
    # a group without thresholds is one whose every text fails the fixed rules
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & F.coalesce(ok, F.lit(False))).alias("kept"),
    )


# The same in DuckDB's SQL: words, windows and lines are unnested and grouped there, and the
# thresholds follow the same bins.
_BIN = f"CASE WHEN v <= 0 THEN {ZERO} ELSE CAST(ceil(ln(v) / ln({WIDTH})) AS INT) END"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT k, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) x(j) GROUP BY k),
ln AS (SELECT k, l FROM (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
lns AS (SELECT k, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM ln GROUP BY k),
s AS (SELECT w.k, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lns.dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lns.n, 0) AS n_lines FROM w LEFT JOIN cov USING (k) LEFT JOIN lns USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  word_chars / CAST(greatest(n_words, 1) AS DOUBLE) AS word_length, n_symbols / CAST(greatest(n_words, 1) AS DOUBLE) AS symbols,
  n_dup_lines / CAST(greatest(n_lines, 1) AS DOUBLE) AS dup_lines, n_repeat_words / CAST(greatest(n_words, 1) AS DOUBLE) AS repeats FROM s),
u AS (SELECT lang, source, r, {_BIN} AS bin FROM (SELECT lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS r, unnest([word_length, symbols, dup_lines, repeats]) AS v FROM b WHERE NOT base_failed)),
k AS (SELECT 0 AS level, lang, source, r, bin, count(*) AS n FROM u GROUP BY lang, source, r, bin
  UNION ALL SELECT 1, lang, NULL, r, bin, count(*) FROM u GROUP BY lang, r, bin UNION ALL SELECT 2, NULL, NULL, r, bin, count(*) FROM u GROUP BY r, bin),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, r ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, r) AS total,
  CASE WHEN bin = {ZERO} THEN 0.0 ELSE pow({WIDTH}, bin) END AS v FROM k),
q AS (SELECT level, lang, source, r, max(total) AS total, min(v) FILTER (upto >= 0.25 * total) AS q25, min(v) FILTER (upto >= 0.75 * total) AS q75 FROM c GROUP BY level, lang, source, r),
f AS (SELECT *, q75 + {SPAN} * greatest(q75 - q25, CASE r {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SPREAD.items())} END) AS hi, q25 - {SPAN} * greatest(q75 - q25, {SPREAD['word_length']}) AS lo FROM q),
g AS (SELECT f0.lang, f0.source, f0.r, CASE WHEN f0.total >= {LEAST} THEN f0.hi WHEN f1.total >= {LEAST} THEN f1.hi ELSE f2.hi END AS hi,
  CASE WHEN f0.total >= {LEAST} THEN f0.lo WHEN f1.total >= {LEAST} THEN f1.lo ELSE f2.lo END AS lo
  FROM (SELECT * FROM f WHERE level = 0) f0 LEFT JOIN (SELECT * FROM f WHERE level = 1) f1 ON f0.r = f1.r AND f0.lang IS NOT DISTINCT FROM f1.lang JOIN (SELECT * FROM f WHERE level = 2) f2 ON f0.r = f2.r),
v AS (SELECT b.k, bool_and(CASE r WHEN 'word_length' THEN word_length <= hi AND word_length >= lo WHEN 'symbols' THEN symbols <= hi WHEN 'dup_lines' THEN dup_lines <= hi ELSE repeats <= hi END) AS ok
  FROM b JOIN g ON b.lang IS NOT DISTINCT FROM g.lang AND b.source IS NOT DISTINCT FROM g.source GROUP BY b.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, FALSE) AS kept FROM b LEFT JOIN v USING (k)
"""
