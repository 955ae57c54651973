"""Large label sets through the index, and the SQL functions, against the rule itself."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from brute import fuzzy
from gridweave.functions import sql as SQL
from gridweave.operators import label_index
from gridweave.operators import links as LK
from gridweave.operators import mapping as M
from gridweave.operators.label_index import match_labels
from gridweave.sources.rules import rules_frame

LETTERS = "abcdefgh é中"


def words(rng, n, longest):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_five_thousand_labels(spark):
    rng = random.Random(1)
    labels = words(rng, 4990, 7) + ["", "", "zzz", "a", "a"] + ["Q" * 3] * 5
    cells = words(rng, 150, 12) + ["", None, "a", "abcdefgh é中" * 2]
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, cell string")
    got = sorted((r.i, r.ord) for r in match_labels(rows, spark.createDataFrame(list(enumerate(labels)), "ord int, label string")).collect())
    assert got == sorted((i, k) for i, c in enumerate(cells) for k, x in enumerate(labels) if fuzzy(c, x))


def test_no_comparison_of_all_pairs(spark):
    rules = rules_frame(spark, "r", [(i, "attr", f"label {i}", f"t{i % 9}", None) for i in range(5000)])
    grid = spark.createDataFrame([("d", 0, 0, ["label 7", "label 8"])], "doc string, table_id bigint, row_idx bigint, cells array<string>")
    hits = M.cell_hits(grid, rules)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {(r.col, r.ord) for r in hits.collect()} == {(k, i) for k, c in enumerate(["label 7", "label 8"]) for i in range(5000) if fuzzy(c, f"label {i}")}


def test_texts_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Files that look small beside the label side's planned size (F1)."""
    path = str(tmp_path / "texts")
    spark.range(20000).selectExpr("id as i", "concat('blue ring ', id % 7, ' zx') as cell").write.parquet(path)
    rows = spark.read.parquet(path)
    labels = rows.select(F.substring("cell", 1, 6).alias("label")).union(rows.select(F.substring("cell", 6, 9))).distinct()
    texts = [f"blue ring {k} zx" for k in range(7)]
    want = sorted((i, lab) for i in range(14) for lab in {t[:6] for t in texts} | {t[5:14] for t in texts} if fuzzy(texts[i % 7], lab))
    for limit, join in ((8_000_000, r"BroadcastHashJoin \[__key#\d+\], \[__char#\d+\], Inner, BuildRight"), (0, r"SortMergeJoin(\(skew=true\))? \[__key#\d+\]")):
        monkeypatch.setattr(label_index, "BROADCAST_BYTES", limit, raising=False)
        met = match_labels(rows, labels)
        assert re.search(join, met._jdf.queryExecution().executedPlan().toString())
        assert sorted(map(tuple, met.where("i < 14").select("i", "label").collect())) == want
        assert met.count() == sum(20000 // 7 + (i < 20000 % 7) for i, _ in want if i < 7)


def test_null_and_missing_labels(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "i int, cell string")
    labels = spark.createDataFrame([(0, None), (1, "b"), (2, "xy")], "ord int, label string")
    assert [(r.i, r.ord) for r in match_labels(rows, labels).collect()] == [(1, 1)]
    assert match_labels(rows.limit(0), labels).collect() == [] and match_labels(rows, labels.limit(0)).collect() == []


def test_links_under_many_labels(spark):
    rng = random.Random(2)
    labels, texts = words(rng, 200, 4), words(rng, 40, 8)
    links = spark.createDataFrame([(1, i, f"u{i % 9}", t) for i, t in enumerate(texts)], "page_id bigint, pos bigint, dst_url string, text string")
    want = {}
    for i, t in enumerate(texts):
        for x in labels:
            if fuzzy(t, x):
                want[f"u{i % 9}"] = x
    assert {r.dst_url: r.label for r in LK.label_links(links, labels).collect()} == want


def test_sql_functions_equal_columns(spark):
    names = SQL.register_sql(spark)
    assert all(n.startswith("gw_") for n in names)
    rng = random.Random(3)
    pairs = [(a, b) for a, b in zip(words(rng, 60, 9), words(rng, 60, 3))] + [(None, "a"), ("a", None), ("", "")]
    hrefs = ["../x y", "//h/p", "?q=1", "#f", "", "http://o/p.html?a=b&amp;c", "a/./b/../c.tar.gz", "<b>t &eacute;</b>　'\\"]
    pairs += [("http://s.org/d/e.html", h) for h in hrefs]
    spark.createDataFrame(pairs, "s string, r string").createOrReplaceTempView("gw_pairs")
    for name, (params, _, form) in SQL.FUNCTIONS.items():
        args = ["s", "r"][: len(params)] if len(params) == 2 else ["r"]
        got = spark.sql(f"SELECT s, r, gw_{name}({', '.join(args)}) AS x FROM gw_pairs")
        want = spark.table("gw_pairs").select("s", "r", form(*[F.col(a) for a in args]).alias("x"))
        key = lambda r: (r.s or "", r.r or "", str(r.x))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str), name
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString(), key
