from pyspark.sql import functions as F

from brute import sections
from gridweave.operators import shaping as SH
from gridweave.operators.scan import carry_last, running_sum


def test_sections_edge_cases(spark):
    levels = ["L1", "L2"]
    cases = [
        ["150", "120", "3", "4", "1", "2", "x", "0", "5"],  # first >= 100, more resets than levels
        ["5", "1.0", "6", "2", None, "9"],  # '1.0' skipped
        ["1", "1", "2"],  # equal numbers do not reset
    ]
    for nos in cases:
        rows = [("p", i, n) for i, n in enumerate(nos)]
        df = spark.createDataFrame(rows, "part string, i bigint, no string")
        out = SH.sections_by_reset(df, "part", "i", "no", levels, F.floor(F.col("i") / 2))
        got = sorted((r.i, r.level) for r in out.collect())
        assert got == sections(nos, levels)


def test_carry_forward(spark):
    rows = [("u", 0, False, None), ("u", 1, True, "h1"), ("u", 2, False, None), ("u", 3, True, None),
            ("u", 4, False, None), ("u", 5, True, "h2"), ("u", 6, False, None)]
    df = spark.createDataFrame(rows, "k string, pos bigint, head boolean, lab string")
    keep = SH.carry_forward(df, "k", "pos", F.col("head"), F.col("lab"), F.floor(F.col("pos") / 2))
    assert sorted((r.pos, r.label) for r in keep.collect()) == [(0, None), (2, "h1"), (4, "h1"), (6, "h2")]
    reset = SH.carry_forward(df, "k", "pos", F.col("head"), F.col("lab"), F.floor(F.col("pos") / 2), null_sets=True)
    assert sorted((r.pos, r.label) for r in reset.collect()) == [(0, None), (2, "h1"), (4, None), (6, "h2")]


def test_scans_across_buckets(spark):
    rows = [("a", i, (i if i % 3 == 0 else None)) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    c = carry_last(df, "k", "i", F.col("v"), "c", F.floor(F.col("i") / 4))
    assert [r.c for r in c.orderBy("i").collect()] == [i - i % 3 for i in range(20)]
    c2 = carry_last(df, "k", "i", F.col("v"), "c", F.floor(F.col("i") / 4), inclusive=False)
    assert [r.c for r in c2.orderBy("i").collect()] == [None] + [(i - 1) - (i - 1) % 3 for i in range(1, 20)]
    s = running_sum(df, "k", "i", F.col("i"), "s", F.floor(F.col("i") / 4))
    assert [r.s for r in s.orderBy("i").collect()] == [i * (i + 1) // 2 for i in range(20)]


def test_unpivot_explode_items(spark):
    df = spark.createDataFrame([(0, "h1", "h2", "h3", "h4"), (1, "a", "b", "c", "d")], "r bigint, a1 string, b1 string, a2 string, b2 string")
    out = SH.unpivot_pairs(df, ["r"], [("a1", "b1"), ("a2", "b2")], ("x", "y"), order="r").collect()
    assert [(o.pair_no, o.x, o.y) for o in out] == [(0, "a", "b"), (1, "c", "d")]
    names = spark.createDataFrame([(1, "solo", None), (2, "a b", ["a", "b"])], "id int, s string, l array<string>")
    got = sorted((r.id, r.name) for r in SH.explode_names(names, ["id"], "s", "l").collect())
    assert got == [(1, "solo"), (2, "a"), (2, "b")]
    items = SH.to_items(spark.createDataFrame([("u", "1", "x")], "url string, a string, b string"), "url", ["a", "b"])
    assert items.first().data_item == {"a": "1", "b": "x"}


def test_lines_to_records(spark):
    df = spark.createDataFrame([("mail a@b.org 1999",), ("nothing",), ("year 2020",)], "line string")
    out = SH.lines_to_records(df, "line", {"email": (r"\S+@\S+", 0), "year": (r"(19|20)\d\d", 0)}).collect()
    assert [(r.email, r.year) for r in out] == [("a@b.org", "1999"), ("", "2020")]


from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=15, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from(["a", "b"]), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=40),
    st.integers(1, 5),
)
def test_scans_match_python(spark, rows, bsize):
    data = [(k, i, v) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, i bigint, v bigint")
    b = F.floor(F.col("i") / bsize)
    inc = {r.i: r.c for r in carry_last(df, "k", "i", F.col("v"), "c", b).collect()}
    exc = {r.i: r.c for r in carry_last(df, "k", "i", F.col("v"), "c", b, inclusive=False).collect()}
    tot = {r.i: r.s for r in running_sum(df, "k", "i", F.col("v"), "s", b).collect()}
    last, before, sums = {}, {}, {}
    for k, i, v in data:
        before[i] = last.get(k)
        if v is not None:
            last[k] = v
        sums[k] = sums.get(k, 0) + (v or 0)
        assert inc[i] == last.get(k) and exc[i] == before[i] and tot[i] == sums[k]


@settings(max_examples=15, deadline=None)
@given(
    st.lists(st.one_of(st.integers(0, 150).map(str), st.sampled_from(["x", "1.0", "", None])), min_size=1, max_size=30),
    st.integers(1, 4),
)
def test_sections_property(spark, nos, bsize):
    levels = ["A", "B", "C"]
    df = spark.createDataFrame([("p", i, n) for i, n in enumerate(nos)], "part string, i bigint, no string")
    out = SH.sections_by_reset(df, "part", "i", "no", levels, F.floor(F.col("i") / bsize))
    assert sorted((r.i, r.level) for r in out.collect()) == sections(nos, levels)
