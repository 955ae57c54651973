import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import map_tables
from gridweave.operators import mapping as M
from gridweave.sources.rules import rules_frame, rules_from_dict

GRID_SCHEMA = "doc string, table_id bigint, row_idx bigint, cells array<string>"


def grid_df(spark, tables, doc="d"):
    rows = [(doc, t, r, cells) for t, table in enumerate(tables) for r, cells in enumerate(table)]
    return spark.createDataFrame(rows, GRID_SCHEMA)


def run(spark, tables, rules):
    g = grid_df(spark, tables)
    r = rules_frame(spark, "t", [(i, "attr", s, t, None) for i, (s, t) in enumerate(rules)])
    rec = M.map_records(g, r, bucket_rows=2).collect()
    targets = list(dict.fromkeys(t for _, t in rules))
    got = sorted((x.table_id, x.row_idx, tuple(x[t] for t in targets)) for x in rec)
    desc = {(x.table_id, x.row_idx): x.description for x in M.describe_table(g, r, bucket_rows=2).collect()}
    return got, desc


def expected(tables, rules):
    recs, desc = map_tables(tables, rules)
    targets = list(dict.fromkeys(t for _, t in rules))
    return sorted((t, r, tuple(d[x] for x in targets)) for t, r, d in recs), desc


RULES = [("id", "id"), ("name", "name"), ("age", "age"), ("years", "age")]


def test_basic_regions_and_descriptions(spark):
    tables = [
        [["Title"], ["id", "name", "age"], ["1", "ann", "3"], ["2", "bob", "4"], ["short"],
         ["id", "name", "years"], ["3", "cy", "5"], ["id", "name", "age"], ["id", "name", "age"], ["4", "d", "6"]],
        [["caption"], ["x", "name", "age", "id"], ["9", "z", "1", "8"], ["9", "z", "1", "8", "longer"], ["7", "y", "2", "6"]],
    ]
    got, desc = run(spark, tables, RULES)
    want, wdesc = expected(tables, RULES)
    assert got == want
    assert desc == wdesc
    # adjacent headers: the first has an empty region and no record
    assert all(r != 8 for t, r, _ in got if t == 0) and (0, 9, ("4", "d", "6")) in got


def test_label_counted_twice_reaches_threshold(spark):
    # "na" hits both cells: two hits, threshold min(2 targets, 3) = 2
    tables = [[["name", "nation"], ["a", "b"]]]
    rules = [("na", "x"), ("zz", "y")]
    got, _ = run(spark, tables, rules)
    assert got == [(0, 1, ("b", ""))]  # rightmost column of target x wins, y is ''


def test_last_label_wins_and_first_label_wins(spark):
    tables = [[["customer name", "id", "age"], ["c", "1", "2"]]]
    rules = [("name", "n1"), ("id", "id"), ("age", "age"), ("customer", "n2")]
    g = grid_df(spark, tables)
    r = rules_frame(spark, "t", [(i, "attr", s, t, None) for i, (s, t) in enumerate(rules)])
    last = {x.col: x.target for x in M.assign_columns(g, r).collect()}
    assert last[0] == "n2"
    first = {(x.col, x.target) for x in M.assign_columns(g, r, mode="first").collect()}
    assert (0, "n1") in first and (0, "n2") not in first


def test_select_rules_fill_only_missing(spark):
    tables = [[["id", "name", "age"], ["1", "a", "2"]]]
    g = grid_df(spark, tables)
    rules = {"id": "id", "name": "name", "age": "age", "@h1": "hname", "@h0": "age", "@h9": "far"}
    r = rules_from_dict(spark, "t", rules, {"@h1": "^na"})
    rec = M.map_records(g, r, keep_header=True)
    out = M.select_values(rec, r).first()
    assert out.hname == "na" and out.age == "2" and out.far is None
    assert M.load_ruleset(r).output_columns == ["id", "name", "age", "hname", "far"]


def test_title_select(spark):
    tables = [[["Report 2019"], [""], ["id", "name", "age"], ["1", "a", "2"], ["x"], ["2020 list"], ["id", "name", "age"], ["3", "b", "4"]]]
    g = grid_df(spark, tables)
    r = rules_frame(spark, "t", [(i, "attr", s, t, None) for i, (s, t) in enumerate(RULES)])
    t1 = {x.row_idx: x.title for x in M.select_title(g, r, 2, r"\d{4}").collect()}
    assert t1 == {2: "2019", 6: None}  # row 4 is the stop row of the previous region
    t2 = {x.row_idx: x.title for x in M.select_title(g, r, 1).collect()}
    assert t2 == {2: None, 6: "2020 list"}


def test_map_documents_rejects_and_strict(spark):
    g = grid_df(spark, [[["id", "name", "age"], ["1", "a", "2"]]], "ok").unionByName(
        grid_df(spark, [[["nothing"], ["here"]]], "bad")
    )
    r = rules_frame(spark, "t", [(i, "attr", s, t, None) for i, (s, t) in enumerate(RULES)])
    rec, rej = M.map_documents(g, r)
    assert [x.doc for x in rej.collect()] == ["bad"]
    assert rec.count() == 1
    with pytest.raises(RuntimeError):
        M.map_documents(g, r, strict=True)
    # a second strategy takes what the first rejects
    other = (lambda gr, ru: gr.select("doc"), lambda gr, ru: gr.select("doc", "table_id", "row_idx"))
    rec2, rej2 = M.map_documents(g, r, strategies=[M.COLUMN_STRATEGY, other])
    assert rej2.count() == 0 and rec2.count() == 3


WORDS = ["id", "name", "age", "years", "x", "1", "a", "nm", ""]


@settings(max_examples=12, deadline=None)
@given(
    st.lists(
        st.lists(st.lists(st.sampled_from(WORDS), min_size=1, max_size=4), min_size=1, max_size=7),
        min_size=1,
        max_size=3,
    )
)
def test_mapping_matches_brute_force(spark, tables):
    got, desc = run(spark, tables, RULES)
    want, wdesc = expected(tables, RULES)
    assert got == want
    assert desc == wdesc


def test_large_label_sets_use_join_path_with_same_result(spark):
    tables = [[["Title"], ["id", "name", "age"], ["1", "ann", "3"], ["id", "name", "years"], ["2", "b", "4"]]]
    g = grid_df(spark, tables)
    small = [(i, "attr", s, t, None) for i, (s, t) in enumerate(RULES)]
    # 70 labels that match nothing push the rule set past the inline limit
    big = small + [(100 + i, "attr", f"zz{i:03d}", f"t{i}", None) for i in range(70)]
    a = M.map_records(g, rules_frame(spark, "s", small))
    b = M.map_records(g, rules_frame(spark, "b", big))
    assert sorted((r.row_idx, r.id, r.name, r.age) for r in a.collect()) == sorted(
        (r.row_idx, r.id, r.name, r.age) for r in b.collect()
    )
    fa = M.map_records(g, rules_frame(spark, "s", small), mode="first")
    fb = M.map_records(g, rules_frame(spark, "b", big), mode="first")
    assert sorted((r.row_idx, r.id, r.name, r.age) for r in fa.collect()) == sorted(
        (r.row_idx, r.id, r.name, r.age) for r in fb.collect()
    )


def test_regex_select_without_text_is_null(spark):
    g = grid_df(spark, [[["id", "name", "age"], ["1", "a", "2"]]])
    # in a plain mapping only "@" keys are selects: this one is an attribute label -> ''
    d = rules_from_dict(spark, "t", {"id": "id", "name": "name", "age": "age", "[0-9]+": "num"})
    assert M.map_records(g, d).first().num == ""
    r = rules_frame(spark, "t", [(0, "attr", "id", "id", None), (1, "attr", "name", "name", None),
                                 (2, "attr", "age", "age", None), (3, "select", "[0-9]+", "num", None)])
    out = M.select_values(M.map_records(g, r, keep_header=True), r).first()
    assert out.num is None and out.id == "1"
