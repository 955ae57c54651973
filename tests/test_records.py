"""CSV records over several lines, splits and tables in a file, against the csv module."""

from __future__ import annotations

import csv
import io
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridweave.sinks.files import write_csv
from gridweave.sources.pages import csv_records, read_grid


def grid_of(spark, path, **how):
    rows = read_grid(spark, str(path), **how).collect()
    return {(r.table_id, r.row_idx): list(r.cells) for r in rows}


def written(rows, **how):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n", **how).writerows(rows)
    return out.getvalue()


ODD = ["", "a", "x,y", 'say "hi"', '"', '""', "two\nlines", "\n", 'q"\n"q', " sp ", "é中", "\r\nx", ",", ',"\n,"']


def test_written_values_come_back(spark, tmp_path):
    rows = [(i, a, b, "k") for i, (a, b) in enumerate((a, b) for a in ODD for b in ODD)]
    write_csv(spark.createDataFrame(rows, "n int, a string, b string, key string").repartition(3), str(tmp_path / "o"), ["n", "a", "b"])
    got = read_grid(spark, str(tmp_path / "o" / "key=k")).collect()
    heads = [r for r in got if r.row_idx == 0]
    assert all(list(r.cells) == ["n", "a", "b"] for r in heads) and len(heads) == 3
    assert sorted(tuple(r.cells) for r in got if r.row_idx) == sorted((str(n), a, b) for n, a, b, _ in rows)


CELL = st.lists(st.sampled_from(['"', ",", "\n", "a", "b ", "é", "\r\n"]), max_size=6).map("".join)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.lists(CELL, min_size=2, max_size=4), min_size=1, max_size=12), min_size=1, max_size=3))
def test_random_files_against_the_csv_module(spark, tmp_path_factory, files):
    d = tmp_path_factory.mktemp("csv")
    for i, rows in enumerate(files):
        (d / f"f{i}.csv").write_text(written(rows), newline="")
    assert grid_of(spark, d) == {(t, r): c for t, rows in enumerate(files) for r, c in enumerate(rows)}


@pytest.mark.parametrize("size", [64, 777])
def test_records_across_splits(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [[str(i), "".join(rng.choice(['"', ",", "\n", "word ", "é"]) for _ in range(rng.randint(0, 40)))] for i in range(400)]
    (tmp_path / "big.csv").write_text(written(rows), newline="")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = grid_of(spark, tmp_path)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == {(0, i): r for i, r in enumerate(rows)}


def test_cells_of_a_megabyte(spark, tmp_path):
    rows = [["x" * 1_000_000, 'a"b' * 200_000], ["l\n" * 100_000, ","], ["y" * 1_000_000, ""]]
    (tmp_path / "wide.csv").write_text(written(rows), newline="")
    t = time.time()
    assert grid_of(spark, tmp_path) == {(0, i): r for i, r in enumerate(rows)}
    assert time.time() - t < 30


def test_quotes_that_open_nothing(spark, tmp_path):
    (tmp_path / "f.csv").write_text('5" pipe,b\nc,d"\n"e" x,f\ng,"open\nto the,end', newline="")
    got = grid_of(spark, tmp_path)
    assert got[0, 0] == ['5" pipe', "b"] and got[0, 1] == ["c", 'd"'] and got[0, 2] == ["e", "f"] and len(got) == 4


def test_line_ends(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b\r\n"c\r\nd",e\r\n', newline="")
    assert grid_of(spark, tmp_path) == {(0, 0): ["a", "b"], (0, 1): ["c\r\nd", "e"]}


def test_tables_in_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n\na,b\n1,"x\n\ny"\n\n\nc\n2\n\n')
    (tmp_path / "b.csv").write_text("d\n")
    (tmp_path / "c.csv").write_text("\n\n")
    (tmp_path / "d.csv").write_text("e\n\nf\n")
    got = grid_of(spark, tmp_path, table_break="^$")
    assert got == {(0, 0): ["a", "b"], (0, 1): ["1", "x\n\ny"], (1, 0): ["c"], (1, 1): ["2"], (2, 0): ["d"], (3, 0): ["e"], (4, 0): ["f"]}
    assert len({r.table_id for r in read_grid(spark, str(tmp_path)).collect()}) == 4
    named = tmp_path / "named"
    named.mkdir()
    (named / "w.csv").write_text("[one]\na\n[two]\nb\nc\n")
    assert grid_of(spark, named, table_break=r"^\[.*\]$") == {(0, 0): ["a"], (1, 0): ["b"], (1, 1): ["c"]}


def test_other_formats_keep_cells(spark, tmp_path):
    spark.createDataFrame([(["a", "b"],), (["", ""],), (["c"],)], "cells array<string>").coalesce(1).write.parquet(str(tmp_path / "p"))
    assert grid_of(spark, tmp_path / "p", fmt="parquet", table_break="^,$") == {(0, 0): ["a", "b"], (1, 0): ["c"]}


def test_no_shuffle_of_single_lines(spark, tmp_path):
    """Lines that are records of their own go to the result without a grouping."""
    (tmp_path / "f.csv").write_text("".join(f"{i},x\n" for i in range(50)))
    plan = csv_records(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("collect_list") == 1
