import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["doc", "table_id", "row_idx"]
    assert df.count() > 0


def test_every_query_has_an_oracle_and_plans(spark):
    from gridweave.plans.catalog import QUERIES

    qs, ors = dict(QUERIES), E.oracle_sql()
    assert set(qs) <= set(ors)
    for name in ["extract_links", "frontier_reach", "serial_sections", "rowspan_fill"]:
        assert qs[name](spark, SF).count() >= 0
