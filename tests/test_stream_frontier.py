"""The rule-driven job as a stream against the batch job over the same pages."""

from __future__ import annotations

import time

import pytest

from gridweave.operators.job import run_rules
from gridweave.sources.rules import read_rules
from gridweave.streaming.frontier import CLAIM, RuleStream, frontier_stream
from gridweave.streaming.stream import PAGES_SCHEMA
from test_job import PAGES, XML


@pytest.fixture
def case(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "s.xml").write_text(XML)
    pages = [(i, u, f"<html><body>{h}</body></html>") for i, (u, h) in enumerate(PAGES.items())]
    # a rowspan, which the stream must fill as the batch does
    span = "<table><tr><td>name<td>age<td>city<tr><td rowspan=2>dee<td>5<td>q<tr><td>6<td>r</table>"
    pages.append((50, "http://s.org/d%201", f"<body>{span}</body>"))
    redirects = spark.createDataFrame([("http://s.org/d2", "http://s.org/moved")], "from_url string, to_url string")
    return pages, read_rules(spark, str(tmp_path / "r")), redirects


def items_of(df):
    return sorted((r.url, r.page_id, r.table_id, r.row_idx, r.output_id, tuple(sorted(r.data_item.items()))) for r in df.collect())


def test_stream_equals_batch(spark, tmp_path, case):
    pages, (steps, rules, outputs), redirects = case
    frame = lambda rows: spark.createDataFrame(rows, PAGES_SCHEMA)
    batch = run_rules(frame(pages), steps, rules, outputs, redirects)
    drops = str(tmp_path / "drops")
    stream = RuleStream.of_rules(spark, drops, str(tmp_path / "out"), steps, rules, redirects)
    # deepest pages first, so that they wait in the state; then, after a stop, the rest
    frame(pages[4:]).coalesce(1).write.parquet(drops + "/drop=1")
    stream.drain()
    assert stream.items().count() == 0 and [r.url for r in stream.frontier().collect()] == ["http://s.org/"]
    frame(pages[:4]).coalesce(1).write.parquet(drops + "/drop=2")
    stream.drain()
    assert sorted(map(tuple, stream.frontier().collect())) == sorted(map(tuple, batch.frontier.collect()))
    assert items_of(stream.items()) == items_of(batch.items) and stream.items().count() == 5
    # nothing new: nothing is written twice
    stream.drain()
    assert items_of(stream.items()) == items_of(batch.items)
    # a page fetched again for a claimed URL passes at once
    frame([(90, *pages[4][1:])]).write.parquet(drops + "/drop=3")
    stream.drain()
    assert {r.page_id for r in stream.items().where("page_id = 90").collect()} == {90}


def streams(spark, tmp_path, hold):
    """A page writer, a claim writer, and the stream over both with its output."""
    drops, claims, out = (str(tmp_path / x) for x in ("p", "c", "o"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    page = lambda i, u: spark.createDataFrame([(i, u, "h")], PAGES_SCHEMA).write.parquet(f"{drops}/{i}")
    claim = lambda k, *rows: spark.createDataFrame(list(rows), CLAIM).write.parquet(f"{claims}/{k}")

    def writer():
        read = lambda schema, path: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)
        rows = frontier_stream(read(PAGES_SCHEMA, drops), read(CLAIM, claims), hold)
        return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-ckpt")

    seen = lambda: sorted((r.url, r.step_id, r.page_id) for r in spark.read.schema("url string, step_id string, page_id bigint").parquet(out).where("page_id is not null").collect())
    return page, claim, writer, seen


def test_first_claim_stays(spark, tmp_path):
    page, claim, writer, seen = streams(spark, tmp_path, None)
    run = lambda: writer().trigger(availableNow=True).start().awaitTermination(60) and seen()
    page(1, "late"), page(2, "early"), page(3, "both")
    claim(0, ("early", "a"), ("both", "a"), ("both", "b"), (None, "a"), ("x", None))
    assert run() == [("both", "b", 3), ("early", "a", 2)]
    claim(1, ("late", "z"), ("early", "zz"))
    page(5, "early")
    assert run() == [("both", "b", 3), ("early", "a", 2), ("early", "a", 5), ("late", "z", 1)]


def test_held_pages_expire(spark, tmp_path):
    page, claim, writer, seen = streams(spark, tmp_path, 500)
    page(1, "late"), page(2, "early")
    claim(0, ("early", "a"))
    q = writer().trigger(processingTime="1 second").start()
    try:
        wait = lambda want: [time.sleep(1) for _ in range(60) if seen_or_none(seen) != want] and None
        wait([("early", "a", 2)])
        time.sleep(6)  # the timer of the page that nothing claims fires
        claim(1, ("late", "z"), ("new", "z"))
        page(3, "new")
        wait([("early", "a", 2), ("new", "z", 3)])
        assert seen() == [("early", "a", 2), ("new", "z", 3)]
    finally:
        q.stop()


def seen_or_none(seen):
    try:
        return seen()
    except Exception:  # no output folder yet
        return None
