"""The rule-driven job as a stream (R1 with L6, L7, L9, L10): pages arrive in any order.

Two file streams meet in one state keyed by URL: *pages* as they are fetched and *claims*, a
step that wants a URL. The state of a URL is the step that claimed it and, until one does, the
pages held back for it (dropped by a timer after ``hold_ms``, if given). A claimed page leaves
the state once; its micro-batch extracts its links, tests them against its step's conditions, maps
its tables by its step's rules, and writes the links' targets as further claims into the folder
that the stream reads. The walk thus goes on from micro-batch to micro-batch, and only
new URLs are ever looked at; state lives in RocksDB on the executors and in the checkpoint
folder, partitioned by URL.

The first claim of a URL stays; of several in one micro-batch the greatest step. So the result is
that of the batch job whenever the claims of a URL agree or come together. Everything is
written per micro-batch under its id, so a micro-batch run again replaces its own output;
claims read twice change nothing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridweave.operators.frontier import assign_steps
from gridweave.operators.job import claimed_records, conditions_of, root_seeds
from gridweave.operators.selectors import placed_links
from gridweave.session import cut_lineage, intermediates
from gridweave.streaming.stream import PAGES_SCHEMA

CLAIM = "url string, step_id string"
#: One row per new claim of a URL (without a page) and per page of a claimed URL.
OUT = "url string, step_id string, page_id bigint, html string"


def url_state(hold_ms: int | None = None) -> StatefulProcessor:
    """The state of one URL. The class is made here, so that it travels to the Python runners by
    value: the driver's runner of stateful functions has no shipped files."""

    class Frontier(StatefulProcessor):
        """The state of one URL: its step, or the pages that wait for one."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.step = handle.getValueState("step", "step_id string")
            self.held = handle.getListState("held", "page_id bigint, html string")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            pages, steps = [], []
            for part in rows:
                for step, page, html, is_claim in zip(part["step_id"], part["page_id"], part["html"], part["is_claim"]):
                    if is_claim:
                        steps.append(step)
                    else:
                        pages.append((None if pd.isna(page) else int(page), html))
            out = []
            if self.step.exists():
                step = self.step.get()[0]
            elif steps:
                step = max(steps)
                self.step.update((step,))
                out.append((key[0], step, None, None))
                pages = [tuple(p) for p in self.held.get()] + pages if self.held.exists() else pages
                self.held.clear()
            else:
                self.held.appendList(pages)
                if hold_ms is not None:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + hold_ms)
                return
            out += [(key[0], step, p, h) for p, h in pages]
            if out:
                frame = pd.DataFrame(out, columns=["url", "step_id", "page_id", "html"])
                yield frame.astype({"page_id": "Int64"})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.held.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Frontier()


def frontier_stream(pages: DataFrame, claims: DataFrame, hold_ms: int | None = None) -> DataFrame:
    """url, step_id, page_id, html of claims and claimed pages (see ``OUT``) from streams of pages
    (page_id, url, html) and claims (url, step_id)."""
    none = lambda kind: F.lit(None).cast(kind)
    a = pages.where(F.col("url").isNotNull()).select("url", none("string").alias("step_id"), "page_id", "html", F.lit(False).alias("is_claim"))
    b = claims.where(F.col("url").isNotNull() & F.col("step_id").isNotNull()).select("url", "step_id", none("bigint").alias("page_id"), none("string").alias("html"), F.lit(True).alias("is_claim"))
    both = a.unionByName(b).groupBy("url")
    return both.transformWithStateInPandas(url_state(hold_ms), OUT, "append", "ProcessingTime" if hold_ms is not None else "None")


class RuleStream:
    """The job over a folder of page drops; its outputs lie under ``base``: ``claims``,
    ``frontier`` (url, step_id) and ``items`` (url, page_id, table_id, row_idx, output_id,
    data_item)."""

    def __init__(self, spark: SparkSession, drops: str, base: str, conditions: DataFrame, seeds: DataFrame, claim_rows=None, redirects: DataFrame | None = None, hold_ms: int | None = None):
        self.spark, self.drops, self.base, self.conditions = spark, drops, base, conditions
        self.claim_rows, self.redirects, self.hold_ms = claim_rows, redirects, hold_ms
        seeds.select("url", "step_id").write.mode("overwrite").parquet(os.path.join(base, "claims", "batch_id=seeds"))

    @classmethod
    def of_rules(cls, spark: SparkSession, drops: str, base: str, steps: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, hold_ms: int | None = None) -> RuleStream:
        """The stream of one rule set, as :func:`gridweave.operators.job.run_rules` takes it."""
        records = claimed_records(steps, rules)
        return cls(spark, drops, base, conditions_of(steps), root_seeds(steps), records, redirects, hold_ms)

    def _path(self, kind: str, batch_id: int | None = None) -> str:
        return os.path.join(self.base, kind, *([] if batch_id is None else [f"batch_id={batch_id}"]))

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        with intermediates(batch.sparkSession):
            rows = cut_lineage(batch)
            claimed = rows.where("page_id is null").select("url", "step_id")
            claimed.write.mode("overwrite").parquet(self._path("frontier", batch_id))
            pages = rows.where("page_id is not null")
            links = placed_links(pages.select("page_id", "url", "html"))
            found = assign_steps(pages.select("url", "step_id").distinct(), links, self.conditions)
            if self.redirects is not None:
                alias = claimed.join(self.redirects, claimed.url == self.redirects.from_url).select(F.col("to_url").alias("url"), "step_id")
                found = found.unionByName(alias.where(F.col("url").isNotNull()))
            if self.claim_rows is not None:
                self.claim_rows(pages).write.mode("overwrite").parquet(self._path("items", batch_id))
            found.select("url", "step_id").write.mode("overwrite").parquet(self._path("claims", batch_id))

    def query(self, checkpoint: str | None = None):
        """The writer of the stream, to be started with a trigger."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        read = lambda schema, path: self.spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)
        rows = frontier_stream(read(PAGES_SCHEMA, self.drops), read(CLAIM, self._path("claims")), self.hold_ms)
        place = checkpoint or os.path.join(self.base, "checkpoint")
        return rows.writeStream.outputMode("append").foreachBatch(self._write).option("checkpointLocation", place)

    def drain(self) -> None:
        """Run until nothing new comes: each run takes what lies there, and its claims are the
        next one's input. A service starts :meth:`query` with a processing-time trigger instead,
        and must where pages are held for a time only: timers keep such a stream running."""
        if self.hold_ms is not None:
            raise ValueError("pages held for a time need a processing-time trigger")
        before = -1
        while (known := self.frontier().count() if before >= 0 else 0) != before:
            before = known
            self.query().trigger(availableNow=True).start().awaitTermination()

    def frontier(self) -> DataFrame:
        return self.spark.read.schema(CLAIM).option("recursiveFileLookup", True).parquet(self._path("frontier"))

    def items(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", True).parquet(self._path("items"))
