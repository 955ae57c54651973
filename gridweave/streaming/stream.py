"""Structured Streaming variants.

The reference handles items one at a time as pages arrive and keeps URL counts until
shutdown. Here pages arrive as files; each micro-batch is a DataFrame and runs the
same batch operators, because a page (one input row) is a whole document.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.session import checkpoint_dir, intermediates

PAGES_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    """Per-query checkpoint location inside the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "streams", name)


def read_pages_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(PAGES_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def keyed_batch_writer(out_path: str, transform, key: str | None = None):
    """A ``foreachBatch`` function writing each micro-batch under its batch id
    (overwrite), so a replayed batch replaces its own output and nothing else."""

    def write(batch: DataFrame, batch_id: int) -> None:
        with intermediates(batch.sparkSession):
            w = transform(batch).write.mode("overwrite")
            if key:
                w = w.partitionBy(key)
            w.parquet(os.path.join(out_path, f"batch_id={batch_id}"))

    return write


def map_pages_stream(pages: DataFrame, rules: DataFrame, out_path: str, name: str = "map_pages"):
    """New pages -> HTML tables, rowspans filled -> mapped records, written per
    micro-batch: what the batch job makes of the same pages."""
    from gridweave.operators.mapping import map_records
    from gridweave.operators.pages import fill_rowspan, html_tables

    def transform(batch: DataFrame) -> DataFrame:
        return map_records(fill_rowspan(html_tables(batch)), rules)

    spark = pages.sparkSession
    return (
        pages.writeStream.foreachBatch(keyed_batch_writer(out_path, transform))
        .option("checkpointLocation", stream_checkpoint(spark, name))
    )


def running_url_counts(items: DataFrame) -> DataFrame:
    """R2: records per URL, kept as streaming state (``complete``/``update`` output)."""
    from gridweave.operators.aggregates import url_counts

    return url_counts(items)


def drop_seen_urls(pages: DataFrame, arrival: str | None = None, delay: str | None = None) -> DataFrame:
    """Each URL once; the state holds every URL seen. With an arrival-time column and a
    ``delay`` (say ``"1 hour"``) the state is bounded instead, at a price: a URL that comes
    again later than that after its first arrival passes again."""
    if (arrival is None) != (delay is None):
        raise ValueError("give arrival and delay together")
    if arrival:
        return pages.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(["url"])
    return pages.dropDuplicates(["url"])
