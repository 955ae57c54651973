"""File sinks (K2-K4, A2): keyed CSV, keyed JSON lists, URL counts, fan-out.

Every writer partitions by the routing key, so each key's output is written by many
tasks in parallel and re-running a job replaces exactly the keys it produces
(dynamic partition overwrite) - the same result after a retry or a lost executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Re-writing replaces exactly the keys that are written.
REPLACE_KEYS = {"partitionOverwriteMode": "dynamic"}


def write_csv(records: DataFrame, path: str, columns: Sequence[str], key: str = "key", bom: bool = False) -> None:
    """K2: one CSV folder per key, header = the record columns (fixed per rule set),
    UTF-8; existing output of the same keys is replaced. ``bom`` starts each header with
    a byte-order mark, as spreadsheet tools expect (the reference writes one)."""
    cols = [F.col(c).alias(("\ufeff" + c) if (bom and i == 0) else c) for i, c in enumerate(columns)]
    (
        records.select(*cols, key)
        .write.mode("overwrite")
        .options(**REPLACE_KEYS)
        .partitionBy(key)
        .option("header", True)
        .option("encoding", "UTF-8")
        # values exactly as they are: spaces kept, quotes doubled
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("escape", '"')
        .csv(path)
    )


def write_json_list(items: DataFrame, path: str, order: Sequence[str], key: str = "key") -> None:
    """K3: per key, the items' records as JSON objects (non-ASCII kept) with ``seq``
    = the item's position in arrival order; readers list newest first by sorting on
    ``seq`` descending. A key's previous list is cleared by the overwrite."""
    (
        items.select(
            F.struct(*[F.col(c) for c in order]).alias("seq"),
            F.to_json("data_item").alias("record"),
            key,
        )
        .write.mode("overwrite")
        .options(**REPLACE_KEYS)
        .partitionBy(key)
        .json(path)
    )


def read_json_list(spark: SparkSession, path: str, key_value: str) -> DataFrame:
    """Read one key's list back, newest first."""
    df = spark.read.json(path).where(F.col("key") == key_value)
    return df.orderBy(F.col("seq").desc()).select("record")


def write_url_counts(counts: DataFrame, path: str) -> None:
    """A2: counts filed under their run key (``urls_<key>``) as JSON lines url -> n."""
    counts.select("key", "url", "n").write.mode("overwrite").options(**REPLACE_KEYS).partitionBy("key").json(path)


# What rule files call the sinks of keyed lists and of CSV files.
LIST_SINKS, CSV_SINKS = ("redis", "json"), ("csv",)


def write_all(
    items: DataFrame, routed: DataFrame, base: str, columns: Sequence[str], order: Sequence[str], writers: dict | None = None
) -> None:
    """K4: fan every item out to the keyed lists, the CSV files and the URL counts, in that
    order, computing the routed items once (persisted, spilling to disk).

    Each sink named in ``routed`` gets its own folder ``<base>/<sink>``; lists and CSV are
    known, ``writers`` (sink -> function of the rows and a path) adds others, and a sink
    that nothing knows is an error rather than dropped. Counts take every item with a URL;
    the run key is the first list key.
    """
    from gridweave.operators.aggregates import url_counts_keyed

    known = dict.fromkeys(LIST_SINKS, lambda rows, path: write_json_list(rows, path, order))
    known |= dict.fromkeys(CSV_SINKS, lambda rows, path: write_csv(rows, path, columns)) | (writers or {})
    routed = routed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sinks = {r["sink"] for r in routed.select("sink").distinct().collect()}  # configuration: a few names
        if unknown := sorted(sinks - known.keys()):
            raise ValueError(f"no writer for sinks {unknown}")
        for sink in sorted(sinks, key=list(known).index):
            known[sink](routed.where(F.col("sink") == sink), f"{base}/{sink}")
        keys = routed.where(F.col("sink").isin(*LIST_SINKS)).groupBy(*order).agg(F.min("key").alias("key"))
        counted = items.select("url", *order).join(keys, list(order), "left")
        write_url_counts(url_counts_keyed(counted, list(order)), f"{base}/counts")
    finally:
        routed.unpersist()
