"""Records per source URL (A1, A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def url_counts(items: DataFrame) -> DataFrame:
    """A1: number of items per source URL (partial + final hash aggregate). Items
    without a URL are not counted."""
    return items.where(F.col("url").isNotNull()).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


def url_counts_keyed(items: DataFrame, order: list[str]) -> DataFrame:
    """A2: counts filed under ``urls_<key>``, where ``key`` is the JSON-list key of the
    first item (by ``order``) that has one, fixed for the run; items are counted from that
    one on, those routed elsewhere too. Nothing is counted when no item has a key, or when
    that key is blank.

    Items need columns url, key (their JSON-list key, may be null) and ``order``. The
    run key is one global min-by aggregate; the counts stay distributed (one row per
    URL) instead of one JSON object built in one task; :func:`gridweave.sinks.files.write_url_counts`
    writes them as JSON lines under the run key.
    """
    place = F.struct(*[F.col(c) for c in order])
    first = items.where(F.col("key").isNotNull()).agg(F.min_by(F.struct("key", place.alias("at")), place).alias("f"))
    found = first.select("f").scalar()  # one-row scalar subquery
    counts = url_counts(items.where(place >= found["at"])).withColumn("run_key", found["key"])
    counts = counts.where(F.col("run_key").isNotNull() & (F.trim(F.col("run_key")) != ""))
    return counts.select(F.concat(F.lit("urls_"), F.col("run_key")).alias("key"), "url", "n")
