"""Ordered scans that stay parallel inside one hot partition key.

A plain ``Window.partitionBy(doc).orderBy(pos)`` puts every row of a document into one
task. When one document (a workbook, a giant table, one user's events) holds a large
share of all rows that task becomes the job. The helpers here compute the same
prefix quantities in two levels:

1. inside ``(keys, bucket)`` with an ordinary window (bucket = a coarse, monotone
   function of the order, e.g. ``row_idx div 65536``), and
2. across buckets from a one-row-per-bucket summary, with a window over the
   summary (``#rows / bucket_size`` rows per key), joined back on ``(keys, bucket)``.

The join back is on the bucket key, which splits a hot document evenly, and the big
side keeps the partitioning of step 1, so only the summary side moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.session import cut_lineage

DEFAULT_BUCKET_ROWS = 1 << 16

_B = "__bucket"


def _cols(names: Sequence[str] | str) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def row_bucket(order_col: str, size: int = DEFAULT_BUCKET_ROWS) -> Column:
    """Bucket for a dense integer order column such as ``row_idx`` or ``turn``."""
    return F.floor(F.col(order_col) / F.lit(size))


def _with_bucket(df: DataFrame, bucket: Column | str) -> tuple[DataFrame, str, bool]:
    if isinstance(bucket, str):
        return df, bucket, False
    return df.withColumn(_B, bucket), _B, True


def ranged_buckets(df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str, out: str = "__range") -> DataFrame:
    """``df`` with a bucket column for the scans below, from the data: rows are dealt into
    ranges of (keys, order) and the range's number is the bucket. However the keys are
    spread, there are at most as many (key, bucket) pairs as keys and ranges together, and
    a key with many rows covers many ranges. Written once, as a range's bounds are
    sampled and must not differ between two readings."""
    ranged = df.repartitionByRange(*[F.col(c) for c in [*_cols(keys), *_cols(order)]])
    return cut_lineage(ranged.withColumn(out, F.spark_partition_id()))


def carry_last(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str] | str,
    value: Column,
    out: str,
    bucket: Column | str,
    inclusive: bool = True,
) -> DataFrame:
    """Add ``out`` = last non-null ``value`` over rows with the same ``keys`` and an
    order at or before this row (``inclusive=False``: strictly before).

    ``bucket`` (a Column, or the name of an existing column, which is then kept so a
    following scan reuses the partitioning) must be non-decreasing in ``order`` within
    ``keys``. To carry a null as a real value, wrap it in a struct.
    """
    keys, order = _cols(keys), _cols(order)
    v = "__v"
    base, b, added = _with_bucket(df, bucket)
    base = base.withColumn(v, value)
    hi = 0 if inclusive else -1
    part = Window.partitionBy(*keys, b).orderBy(*order)
    local = base.withColumn("__local", F.last(v, ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, hi)))
    # One row per bucket: its last non-null value. An aggregate over the same input
    # (same hash partitioning, so the exchange is shared) rather than over the windowed
    # rows, so the window itself runs once.
    ordkey = F.struct(*[F.col(o) for o in order])
    # every bucket gets a summary row (it must receive an incoming value even when it
    # has no value of its own); only non-null values compete for "last"
    summary = base.groupBy(*keys, b).agg(
        F.max_by(F.col(v), F.when(F.col(v).isNotNull(), ordkey)).alias("__blast")
    )
    w_b = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(*keys, b, F.last("__blast", ignorenulls=True).over(w_b).alias("__incoming"))
    joined = local.join(summary, on=[*keys, b], how="left")
    res = joined.withColumn(out, F.coalesce(F.col("__local"), F.col("__incoming"))).drop(
        "__local", "__incoming", v
    )
    return res.drop(_B) if added else res


def running_sum(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str] | str,
    value: Column,
    out: str,
    bucket: Column | str,
) -> DataFrame:
    """Add ``out`` = sum of ``value`` over rows with the same ``keys`` up to and including
    this row in ``order``; two-level like :func:`carry_last`."""
    keys, order = _cols(keys), _cols(order)
    v = "__v"
    base, b, added = _with_bucket(df, bucket)
    base = base.withColumn(v, F.coalesce(value, F.lit(0)))
    w_local = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumn("__local", F.sum(v).over(w_local))
    summary = base.groupBy(*keys, b).agg(F.sum(v).alias("__btotal"))
    w_b = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        *keys, b, F.coalesce(F.sum("__btotal").over(w_b), F.lit(0)).alias("__incoming")
    )
    joined = local.join(summary, on=[*keys, b], how="left")
    res = joined.withColumn(out, F.col("__local") + F.col("__incoming")).drop("__local", "__incoming", v)
    return res.drop(_B) if added else res
