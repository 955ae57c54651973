"""Record shaping: carried headings, line records, reset sectioning, unpivot.

All ordered operators use two-level scans (a window per key and bucket, then one
summary row per bucket carried across buckets), so one very long document or one very
active user is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.text import extract, is_digits, to_int
from gridweave.operators.scan import carry_last


def carry_forward(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str] | str,
    is_heading: Column,
    label: Column,
    bucket: Column | str,
    out: str = "label",
    null_sets: bool = False,
) -> DataFrame:
    """Carry each heading's label to the lines below it.

    Heading rows emit nothing; lines before the first heading get null. A heading whose
    label is null keeps the previous label, unless ``null_sets`` (a ``dt`` without text
    resets the label to null).
    """
    sets = is_heading if null_sets else (is_heading & label.isNotNull())
    carried = carry_last(df, keys, order, F.when(sets, F.struct(label.alias("v"))), "__lab", bucket)
    return carried.where(~F.coalesce(is_heading, F.lit(False))).withColumn(out, F.col("__lab.v")).drop("__lab")


def lines_to_records(df: DataFrame, text: str, patterns: dict[str, tuple[str, int]]) -> DataFrame:
    """A line becomes a record when at least one pattern hits; the other fields are ''."""
    tmp = {f"__p_{k}": extract(text, rx, g) for k, (rx, g) in patterns.items()}
    out = df.withColumns(tmp)
    any_hit = F.lit(False)
    for c in tmp:
        any_hit = any_hit | F.col(c).isNotNull()
    out = out.where(any_hit)
    return out.withColumns({k: F.coalesce(F.col(f"__p_{k}"), F.lit("")) for k in patterns}).drop(*tmp)


def sections_by_reset(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str] | str,
    no: str,
    levels: Sequence[str],
    bucket: Column,
    first: int = 100,
    out: str = "level",
) -> DataFrame:
    """Serial-number reset sectioning.

    Rows whose number is not all digits are dropped first. A number strictly smaller
    than the previous kept number (initially ``first``) opens the next section, named by
    ``levels`` in order; rows before the first section get a null level; once the levels
    are used up, that row and every later row of the partition are dropped.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    kept = df.where(is_digits(F.col(no))).withColumn("__n", to_int(F.col(no))).withColumn("__b", bucket)
    # One ordered pass: resets inside each (keys, bucket) from the previous row's number;
    # the first row of a bucket compares with the previous bucket's last number, which
    # the one-row-per-bucket summary supplies along with the resets before the bucket.
    part = [*keys, "__b"]
    w = Window.partitionBy(*part).orderBy(*order)
    prev = F.lag("__n").over(w)
    kept = kept.withColumn("__r", F.when(prev.isNotNull() & (F.col("__n") < prev), 1).otherwise(0))
    kept = kept.withColumn("__c", F.sum("__r").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordkey = F.struct(*[F.col(c) for c in order])
    summ = kept.groupBy(*part).agg(
        F.min_by("__n", ordkey).alias("__first_n"),
        F.max_by("__n", ordkey).alias("__last_n"),
        F.sum("__r").alias("__inner"),
    )
    wb = Window.partitionBy(*keys).orderBy("__b")
    prev_last = F.coalesce(F.lag("__last_n").over(wb), F.lit(first))
    summ = summ.withColumn("__first_r", F.when(F.col("__first_n") < prev_last, 1).otherwise(0))
    summ = summ.withColumn(
        "__before",
        F.coalesce(F.sum(F.col("__inner") + F.col("__first_r")).over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    kept = kept.join(summ.select(*part, "__first_r", "__before"), part, "left")
    kept = kept.withColumn("__sec", F.col("__before") + F.col("__first_r") + F.col("__c"))
    lv = F.array(*[F.lit(x) for x in levels])
    return (
        kept.where(F.col("__sec") <= F.lit(len(levels)))
        .withColumn(out, F.when(F.col("__sec") > 0, F.get(lv, (F.col("__sec") - 1).cast("int"))))
        .withColumn("section", F.col("__sec").cast("bigint"))
        .drop("__n", "__b", "__r", "__c", "__first_r", "__before", "__sec")
    )


def label_from_description(
    records: DataFrame, descriptions: DataFrame, regex: str, group: int, out: str
) -> DataFrame:
    """Label records by a pattern in their table description; unlabelled records are
    dropped. ``records`` carry ``hdr`` (from ``map_records(keep_header=True)``)."""
    d = descriptions.select(
        "doc",
        "table_id",
        F.col("row_idx").alias("__hrow"),
        extract("description", regex, group).alias(out),
    ).where(F.col(out).isNotNull())
    r = records.withColumn("__hrow", F.col("hdr.row"))
    return r.join(d, ["doc", "table_id", "__hrow"], "inner").drop("__hrow")


def unpivot_pairs(
    df: DataFrame,
    id_cols: Sequence[str],
    pairs: Sequence[tuple[str, str]],
    names: tuple[str, str],
    order: str | None = None,
) -> DataFrame:
    """E5: repeated column pairs -> one record per pair (``pair_no`` 0-based). With
    ``order``, the first row (``order == 0``, the header row) is skipped."""
    src = df.where(F.col(order) > 0) if order else df
    arr = F.array(
        *[
            F.struct(F.lit(i).alias("pair_no"), F.col(a).alias(names[0]), F.col(b).alias(names[1]))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return src.select(*id_cols, F.inline(arr))


def explode_names(df: DataFrame, id_cols: Sequence[str], scalar: str, items: str, out: str = "name") -> DataFrame:
    """A value that is either one name or a list of names -> one record per name."""
    arr = F.coalesce(F.col(items), F.array(F.col(scalar)))
    return df.select(*id_cols, F.posexplode(arr).alias("name_pos", out))


def to_items(df: DataFrame, url: str, fields: Sequence[str]) -> DataFrame:
    """The item envelope ``(url, data_item MAP<STRING,STRING>)``."""
    return df.select(
        F.col(url).alias("url"),
        F.map_from_arrays(
            F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields])
        ).alias("data_item"),
    )
