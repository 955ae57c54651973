"""Fetched pages: reading and routing by content type / URL postfix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.functions.urls import postfix
from gridweave.session import cut_lineage

# Document kinds recognised from a URL postfix, as postfix -> kind.
POSTFIX_KINDS = (("docx", "docx"), ("doc", "doc"), ("xls", "xls"), ("xlsx", "xls"), ("pdf", "pdf"), ("zip", "zip"))


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """pages(page_id, url, html). ``fmt='text'`` reads one file per page
    (``wholetext``), the URL being the file path."""
    if fmt == "text":
        df = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
        )
        return df.select(F.xxhash64("url").alias("page_id"), "url", "html")
    return spark.read.format(fmt).load(path).select("page_id", "url", "html")


def route_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``kind`` from the content type (``text/html`` -> html), else from the URL
    postfix; pages of unknown kind are split off as rejects."""
    pf = postfix(F.col("url"))
    by_postfix = F.lit(None).cast("string")
    for pfx, kind in reversed(POSTFIX_KINDS):
        by_postfix = F.when(pf == pfx, F.lit(kind)).otherwise(by_postfix)
    has_ct = "content_type" in pages.columns
    ctype = F.coalesce(F.col("content_type"), F.lit("")) if has_ct else F.lit("")
    kind = F.when(ctype.contains("text/html"), F.lit("html")).otherwise(by_postfix)
    x = pages.withColumn("kind", kind)
    return x.where(F.col("kind").isNotNull()), x.where(F.col("kind").isNull()).drop("kind")


# A quoted cell, doubled quotes within; a cell; and a line's end inside quotes, when the line
# begins outside them and when it begins inside. Possessive runs: no pattern backtracks.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_REST = r'[^"]*+(?:""[^"]*+)*+'
_OPENS = rf'(?:(?:{_QUOTED}[^,]*+|[^",][^,]*+|),)*+"{_REST}\z'
_OPEN_FROM_OUTSIDE = rf"\A{_OPENS}"
_OPEN_FROM_INSIDE = rf'\A(?:{_REST}\z|{_REST}"[^,]*+,{_OPENS})'


def _flips(state: Column, times: Column) -> Column:
    return F.when(times % 2 == 1, ~state).otherwise(state)


def _state_before(df: DataFrame, keys: list[str], order: str, enters: dict[str, Column]) -> DataFrame:
    """For rows that each turn a state (outside, inside quotes) into one by columns ``__fo`` and
    ``__fq`` (inside after it, having begun outside or inside), the state before every row for
    each way to enter, ``enters``. A row either sets the state, keeps or flips it, so the state is the
    last one set and the parity of flips since."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    flip, sets = (F.col("__fo") & ~F.col("__fq")).cast("int"), F.col("__fo") == F.col("__fq")
    df = df.withColumn("__n", F.coalesce(F.sum(flip).over(before), F.lit(0)))
    df = df.withColumn("__set", F.last(F.when(sets, F.struct(F.col("__fo").alias("to"), "__n")), ignorenulls=True).over(before))
    for name, enter in enters.items():
        df = df.withColumn(name, F.when(F.col("__set").isNull(), _flips(enter, F.col("__n"))).otherwise(_flips(F.col("__set.to"), F.col("__n") - F.col("__set.__n"))))
    return df.drop("__n", "__set")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files, which may go over several lines within quotes: file, rec (the
    record's number in its file), record.

    A line's start inside or outside quotes depends on all lines before it. Every line is a
    function of that state; their composition is scanned inside the reader's splits, then over one
    row per split, so a file of any size is read in parallel. Only lines of records
    with several lines, and a split's last one, are shuffled once more to be joined."""
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), "value",
        F.col("value").rlike(_OPEN_FROM_OUTSIDE).alias("__fo"), F.col("value").rlike(_OPEN_FROM_INSIDE).alias("__fq"),
    )
    part = ["file", "block"]
    x = _state_before(lines, part, "mid", {"__bo": F.lit(False), "__bq": F.lit(True)})
    own = Window.partitionBy(*part).orderBy("mid")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"__c{k}": F.sum((~F.col(f"__b{k}")).cast("bigint")).over(upto) for k in "oq"})
    x = x.withColumns({f"__next{k}": F.lead(~F.col(f"__b{k}")).over(own) for k in "oq"})
    after = lambda k: F.when(F.col(f"__b{k}"), F.col("__fq")).otherwise(F.col("__fo"))
    splits = x.groupBy(*part).agg(
        F.max_by(after("o"), "mid").alias("__fo"), F.max_by(after("q"), "mid").alias("__fq"), F.max("__co").alias("__no"), F.max("__cq").alias("__nq")
    )
    splits = _state_before(splits, ["file"], "block", {"__in": F.lit(False)})
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    count = F.when(F.col("__in"), F.col("__nq")).otherwise(F.col("__no"))
    splits = splits.select(*part, "__in", F.coalesce(F.sum(count).over(ahead), F.lit(0)).alias("__ahead"))
    x = x.join(splits, part)
    pick = lambda k: F.when(F.col("__in"), F.col(f"__{k}q")).otherwise(F.col(f"__{k}o"))
    x = x.select("file", "mid", "value", (F.col("__ahead") + pick("c") - 1).alias("rec"), (~pick("b") & F.coalesce(pick("next"), F.lit(False))).alias("alone"))
    joined = x.where(~F.col("alone")).groupBy("file", "rec").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mid", "value"))), lambda p: p["value"]), "\n").alias("record")
    )
    rows = x.where("alone").select("file", "rec", F.col("value").alias("record")).unionByName(joined)
    return rows.withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def read_grid(spark: SparkSession, path: str, fmt: str = "csv", table_break: str | None = None) -> DataFrame:
    """A file set of cell grids as (doc, table_id, row_idx, cells): doc is the file's folder,
    tables are numbered in their folder by file name and place, rows in their table.

    CSV records come headerless as ``cells ARRAY<STRING>``, cells as CSV has them: quoted cells
    keep commas, line breaks and doubled quotes (:func:`csv_records`). Other formats hold a
    ``cells`` column, one row a record, in the reader's order. A file is one table (a sheet), or,
    with ``table_break``, several: records that the pattern finds part them and belong to none
    (``r"^$"``: blank lines). Everything per row is a two-level scan by ranges of rows; only
    the numbering of files and their tables is per folder, one row a file."""
    from gridweave.operators.scan import carry_last, row_bucket, running_sum

    if fmt == "csv":
        recs = csv_records(spark, path).select("file", "rec", "record", csv_cells("record").alias("cells"))
    else:
        raw = spark.read.format(fmt).load(path)
        df = raw.select(F.col("_metadata.file_path").alias("file"), "cells", F.monotonically_increasing_id().alias("mid"))
        df = running_sum(df, "file", "mid", F.lit(1), "rank", F.floor(F.col("mid") / F.lit(1 << 33)))
        recs = df.select("file", (F.col("rank") - 1).alias("rec"), F.array_join("cells", ",").alias("record"), "cells")
    if table_break is None:
        rows = recs.select("file", F.lit(0).cast("bigint").alias("no"), F.col("rec").alias("row_idx"), "cells")
        counts = rows.select("file").distinct().withColumn("tables", F.lit(1).cast("bigint"))
    else:
        parts = F.col("record").rlike(table_break)
        x = recs.select("file", "rec", "cells", parts.alias("parts"), row_bucket("rec").alias("b"))
        x = carry_last(x, "file", "rec", F.when(F.col("parts"), F.col("rec")), "last", "b", inclusive=False)
        x = x.withColumn("row_idx", F.col("rec") - F.coalesce("last", F.lit(-1)) - 1)
        x = running_sum(x, "file", "rec", (~F.col("parts") & (F.col("row_idx") == 0)).cast("bigint"), "no", "b")
        rows = x.where(~F.col("parts")).select("file", (F.col("no") - 1).alias("no"), "row_idx", "cells")
        rows = cut_lineage(rows)
        counts = rows.groupBy("file").agg((F.max("no") + 1).alias("tables"))
    counts = counts.withColumn("doc", F.regexp_replace("file", "/[^/]*$", ""))
    earlier = Window.partitionBy("doc").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("file", "doc", F.coalesce(F.sum("tables").over(earlier), F.lit(0)).alias("base"))
    out = rows.join(counts, "file")
    return out.select("doc", (F.col("base") + F.col("no")).cast("bigint").alias("table_id"), F.col("row_idx").cast("bigint").alias("row_idx"), "cells")


def csv_cells(record) -> Column:
    """The cells of one CSV record: commas and line breaks within quotes do not part cells,
    doubled quotes are one, and white space stays."""
    record = F.col(record) if isinstance(record, str) else record
    cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_QUOTED}|[^,]*+)"), 1)
    inner = lambda c: F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(cells, lambda c: F.when((F.length(c) > 1) & c.startswith('"') & c.endswith('"'), inner(c)).otherwise(c))
