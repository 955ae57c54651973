"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import gridweave
from gridweave.session import checkpoint_dir, cut_lineage, table_path

#: Fixed values of the contract: what separates words.
WORD_BREAK = r"[\x20\x09-\x0D]+"

__all__ = ["WORD_BREAK", "checkpoint_dir", "cut_lineage", "read", "remainder", "ship", "text_or_empty", "words"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def ship(spark: SparkSession) -> None:
    """Give the executors this package (like ``--py-files``), once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_gridweave_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(gridweave.__path__[0]))
    out = os.path.join(tempfile.mkdtemp(prefix="gridweave-py-"), "gridweave.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "gridweave")):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(out)
    sc._gridweave_shipped = True


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text: maximal runs of characters that are no white space."""
    return F.array_remove(F.split(text, WORD_BREAK), "")


def remainder(key: str, n: int) -> Column:
    """crc32 of the key written as text, modulo n; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n
