"""Fuzzy label matching against large label sets (X1 in M1, M3, M12 and L4) through an index.

A text can match a label only if it holds every character of it. So a label is filed under one of
its characters, the one that fewest texts hold, and a text looks under each character of its
own: an equi-join whose label side is the size of the label set, not a comparison of every
text with every label. What meets must also pass a 64-bit signature of characters
and the lengths; the exact rule decides last. The empty label matches all and is filed
under the empty string, as every text is.

The label side is written before it meets the texts. Its planned size would be a product of its
joins' sides, that of the texts the size of their compressed files, and the planner would take
the texts, one row per character, for the side to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.text import fuzzy_match
from gridweave.session import cut_lineage

#: Up to this many labels, matching is one code-generated regex per label evaluated in the
#: scan (no join); above it, a join with the index.
INLINE_LABELS = 64

#: Filed labels of up to this many bytes (as text) go to every task; more are sorted by character.
#: The texts are never broadcast.
BROADCAST_BYTES = 8_000_000


def _characters(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(.)"), 1))


def _signature(chars: Column) -> Column:
    """One bit for every character, by its number modulo 64."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.ascii(c) % 64).cast("int"))
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda a, c: a.bitwiseOR(F.when(c == "", F.lit(0).cast("bigint")).otherwise(bit(c))))


def character_counts(rows: DataFrame, text: str) -> DataFrame:
    """char, texts: how many rows hold each character; one row per character that occurs."""
    return rows.select(F.explode(_characters(F.col(text))).alias("char")).groupBy("char").agg(F.count(F.lit(1)).alias("texts"))


def index_labels(labels: DataFrame, counts: DataFrame, label: str = "label") -> DataFrame:
    """``labels`` with the character that each is filed under (``__char``) and its signature.
    Labels with a character that no text holds can match nothing and are left out."""
    texts = labels.where(F.length(label) > 0).select(F.col(label).alias("__l")).distinct().withColumn("__chars", _characters(F.col("__l")))
    rare = texts.select("__l", F.size("__chars").alias("n"), F.explode("__chars").alias("char")).join(counts, "char")
    rare = rare.groupBy("__l").agg(F.min_by("char", F.struct("texts", "char")).alias("__char"), F.count(F.lit(1)).alias("found"), F.first("n").alias("n"))
    filed = labels.join(rare.where("found = n").select("__l", "__char"), F.col(label) == F.col("__l")).drop("__l")
    filed = filed.unionByName(labels.where(F.length(label) == 0).withColumn("__char", F.lit("")))
    return filed.withColumn("__lsig", _signature(_characters(F.col(label))))


def match_labels(rows: DataFrame, labels: DataFrame, text: str = "cell", label: str = "label") -> DataFrame:
    """Rows joined with every label that matches their ``text``: the columns of both (``labels``
    must not share a name with ``rows``). Each pair comes once, as a label is filed once.
    The labels, their index and the counts of characters are written when this is called."""
    counts = cut_lineage(character_counts(rows, text))
    filed = cut_lineage(index_labels(cut_lineage(labels), counts, label))
    size = filed.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    filed = F.broadcast(filed) if size <= BROADCAST_BYTES else filed.hint("merge")
    keys = _characters(F.col(text))
    looked = rows.where(F.col(text).isNotNull()).withColumn("__tsig", _signature(keys)).withColumn("__key", F.explode(F.concat(keys, F.array(F.lit("")))))
    fits = (F.col("__lsig").bitwiseAND(F.bitwise_not("__tsig")) == 0) & (F.length(label) <= F.length(text))
    met = looked.join(filed, F.col("__key") == F.col("__char")).where(fits)
    return met.where(fuzzy_match(F.col(text), F.col(label))).drop("__key", "__char", "__tsig", "__lsig")
