"""The corpus pipeline: five stages over ``documents``, each one operator of the library.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's documents. All but the last return the columns of
``documents``; each works on all that its predecessor kept.

1. quality: documents that the classifier rejects go.
2. near duplicates: one document of each SimHash group stays, the one with the smallest id.
3. pii: every span of personal data is replaced by its kind.
4. mix: documents are repeated, cut or left out so that sources come near their targets.
5. pack: pieces of at most 2,048 tokens in sequences; one row per piece.

Defined results: a null text counts as empty in every stage (as empty in quality's score, fingerprint
zero, no words to mix, one end token packed); rows without a ``doc_id`` are scored and kept like
others, and never learned from; rows equal in ``doc_id`` and text are one row after near
duplicates, of ties the one with the smallest source; very long texts are read whole; an empty
table gives an empty result; columns other than those of ``documents`` are dropped at the start.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.llm import mixing, packing, pii, quality_mil, simhash_ball
from gridweave.llm.common import checkpoint_dir, read, ship, text_or_empty

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = read(spark, sf_dir, "labels").where(~quality_mil.held_out())
    model = quality_mil.fit(docs, labels)
    return quality_mil.score_documents(docs.select(*COLUMNS), model, "__score").where(F.col("__score") >= THRESHOLD).drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    kept = simhash_ball.keepers(docs)
    rows = docs.select(*COLUMNS).withColumn("__h", F.xxhash64(text_or_empty()))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["keep_id"]) & (rows["__h"] == kept["keep_hash"]))
    # rows that agree in id and text: one of them
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id", "__h").orderBy("source"))).where("__k = 1").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pii.mask_pii(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", personal_data), ("mix", mix), ("pack", pack)]

#: No stage's rows can be told in SQL alone (a trained model, graph components, a tokenizer);
#: tests/llm/test_pipeline.py compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = os.path.join(checkpoint_dir(spark), f"gw-pipeline-{uuid.uuid4().hex}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
