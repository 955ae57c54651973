"""Token ids in bit- or byte-plane files.

Texts go in ascending ``doc_id`` order to partitions (a range shuffle), are encoded there
and laid end to end, each document closed by the end id. The ids are cut into fixed blocks
of ``BLOCK``; a block is transposed into planes (byte planes by default: all first bytes,
all second bytes, ...; or 32 bit planes), each compressed with zstandard on its own, planes
of zeros left empty. Files are Parquet tables written by Spark, so that a lost task leaves
nothing behind and any store that Spark reaches will do: ``chunks`` (part, chunk, first, n,
the documents that overlap it, planes), and the chunk index ``index`` (part, chunk, n,
``start`` among all ids, first and last id of a document) for finding ids without
touching a plane. Every chunk can be read on its own.

Defined results: a null or empty text is the end id alone; rows with one ``doc_id`` come in
the order of their text's hash, a null id first, and each keeps its own row; an empty table gives empty files;
other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.llm.common import checkpoint_dir, text_or_empty
from gridweave.llm.tokenization import encoder

END, BLOCK, LEVEL = 2, 65_536, 3

_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64())]))
_CHUNK = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("docs", _DOCS), ("planes", pa.list_(pa.binary()))])
CHUNK_DDL = "part int, chunk int, first bigint, n bigint, docs array<struct<doc_id:bigint,first:bigint,n:bigint>>, planes array<binary>"


def to_planes(ids: np.ndarray, bits: bool = False, level: int = LEVEL) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1) if bits else np.ascontiguousarray(raw.T)
    press = zstandard.ZstdCompressor(level=level)
    return [press.compress(r.tobytes()) if r.any() else b"" for r in rows]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    bits = len(planes) == 32
    size = -(-n // 8) if bits else n
    open_ = zstandard.ZstdDecompressor()
    rows = np.stack([np.frombuffer(open_.decompress(p, max_output_size=size), np.uint8) if p else np.zeros(size, np.uint8) for p in planes])
    raw = np.packbits(np.unpackbits(rows, axis=1, count=n).T, axis=1, bitorder="little") if bits else rows.T
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def write_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = END, block: int = BLOCK, bits: bool = False, path: str | None = None) -> str:
    """Write the token files of ``docs(doc_id, text)`` and return their folder."""
    spark = docs.sparkSession
    path = path or os.path.join(checkpoint_dir(spark), f"gw-tokens-{uuid.uuid4().hex}")

    def chunks(batches):
        part, chunk, first, where = TaskContext.get().partitionId(), 0, 0, 0
        held, have, over = [], 0, []

        def emit(n):
            nonlocal chunk, first, have, over
            got, need = [], n
            while need:
                got.append(held[0][:need])
                need -= len(got[-1])
                held[0] = held[0][len(got[-1]) :]
                if not len(held[0]):
                    held.pop(0)
            row = {"part": part, "chunk": chunk, "first": first, "n": n, "docs": [dict(zip(("doc_id", "first", "n"), d)) for d in over], "planes": to_planes(np.concatenate(got), bits)}
            have -= n
            chunk, first = chunk + 1, first + n
            over = [d for d in over if d[1] + d[2] > first]
            return row

        for b in batches:
            rows = []
            for lo in range(0, b.num_rows, 256):  # bounds what is encoded but not yet written
                some = b.slice(lo, 256)
                for d, ids in zip(some.column("doc_id").to_pylist(), encoder(tokenizer).encode(some.column("text").to_pylist())):
                    held.append(np.append(ids, np.uint32(end)))
                    over.append((d, where, len(ids) + 1))
                    where, have = where + len(ids) + 1, have + len(ids) + 1
                    while have >= block:
                        # documents that begin after a chunk's end belong to later chunks
                        later = [x for x in over if x[1] >= first + block]
                        over = [x for x in over if x[1] < first + block]
                        rows.append(emit(block))
                        over += later
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _CHUNK)
        if have:
            yield pa.RecordBatch.from_pylist([emit(have)], _CHUNK)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    # planes are compressed already
    ordered.mapInArrow(chunks, CHUNK_DDL).write.option("compression", "none").parquet(os.path.join(path, "chunks"))
    c = spark.read.parquet(os.path.join(path, "chunks"))
    parts = c.groupBy("part").agg(F.sum("n").alias("n"))  # one row per file
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    index = c.join(parts, "part").select("part", "chunk", "n", (F.col("base") + F.col("first")).alias("start"), "base", F.col("docs")[0]["doc_id"].alias("first_doc"), F.element_at("docs", -1)["doc_id"].alias("last_doc"))
    index.write.parquet(os.path.join(path, "index"))
    return path


_PART = "array<struct<doc_id:bigint,first:bigint,n:bigint,at:bigint,crc:bigint,ids:binary>>"
_PART_ARROW = pa.list_(pa.struct([("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())]))


def _open_chunks(first: pa.Array, n: pa.Array, docs: pa.Array, planes: pa.Array) -> pa.Array:
    """What a chunk holds of each document: the crc of a whole one, the ids of a part."""
    out = []
    for lo, size, over, packed in zip(first.to_pylist(), n.to_pylist(), docs.to_pylist(), planes.to_pylist()):
        raw = from_planes(packed, size).tobytes()
        rows = []
        for d in over:
            a, b = max(d["first"], lo), min(d["first"] + d["n"], lo + size)
            ids = raw[4 * (a - lo) : 4 * (b - lo)]
            whole = b - a == d["n"]
            rows.append(d | {"at": a - d["first"], "crc": zlib.crc32(ids) if whole else None, "ids": None if whole else ids})
        out.append(rows)
    return pa.array(out, _PART_ARROW)


def _crc_of_parts(parts: pa.Array) -> pa.Array:
    out = []
    for ids in parts.to_pylist():
        crc = 0
        for x in ids:
            crc = zlib.crc32(x["ids"], crc)
        out.append(crc)
    return pa.array(out, pa.int64())


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the files alone. A document
    within one chunk is summed there; the parts of one that crosses chunks meet by its place."""
    c = spark.read.parquet(os.path.join(path, "chunks"))
    base = spark.read.parquet(os.path.join(path, "index")).select("part", "base").distinct()
    rows = c.select("part", F.explode(F.arrow_udf(_open_chunks, _PART)("first", "n", "docs", "planes")).alias("d")).select("part", "d.*")
    whole = rows.where("ids is null").select("part", "doc_id", "first", "n", F.col("crc").alias("ids_crc32"))
    split = rows.where("ids is not null").groupBy("part", "doc_id", "first", "n").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("p"))
    split = split.select("part", "doc_id", "first", "n", F.arrow_udf(_crc_of_parts, "bigint")("p").alias("ids_crc32"))
    done = whole.unionByName(split).join(base, "part")
    return done.select("doc_id", (F.col("base") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")
