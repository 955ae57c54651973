"""Product codes for vectors by dual-tree Lloyd rounds in integers.

Every component ``x`` becomes ``floor(SCALE * x)``. Vectors are cut into ``PARTS`` consecutive
parts, each with a codebook of its own that starts as that part of the ``ENTRIES`` smallest ids.
A round assigns every part to its nearest entry (ties: the lower index) and moves each entry to
the componentwise floored mean of its parts; entries without parts stay. Tasks assign a block of
rows at a time with :mod:`gridweave.llm.dual_tree` and hand on one row of sums per part and entry,
so a round shuffles (tasks x parts x entries) small rows, whatever the number of vectors, and
only the entries' sums reach the driver. The integers are written once.

Defined results: rows whose vector is null or holds null or non-finite components are dropped;
vectors whose length is not that of the smallest kept id's vector (with equal ids, the smallest
vector) are returned with null code and error and take no part; a length that ``PARTS`` does not
divide makes the first parts one component longer; with fewer vectors than ``ENTRIES`` there are as
many entries as vectors; rows with equal ids are separate vectors (the smaller vector first), a
null id comes last; integers too large for a 64-bit error are held at the largest that is not
(for 64 components some 131 million, that is components of 524,000); null labels count as one
label; sums of errors beyond 64 bits stay at the largest; an empty table gives no rows; other
columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import cut_lineage
from gridweave.llm.dual_tree import assign

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0


def usable(vector: str) -> Column:
    e = F.col(vector)
    return F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def largest(dim: int) -> int:
    """The greatest magnitude for which a sum of ``dim`` squared differences fits 62 bits."""
    return math.isqrt((1 << 62) // max(dim, 1)) // 2


def integers(vectors: DataFrame, dim: int, vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """The usable rows with ``ints ARRAY<BIGINT>``, null for vectors of another length."""
    most = float(largest(dim))
    whole = F.transform(vector, lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-most)), F.lit(most))), F.lit(int(-most))), F.lit(int(most))).cast("bigint"))
    return vectors.withColumn("ints", F.when(F.size(vector) == dim, whole)).drop(vector)


def cuts(dim: int, parts: int) -> list[int]:
    """Where the parts begin, and the end; the first parts are the longer ones."""
    return [k * (dim // parts) + min(k, dim % parts) for k in range(parts + 1)]


def _rows(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of rows that have integers, their matrix)."""
    column = batch.column("ints")
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    return there, column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(there), dim)


def sums_of(rows: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """part, entry, n, place, total: the parts of every entry counted and added up."""
    at = cuts(dim, len(books))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            _, x = _rows(batch, dim)
            for k, book in enumerate(books):
                done = assign(x[:, at[k] : at[k + 1]], book)
                sums[k] += done.sums.astype(object)  # Python integers: no sum is too large
                counts[k] += done.counts
        out = [(k, e, int(counts[k][e]), [str(v) for v in sums[k][e]]) for k in range(len(books)) for e in np.flatnonzero(counts[k])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))], ["part", "entry", "n", "totals"]
        )

    each = rows.select("ints").mapInArrow(partial, "part int, entry int, n bigint, totals array<string>")
    flat = each.select("part", "entry", "n", F.posexplode_outer("totals").alias("place", "total"))
    return flat.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def learn(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds over all ``rows`` (vec_id, ints)."""
    first = rows.where("ints is not null").orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    start = np.array([r["ints"] for r in first], np.int64).reshape(len(first), dim)
    at = cuts(dim, parts)
    books = [start[:, at[k] : at[k + 1]].copy() for k in range(parts)]
    for _ in range(rounds if len(first) else 0):
        for r in sums_of(rows, books, dim).collect():  # at most dim * entries rows
            if r["place"] is not None:
                books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def encoder(books: list[np.ndarray], dim: int):
    """An Arrow function ints -> (code, error) under the codebooks."""
    at = cuts(dim, len(books))

    def encode(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["ints"])
        there, x = _rows(batch, dim)
        codes = np.zeros((len(there), len(books)), np.uint8 if books and len(books[0]) <= 256 else np.uint16)
        error = np.zeros(len(there), np.int64)
        for k, book in enumerate(books):
            part = x[:, at[k] : at[k + 1]]
            codes[:, k] = assign(part, book).entry if len(there) else 0
            off = part - book[codes[:, k]] if len(there) else part
            error += (off * off).sum(1)
        code, cost = [None] * len(column), [None] * len(column)
        wide = codes.astype(codes.dtype.newbyteorder(">"))
        for i, c, e in zip(there.tolist(), wide, error.tolist()):
            code[i], cost[i] = c.tobytes().hex(), e
        return pa.StructArray.from_arrays([pa.array(code, pa.string()), pa.array(cost, pa.int64())], ["code", "error"])

    return F.arrow_udf(encode, "code string, error bigint")


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' decimal components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error per kept vector; the codebooks)."""
    kept = vectors.select("vec_id", "label", "embedding").where(usable("embedding"))
    head = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding").alias("d")).first()
    dim = head["d"] if head else 0
    rows = cut_lineage(integers(kept, dim))
    books = learn(rows, dim, parts, entries, rounds)
    return rows.select("vec_id", "label", encoder(books, dim)("ints").alias("c")).select("vec_id", "label", "c.code", "c.error"), books


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every kept vector."""
    coded, books = compress(vectors)
    coded = cut_lineage(coded)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    each = coded.groupBy("label").agg(F.when(total.isNotNull(), F.least(total, most)).cast("bigint").alias("label_error"))
    each = cut_lineage(each).withColumnRenamed("label", "l")  # its size is known, so few labels are broadcast
    done = coded.join(each, F.col("label").eqNullSafe(F.col("l")), "left")
    return done.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


# The same in DuckDB's SQL: assignment by a minimum over all entries, two rounds written out.
_NEAR = """
d{k} AS (SELECT s.id, s.part, e.entry, sum((s.v - e.v) * (s.v - e.v)) AS d FROM sub s JOIN book{k} e USING (part, place) GROUP BY s.id, s.part, e.entry),
a{k} AS (SELECT id, part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM d{k} GROUP BY id, part)"""
_MOVE = """,
m{k} AS (SELECT a.part, a.entry, s.place, CAST(floor(sum(s.v) / count(*)) AS BIGINT) AS v FROM a{k} a JOIN sub s USING (id, part) GROUP BY a.part, a.entry, s.place),
book{n} AS (SELECT b.part, b.entry, b.place, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN m{k} m USING (part, entry, place)),"""
ORACLE = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT len(v) // {PARTS} AS w FROM kept WHERE id = 1),
flat AS (SELECT id, unnest(v) AS v, unnest(range(len(v))) AS i FROM kept),
sub AS (SELECT id, i // w AS part, i % w AS place, v FROM flat, width),
book0 AS (SELECT part, id - 1 AS entry, place, v FROM sub WHERE id <= {ENTRIES}),{"".join(_NEAR.format(k=k) + _MOVE.format(k=k, n=k + 1) for k in range(ROUNDS))}{_NEAR.format(k=ROUNDS)},
code AS (SELECT id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id),
hash AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) AS h FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN code USING (id), hash
"""
