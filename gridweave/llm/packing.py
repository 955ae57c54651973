"""Best-fit packing with Martello-Toth dominance reduction.

Documents are tokenised and cut into pieces of at most ``limit`` tokens. Only sizes matter
for packing, and there are at most ``limit`` of them, so the instance is the histogram of
sizes: a grouped count, bounded whatever the data. On it

1. the reduction fixes sets that dominate every other set with the same largest piece:
   the piece alone where nothing fits beside it; the piece and the largest that fits, where
   the two fill the sequence, or no two others fit, or it is at least the sum of any two
   that fit (and no three fit); the piece and a pair that no other feasible pair exceeds in
   either part (and no three fit). Some best packing holds these sets;
2. best-fit decreasing packs the rest, all equal pieces and equal gaps at a time.

The result, ranges of equal pieces placed in ranges of sequences, is looked up for every
piece by its rank among the pieces of its size. Ranks are two-level (size and hash bucket,
then a sum over buckets), so one size holding a third of all rows is spread.

Defined results: a null or empty text is the end id alone; repeated rows are packed each;
an empty table gives no rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import cut_lineage, text_or_empty
from gridweave.llm.tokenization import encoder

LIMIT, END = 2048, 0
BUCKETS, BUCKET_ROWS = 64, 500_000

_PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def cuts(n: int, limit: int = LIMIT) -> list[int]:
    """Where the pieces of ``n`` tokens begin: all but the first have ``limit`` tokens."""
    return [0, *range(n % limit or limit, n, limit)]


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 per piece; ``with_ids`` adds ``ids``, the
    piece's little-endian unsigned 32-bit ids."""

    @F.arrow_udf("array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:binary>>")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        some = (texts.slice(lo, 256).to_pylist() for lo in range(0, len(texts), 256))
        for ids in chain.from_iterable(map(encoder(tokenizer).encode, some)):
            raw = np.append(ids, np.uint32(end)).astype("<u4").tobytes()
            at = cuts(len(raw) // 4, limit)
            rows = []
            for k, (a, b) in enumerate(zip(at, [*at[1:], len(raw) // 4])):
                part = raw[4 * a : 4 * b]
                rows.append({"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(part), "ids": part if with_ids else None})
            out.append(rows)
        return pa.array(out, pa.list_(_PIECE))

    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return docs.select("doc_id", F.explode(cut(text_or_empty())).alias("__p")).select("doc_id", *[F.col("__p")[c].alias(c) for c in names])


class Plan:
    """Placements of equal pieces: ``ranges[size]`` holds (first rank, count, first sequence,
    offset); ranks count the pieces of a size from 0."""

    def __init__(self, counts: dict[int, int], limit: int = LIMIT):
        self.limit, self.left = limit, {s: n for s, n in sorted(counts.items(), reverse=True) if n}
        self.ranges: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self.given: dict[int, int] = defaultdict(int)
        self.sequences = self.fixed = 0
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.bound = -(-sum(s * n for s, n in counts.items()) // limit)
        self._reduce()
        self._best_fit()

    def _place(self, size: int, n: int, seq: int, offset: int) -> None:
        self.ranges[size].append((self.given[size], n, seq, offset))
        self.given[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]

    def _new(self, n: int) -> int:
        seq, self.sequences = self.sequences, self.sequences + n
        return seq

    def _fix(self, sizes: list[int]) -> None:
        """Fix as many sequences of exactly these sizes as there are pieces for."""
        n = min(self.left[s] // sizes.count(s) for s in sizes)
        seq, offset = self._new(n), 0
        for s in sizes:
            self._place(s, n, seq, offset)
            offset += s
        self.fixed += n
        if offset < self.limit:
            self.gaps[self.limit - offset].append((seq, n))

    def _dominating(self, j: int) -> list[int] | None:
        room = self.limit - j
        free = {s: n - (s == j) for s, n in self.left.items() if s <= room and n - (s == j) > 0}
        if not free:
            return [j]
        up = sorted(free)
        low = [s for s in up[:3] for _ in range(min(3, free[s]))][:3]
        k = up[-1]
        if j + k == self.limit or len(low) == 1 or low[0] + low[1] > room:
            return [j, k]
        if len(low) == 3 and sum(low) <= room:
            return None
        # exactly one or two more pieces fit: the best sum and the largest smaller part of a pair
        best = small = 0
        hi = len(up) - 1
        for s in up:
            while hi >= 0 and up[hi] + s > room:
                hi -= 1
            if hi < 0 or up[hi] < s:
                break
            if up[hi] > s or free[s] > 1:
                best, small = max(best, s + up[hi]), s
            elif hi and up[hi - 1] + s > best:
                best = max(best, s + up[hi - 1])
        if k >= best:
            return [j, k]
        rest = [s for s in up if s <= room - k and (s != k or free[s] > 1)]
        return [j, k, rest[-1]] if rest and rest[-1] >= small else None

    def _reduce(self) -> None:
        for j in list(self.left):
            while j in self.left:
                found = self._dominating(j)
                if found is None or any(self.left[s] < found.count(s) for s in found):
                    break
                self._fix(found)

    def _best_fit(self) -> None:
        for size in list(self.left):
            while n := self.left.get(size, 0):
                gap = min((g for g, r in self.gaps.items() if g >= size and r), default=None)
                if gap is None:
                    per = self.limit // size
                    seq, many, gap = self._new(-(-n // per)), -(-n // per), self.limit
                else:
                    per, (seq, many) = gap // size, self.gaps[gap].pop()
                full = min(many, n // per)
                if full:
                    for k in range(per):
                        self._place(size, full, seq, self.limit - gap + k * size)
                    self._leave(gap - per * size, seq, full)
                part = n - full * per if full < many else 0
                for k in range(part):
                    self._place(size, 1, seq + full, self.limit - gap + k * size)
                if part:
                    self._leave(gap - part * size, seq + full, 1)
                self._leave(gap, seq + full + bool(part), many - full - bool(part))

    def _leave(self, gap: int, seq: int, n: int) -> None:
        if n and gap:
            self.gaps[gap].append((seq, n))

    def table(self) -> tuple[np.ndarray, ...]:
        """Sorted by (size, first rank): size, first rank, first sequence, offset."""
        rows = [(s, r, q, o) for s, found in sorted(self.ranges.items()) for r, _, q, o in found]
        return tuple(np.array(rows, np.int64).reshape(-1, 4).T)


def place(made: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``made`` (with ``doc_id``, ``piece``, ``length``) and sequence_id, offset."""
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most `limit` rows
    size, first, seq, offset = Plan(counts, limit).table()
    shift = max(1, int(sum(counts.values())).bit_length())
    key = (size << shift) | first

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def look_up(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(key, (n << shift) | r, "right") - 1
        return pa.StructArray.from_arrays([pa.array(seq[at] + r - first[at]), pa.array(offset[at])], ["sequence_id", "offset"])

    buckets = max(BUCKETS, -(-sum(counts.values()) // BUCKET_ROWS))
    rows = made.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece", F.lit(3)), F.lit(buckets)).cast("int"))
    per = rows.groupBy("length", "__b").count()
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("length", "__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    # rows that tie in all of these are the same piece: which of them gets which place is one
    inside = Window.partitionBy("length", "__b").orderBy("doc_id", "piece", "start", "ids_crc32")
    rows = rows.withColumn("__r", F.row_number().over(inside) - 1).join(per, ["length", "__b"])
    rows = rows.withColumn("__at", look_up("length", F.col("__r") + F.col("__before")))
    return rows.select(*made.columns, "__at.sequence_id", "__at.offset")


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset per piece."""
    return place(cut_lineage(pieces(docs, tokenizer, limit, end, with_ids)), limit)
