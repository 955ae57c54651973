"""Importance resampling towards a target corpus, by hashed n-grams over joined batches.

The texts of a batch are joined with a separator byte that no word holds; one regular
expression pass over the whole finds all words, and a search of the texts' offsets tells each
word's text. Hashes of runs of words are carried on from word to word for all places at once;
runs whose ends lie in different texts are masked before the buckets are counted. A bucket's
gain is the floored 1000-fold log ratio of its smoothed shares in target and source, a
document's weight the floored mean gain of its features, and its score the weight with a
Gumbel draw added that its id decides, so the highest scores are a sample without replacement
by importance, and reruns and lost tasks draw the same.

Three passes: bucket counts of the source and of the target (tasks hand on one row per bucket),
scores (no shuffle), ranks. Scores are integers of a bounded range (a weight is within 1000 times
the logarithm of a count, a draw within -3,133 and 22,874), so the table of documents per score is
small whatever the input; it gives every score its first rank, and documents are numbered only
within a score. ``n``, the buckets and the share are parameters; any ``n`` of words is whole.

Defined results: a null or empty text has no words, weight 0 and no rank; features of a text of
fewer than ``n`` words are its shorter runs; null ids are drawn as the empty id and come after all
others; rows with equal ids are separate documents that tie when their texts do (each gets a
rank of its own); with an empty target all gains are those of its smoothing; an empty table
gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import cut_lineage, text_or_empty

WORDS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: bytes of text that are joined at a time (at least one text), which bounds memory
BATCH_BYTES = 1 << 22
#: words beyond this many bytes are hashed one by one
LONG = 48

#: Fixed value of the contract: what words are made of, in bytes of UTF-8 (a character from
#: U+0080 on is bytes from 0x80 on), once A-Z are lower.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SEPARATOR = b"\n"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _crc_table() -> np.ndarray:
    """Remainders of the 256 bytes under the reversed polynomial of CRC-32."""
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = np.where(r & 1, (r >> 1) ^ np.uint32(0xEDB88320), r >> 1)
    return r


_CRC = _crc_table()


def _carry_on(state: np.ndarray, data: np.ndarray, raw: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 values (unsigned) continued over ``data[start : start + size]``, all at once."""
    out = state.copy()
    long = np.flatnonzero(size > LONG)
    live = np.flatnonzero((size > 0) & (size <= LONG))
    live = live[np.argsort(-size[live], kind="stable")]
    left = np.sort(size[live])
    c = ~out[live]
    for k in range(int(left[-1]) if len(left) else 0):
        n = len(live) - int(np.searchsorted(left, k, "right"))  # those with more than k bytes come first
        c[:n] = _CRC[(c[:n] ^ data[start[live[:n]] + k]) & 0xFF] ^ (c[:n] >> 8)
    out[live] = ~c
    for i in long.tolist():
        out[i] = zlib.crc32(raw[start[i] : start[i] + size[i]], int(out[i]))
    return out


def features(texts: list[bytes], n: int = WORDS, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to ``n`` words of all texts: (the run's text, its bucket)."""
    raw = _SEPARATOR.join(texts).translate(_LOWER)
    data = np.frombuffer(raw, np.uint8)
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begin = np.cumsum(size + len(_SEPARATOR)) - size - len(_SEPARATOR)
    flat = [x for m in _WORD.finditer(raw) for x in m.span()]
    spans = np.array(flat, np.int64).reshape(-1, 2)
    start, length = spans[:, 0], spans[:, 1] - spans[:, 0]
    doc = np.searchsorted(begin, start, "right") - 1
    state = np.zeros(len(start), np.uint32)
    blank = np.frombuffer(b" ", np.uint8)
    for k in range(min(n, len(start))):
        many = len(start) - k
        state = state[:many]
        if k:
            state = _carry_on(state, blank, b" ", np.zeros(many, np.int64), np.ones(many, np.int64))
        state = _carry_on(state, data, raw, start[k:], length[k:])
        inside = doc[:many] == doc[k:]
        yield doc[:many][inside], state[inside].astype(np.int64) % buckets


def _joined(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of at most ``BATCH_BYTES`` together, or of one text."""
    lo, held, size = 0, [], 0
    for i, t in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        if held and size + len(t) > BATCH_BYTES:
            yield lo, held
            lo, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield lo, held


def bucket_counts(docs: DataFrame, n: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts (at most ``buckets`` rows reach the driver)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _joined(batch.column(0)):
                for _, bucket in features(texts, n, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    rows = docs.select(text_or_empty().alias("t")).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) per bucket."""
    s_all, t_all, b = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((int(t) + 1) * (s_all + b) / ((int(s) + 1) * (t_all + b)))) for s, t in zip(source, target)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, n: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row; one pass, no shuffle."""
    buckets = len(gain)

    def column(texts: pa.Array) -> pa.Array:
        words, count, total = (np.zeros(len(texts), np.int64) for _ in range(3))
        for lo, part in _joined(texts):
            for k, (doc, bucket) in enumerate(features(part, n, buckets)):
                here = np.bincount(doc, minlength=len(part))
                if not k:
                    words[lo : lo + len(part)] = here
                count[lo : lo + len(part)] += here
                # whole numbers far below 2^53: the sums are exact
                total[lo : lo + len(part)] += np.bincount(doc, gain[bucket].astype(float), len(part)).astype(np.int64)
        weight = np.where(count > 0, total // np.maximum(count, 1), 0)
        return pa.StructArray.from_arrays([pa.array(words), pa.array(count), pa.array(weight)], ["n_words", "n_features", "weight"])

    made = F.arrow_udf(column, "n_words bigint, n_features bigint, weight bigint")
    return docs.select("doc_id", made(text_or_empty()).alias("f")).select("doc_id", "f.n_words", "f.n_features", "f.weight")


def draw(weighed: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: the ``percent`` highest scores of documents with
    ``least_words`` words or more, numbered from the highest, ties to smaller ids."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = cut_lineage(weighed.withColumn("score", (F.col("weight") + noise).cast("bigint")))
    able = F.col("n_words") >= least_words
    # one row per score: a bounded range (see above), so one task can add them up
    per = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ends = per.withColumn("__upto", F.sum("__n").over(upto)).withColumn("__all", F.sum("__n").over(Window.partitionBy()))
    place = cut_lineage(
        ends.withColumn("__quota", F.expr(f"{int(percent)} * __all div 100"))
        .select(F.col("score").alias("__s"), (F.col("__upto") - F.col("__n")).alias("__above"), "__quota")
        .where("__above < __quota")
    )
    chosen = scored.where(able).join(place, F.col("score") == F.col("__s"))
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    chosen = chosen.withColumn("rank", F.col("__above") + within).withColumn("rank", F.when(F.col("rank") <= F.col("__quota"), F.col("rank")))
    names = ["doc_id", "n_features", "weight", "score", F.col("rank").cast("bigint").alias("rank")]
    rest = scored.join(place, F.col("score") == F.col("__s"), "left").where(~able | F.col("__s").isNull())
    return chosen.select(*names).unionByName(rest.withColumn("rank", F.lit(None)).select(*names))


def resample(docs: DataFrame, target: DataFrame, n: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null where not drawn) for every row of ``docs``."""
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    return draw(weigh(docs, gain, n))


# The same in DuckDB's SQL: CRC-32 is folded over the bytes of every distinct word.
ORACLE = rf"""
WITH RECURSIVE crc(i, k, r) AS (SELECT range, 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, CAST(3988292384 AS BIGINT)) ELSE r >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(r ORDER BY i) AS t FROM crc WHERE k = 8),
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
dw AS (SELECT k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
v AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
h AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) % {BUCKETS} AS b FROM v, tab),
s AS (SELECT b, count(*) AS s FROM dw JOIN h USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM bw JOIN h USING (w) GROUP BY b),
g AS (SELECT range AS b, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS}) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})))) AS BIGINT) AS g
  FROM range({BUCKETS}) LEFT JOIN s ON s.b = range LEFT JOIN t ON t.b = range),
f AS (SELECT k, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM dw JOIN h USING (w) JOIN g USING (b) GROUP BY k),
e AS (SELECT k, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN f USING (k)),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM e WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (k)
"""
