"""Toxicity by compression distance: two zstandard dictionaries, one length against the other.

Texts are cut into windows of about ``WINDOW`` UTF-8 bytes that end between words (``A-Z``
lower, white space as blanks). The ordinary dictionary is trained on windows of ordinary
documents. The toxic one is trained on windows of toxic documents in short segments, of which
those stay that shorten windows of toxic documents far more often than windows of ordinary
ones (measured by compressing every window of the sample with each segment); it is laid before
the ordinary dictionary, with the same entropy tables, so both describe common text alike.
A window's difference is its compressed length under the ordinary dictionary less that under
the toxic one. Windows count from a calibrated threshold on, the least difference that at most
``RARE`` of the ordinary windows reach, and a document's score is a logistic function of what
its windows have beyond it and of their number.

Learning uses at most ``max_docs`` labelled documents of each kind (those with the smallest
hashed ids), all of their windows; a third of them only calibrate. Segments are weighed by
Spark tasks, a few segments each. Scoring is one pass over all texts, without a shuffle.

Defined results: a null text scores as the empty text (one empty window); a null ``doc_id``
counts as held out and is never learned from; null labels are ignored; several labels of one
document count as their largest; rows that share a ``doc_id`` count as one document in
learning (the smallest text) and are each scored; a run without blanks is cut after twice
``WINDOW`` bytes, so texts of any length take memory in proportion to their own size; without
labels of both kinds at hand every score is the share of toxic labels (0 without any); an
empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.common import remainder, text_or_empty

WINDOW, SEGMENT, RARE = 64, 16, 0.0003
LEVEL, ORDINARY_BYTES, TOXIC_BYTES = 12, 112_640, 4096
#: a segment stays where it helps so many times as large a share of toxic documents as of
#: ordinary ones, and at least so many of them and such a share
ODDS, SUPPORT, SHARE = 6.0, 3, 0.02
#: Fixed value of the dictionary format: the three repeated offsets that end the header.
_OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[ord("A") : ord("Z") + 1] += 32
_PLAIN[9:14] = 32


def windows(text: str) -> list[bytes]:
    """The windows of a whole text, in order; one empty window for an empty text."""
    data = _PLAIN[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    aims = np.arange(WINDOW, len(data), WINDOW)
    blanks = np.append(np.flatnonzero(data == 32), len(data))
    ends = np.minimum(blanks[np.searchsorted(blanks, aims)], aims + WINDOW)
    cuts = np.unique(np.concatenate([[0], ends, [len(data)]]))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())] or [b""]


def trained(size: int, samples: list[bytes], **how) -> tuple[bytes, bytes]:
    """(header with entropy tables, content) of a dictionary trained on ``samples``; where they
    are too few to train, their own end without a header."""
    try:
        d = zstandard.train_dictionary(size, samples, level=LEVEL, **how).as_bytes()
    except zstandard.ZstdError:
        return b"", b"".join(samples)[-size:]
    at = d.index(_OFFSETS) + len(_OFFSETS)
    return d[:at], d[at:]


class Lengths:
    """Compressed lengths under one dictionary."""

    def __init__(self, head: bytes, content: bytes):
        kind = zstandard.DICT_TYPE_FULLDICT if head else zstandard.DICT_TYPE_RAWCONTENT
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=3, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        data = zstandard.ZstdCompressionDict(head + content, dict_type=kind) if content else None
        self._compress = zstandard.ZstdCompressor(compression_params=params, dict_data=data).compress

    def __call__(self, parts: list[bytes]) -> np.ndarray:
        return np.fromiter((len(self._compress(p)) for p in parts), np.int64, len(parts))


def differences(model: dict, parts: list[bytes]) -> np.ndarray:
    """Bytes that the toxic dictionary saves each window against the ordinary one."""
    plain = Lengths(model["head"], model["ordinary"])(parts)
    return plain - Lengths(model["head"], model["toxic"] + model["ordinary"])(parts)


def _flat(docs: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    return [w for d in docs for w in d], np.repeat(np.arange(len(docs)), [len(d) for d in docs])


def weigh_segments(spark: SparkSession, segments: list[bytes], head: bytes, ordinary: bytes, toxic_docs: list[list[bytes]], plain_docs: list[list[bytes]]) -> list[tuple[bytes, int, int]]:
    """For every segment, the number of documents of each kind with a window that it shortens
    by two bytes or more. Segments are the rows of a Spark job; the sampled windows go along."""
    sides = [_flat(toxic_docs), _flat(plain_docs)]
    packed = spark.sparkContext.broadcast(sides)  # bounded by max_docs documents

    def weigh(batches):
        both = packed.value
        before = [Lengths(head, ordinary)(parts) for parts, _ in both]
        for batch in batches:
            out = []
            for s in batch["segment"].to_pylist():
                measure = Lengths(head, s + ordinary)
                out.append([s, *[len(np.unique(doc[b - measure(parts) >= 2])) for (parts, doc), b in zip(both, before)]])
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["segment", "toxic", "plain"]), preserve_index=False)

    rows = spark.createDataFrame([(bytearray(s),) for s in dict.fromkeys(segments)], "segment binary")
    n = max(1, min(len(segments), spark.sparkContext.defaultParallelism))
    done = rows.repartition(n).mapInArrow(weigh, "segment binary, toxic long, plain long").collect()  # one row a segment
    packed.unpersist()
    return [(bytes(r.segment), r.toxic, r.plain) for r in done]


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression with a small ridge, by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        w = w + np.linalg.solve(hess, x.T @ (y - p) - 0.05 * w)
    return w


def _summary(saved: np.ndarray, least: int) -> list[float]:
    beyond = saved[saved >= least]
    return [1.0, math.log1p(float((beyond - least + 1).sum())), math.log1p(len(beyond)), math.log1p(len(saved)) / 8]


def _calibrate(model: dict, docs: list[list[bytes]], toxic: np.ndarray) -> dict:
    saved = [differences(model, d) for d in docs]
    plain = np.concatenate([s for s, y in zip(saved, toxic) if not y])
    least = 1
    while (plain >= least).sum() > RARE * len(plain):
        least += 1
    x = np.array([_summary(s, least) for s in saved])
    w = _logistic(x, toxic.astype(float))
    return model | {"least": least, "weights": w}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_docs: int = 1200) -> dict:
    """The two dictionaries, the window threshold and the document's weights, learned from at
    most ``max_docs`` labelled documents of each kind."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("__y"))
    ranked = [known.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs) for y in (1, 0)]
    share = known.agg(F.avg("__y")).first()[0] or 0.0
    picked = ranked[0].unionByName(ranked[1])
    rows = (
        docs.select("doc_id", text_or_empty().alias("__t"))
        .join(F.broadcast(picked), "doc_id")  # bounded by 2 * max_docs rows
        .groupBy("doc_id").agg(F.min("__t").alias("__t"), F.first("__y").alias("__y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .collect()
    )
    first: dict[str, int] = {}
    for r in rows:  # copies of one text count once
        first[r["__t"]] = max(first.get(r["__t"], 0), r["__y"])
    cut = [(windows(t), y) for t, y in first.items()]
    kinds = {y: [d for d, k in cut if k == y] for y in (0, 1)}
    if min(len(kinds[0]), len(kinds[1])) < 4:
        return {"share": float(share)}
    # every third document calibrates; of the others, half of the ordinary ones make the dictionary
    learn = {y: [d for i, d in enumerate(k) if i % 3] for y, k in kinds.items()}
    check = [(d, y) for y, k in kinds.items() for i, d in enumerate(k) if i % 3 == 0]
    whole = [b" ".join(d) for d in learn[0][::2]]
    head, ordinary = trained(ORDINARY_BYTES, [t[i : i + 4 * WINDOW] for t in whole for i in range(0, len(t), 4 * WINDOW)])
    _, content = trained(TOXIC_BYTES, list(dict.fromkeys(w for d in learn[1] for w in d)), k=SEGMENT, d=6)
    segments = [content[i : i + SEGMENT] for i in range(0, len(content), SEGMENT)]
    against = learn[0][1::2]
    size = min(400, len(learn[1]))
    weighed = weigh_segments(docs.sparkSession, segments, head, ordinary, learn[1][:size], against[: 2 * size])
    odds = lambda a, b: (a + 0.5) / (size + 1) / ((b + 0.5) / (len(against[: 2 * size]) + 1))
    kept = sorted((s for s, a, b in weighed if a >= max(SUPPORT, SHARE * size) and odds(a, b) >= ODDS))
    model = {"head": head, "ordinary": ordinary, "toxic": b"".join(kept) or content}
    return _calibrate(model, [d for d, _ in check], np.array([y for _, y in check]))


def document_score(model: dict, text: str) -> float:
    if "share" in model:
        return model["share"]
    return _score(model["weights"], differences(model, windows(text)), model["least"])


def _score(weights: np.ndarray, saved: np.ndarray, least: int) -> float:
    return float(1 / (1 + np.exp(-np.clip(np.dot(weights, _summary(saved, least)), -30, 30))))


def score_column(model: dict):
    """An Arrow function text -> score over every window of the whole text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if "share" in model:
            return pa.array(np.full(len(texts), model["share"]))
        plain = Lengths(model["head"], model["ordinary"])
        toxic = Lengths(model["head"], model["toxic"] + model["ordinary"])
        out = np.empty(len(texts))
        for i in range(len(texts)):
            parts = windows(texts[i].as_py())
            out[i] = _score(model["weights"], plain(parts) - toxic(parts), model["least"])
        return pa.array(out)

    return score


def score_documents(docs: DataFrame, model: dict, out: str = "score") -> DataFrame:
    """All columns of ``docs`` with ``out`` (0 to 1) added or replaced."""
    return docs.withColumn(out, score_column(model)(text_or_empty()))


def held_out():
    return F.coalesce(remainder("doc_id", 4) == 2, F.lit(True))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels.where(~held_out()))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
