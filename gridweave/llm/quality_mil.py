"""Quality classifier: gated attention over the passages of a document.

A document is a bag of passages (windows of ``PASSAGE`` UTF-8 bytes over the whole text).
Each passage is encoded as byte statistics: a histogram of byte classes, a hashed histogram
of byte pairs, how often a byte equals the one ``lag`` places before it (which shows repeated
words), and its length. A learned layer turns these into a hidden vector ``h``; gated
attention ``a = softmax(w . (tanh(V h) * sigmoid(U h)))`` weighs the passages; the weighted
sum is the document's representation, scored by a logistic layer. Only document labels are
used: the attention learns which passages matter.

Training uses a bounded sample (``max_docs`` labelled documents, ``max_passages`` random
passages of each) on the driver; scoring is one pass over all texts, without a shuffle,
and encodes every passage of every text.

Defined results: a null text scores as the empty text (one passage of length zero); a null
``doc_id`` counts as held out and is never learned from; a null label is ignored; several
labels of one document count as their largest; with no labels of both kinds at hand every
score is the share of good labels (0.5 without any). Columns other than those named are
neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import remainder, text_or_empty

PASSAGE = 512
PAIRS = 128
LAGS = tuple(range(2, 15))
HIDDEN, ATTEND = 32, 16


def _classes() -> np.ndarray:
    """Byte -> class: each ASCII sign its own, digits and capitals one each, lower case
    letters one each, lead and following bytes of longer characters by their high bits."""
    t = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            t[b] = 80 + (b >> 4) - 8
        elif c.isdigit():
            t[b] = 1
        elif c.isupper():
            t[b] = 2
        elif c.islower():
            t[b] = 3 + b - ord("a")
        elif c.isspace():
            t[b] = 29 + (c == "\n")
        elif 33 <= b < 127:
            t[b] = 31 + (b - 33 if b < 48 else b - 43 if b < 65 else b - 69 if b < 97 else b - 95)
    return t


CLASS = _classes()
CLASSES = 88
DIM = CLASSES + PAIRS + len(LAGS) + 2


def encode(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a batch of texts, and each text's first passage.

    ``data``: the texts' bytes end to end; ``starts``: where each begins, and the end."""
    size = np.diff(starts)
    n = np.maximum(1, -(-size // PASSAGE))
    first = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(data)) - starts[doc]
    cell = first[doc] + pos // PASSAGE
    total = int(first[-1])
    length = np.bincount(cell, minlength=total).astype(np.float32)
    scale = np.maximum(length, 1)[:, None]
    c = CLASS[data]
    out = np.empty((total, DIM), np.float32)
    hist = np.bincount(cell * CLASSES + c, minlength=total * CLASSES).reshape(total, CLASSES)
    out[:, :CLASSES] = np.sqrt(hist / scale)
    if len(data) > 1:
        inside = cell[1:] == cell[:-1]
        pair = (c[:-1] * 53 + c[1:] * 7) % PAIRS
        hist = np.bincount((cell[1:] * PAIRS + pair)[inside], minlength=total * PAIRS).reshape(total, PAIRS)
        out[:, CLASSES : CLASSES + PAIRS] = np.sqrt(hist / scale)
    else:
        out[:, CLASSES : CLASSES + PAIRS] = 0
    for k, lag in enumerate(LAGS):
        same = np.zeros(total)
        if len(data) > lag:
            hit = (data[lag:] == data[:-lag]) & (cell[lag:] == cell[:-lag])
            same = np.bincount(cell[lag:][hit], minlength=total)
        out[:, CLASSES + PAIRS + k] = same / scale[:, 0]
    out[:, -2] = np.log1p(length) / 6
    out[:, -1] = np.log1p(np.repeat(size, n)) / 12
    return out, first


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(p: dict, x: np.ndarray, mask: np.ndarray) -> tuple:
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = np.where(mask, (t * s) @ p["w"], -1e9)
    a = np.exp(e - e.max(1, keepdims=True))
    a /= a.sum(1, keepdims=True)
    z = (a[:, :, None] * h).sum(1)
    return h, t, s, a, z, _sigmoid(z @ p["c"] + p["d"])


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> dict:
    """Fit by Adam on the log loss; the gradients are written out below."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or len(y) < 2:
        return {"share": share}
    rng = np.random.default_rng(seed)
    flat = np.concatenate(bags)
    mu, sd = flat.mean(0), flat.std(0) + 0.02
    g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"W": g(DIM, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": g(HIDDEN, ATTEND), "U": g(HIDDEN, ATTEND), "w": g(ATTEND), "c": g(HIDDEN), "d": np.float32(np.log(share / (1 - share)))}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            most = max(len(bags[i]) for i in pick)
            x = np.zeros((len(pick), most, DIM), np.float32)
            mask = np.zeros((len(pick), most), bool)
            for k, i in enumerate(pick):
                x[k, : len(bags[i])] = (bags[i] - mu) / sd
                mask[k, : len(bags[i])] = True
            h, t, s, a, z, out = _forward(p, x, mask)
            do = (out - y[pick]) / len(pick)
            dz = do[:, None] * p["c"]
            da = (dz[:, None, :] * h).sum(2)
            de = a * (da - (a * da).sum(1, keepdims=True))
            dts = de[:, :, None] * p["w"]
            dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
            dh = a[:, :, None] * dz[:, None, :] + dt @ p["V"].T + ds @ p["U"].T
            du = (dh * (1 - h * h)).reshape(-1, HIDDEN)
            hf = h.reshape(-1, HIDDEN)
            grad = {"W": x.reshape(-1, DIM).T @ du, "b": du.sum(0), "V": hf.T @ dt.reshape(-1, ATTEND), "U": hf.T @ ds.reshape(-1, ATTEND), "w": ((t * s) * de[:, :, None]).sum((0, 1)), "c": z.T @ do, "d": do.sum()}
            step += 1
            for k in p:
                d = grad[k] + 1e-4 * p[k] * (k in "WVUwc")
                m[k] = 0.9 * m[k] + 0.1 * d
                v2[k] = 0.999 * v2[k] + 0.001 * d * d
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p | {"mu": mu.astype(np.float32), "sd": sd.astype(np.float32)}


def score_bags(p: dict, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Scores of texts given the features of all their passages; any number of passages each."""
    if "share" in p:
        return np.full(len(first) - 1, p["share"])
    h = np.tanh(((x - p["mu"]) / p["sd"]) @ p["W"] + p["b"])
    e = (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]
    at = first[:-1]
    n = np.diff(first)
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), n))
    a = e / np.repeat(np.add.reduceat(e, at), n)
    return _sigmoid(np.add.reduceat(a[:, None] * h, at) @ p["c"] + p["d"]).astype(float)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    binary = texts.cast(pa.large_binary())
    at = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    raw = binary.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def _slices(starts: np.ndarray, most: int = 1 << 19):
    """Ranges of texts of about ``most`` bytes (at least one text), which bounds memory."""
    lo, n = 0, len(starts) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def score_column(model: dict):
    """An Arrow function text -> score that encodes every passage of the whole text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        data, starts = _bytes_of(texts)
        out = [np.zeros(0)]
        for lo, hi in _slices(starts):
            out.append(score_bags(model, *encode(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])))
        return pa.array(np.concatenate(out))

    return score


def _features_column(max_passages: int):
    @F.arrow_udf("binary")
    def features(texts: pa.Array) -> pa.Array:
        data, starts = _bytes_of(texts)
        out = []
        for lo, hi in _slices(starts):
            x, first = encode(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])
            for a, b in zip(first[:-1], first[1:]):
                keep = np.arange(a, b)
                if b - a > max_passages:
                    keep = np.sort(np.random.default_rng(int(b - a)).choice(keep, max_passages, replace=False))
                out.append(x[keep].tobytes())
        return pa.array(out, pa.binary())

    return features


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = 3000, max_passages: int = 32) -> dict:
    """Learn from at most ``max_docs`` labelled documents (those with the smallest hashed
    ids), ``max_passages`` passages of each: at most some 90 MB at the driver."""
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("__y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = (
        docs.select("doc_id", text_or_empty().alias("__t"))
        .join(F.broadcast(picked), "doc_id")  # bounded by max_docs rows
        .groupBy("doc_id").agg(F.min("__t").alias("__t"), F.first("__y").alias("__y"))
        .select("doc_id", "__y", _features_column(max_passages)("__t").alias("__x"))
        .toPandas()
        .sort_values("doc_id")
    )
    bags = [np.frombuffer(b, np.float32).reshape(-1, DIM) for b in rows["__x"]]
    return train(bags, rows["__y"].to_numpy(np.float32))


def score_documents(docs: DataFrame, model: dict, out: str = "score") -> DataFrame:
    """All columns of ``docs`` with ``out`` (0 to 1) added or replaced."""
    return docs.withColumn(out, score_column(model)(text_or_empty()))


def held_out(folds: int = 5):
    return F.coalesce(remainder("doc_id", folds) == 0, F.lit(True))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels.where(~held_out()))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
