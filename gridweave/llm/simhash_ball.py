"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits have a common variant within
``radius / 2`` flips of both. Every distinct fingerprint's variants (2,081 for radius 4) are
brought together by value: a variant belongs to the bucket that a linear hash of its bits
names, and because that hash of ``fingerprint xor mask`` is the xor of both hashes, a
fingerprint sent to a bucket yields just its variants of that bucket there. So a shuffled
block carries fingerprints instead of 2,081 variants each. Within a bucket the variants are
sorted; fingerprints that meet on one are linked to the smallest of them after a check of
their distance, which keeps every connection without emitting pairs.

A fingerprint goes to 256 buckets while one bucket can hold all (``BUCKET_FINGERPRINTS``),
and beyond that to the up to 2,081 of more buckets; a bucket takes its variants in turns of
about ``BUCKET_VARIANTS``. Neither changes the result.

Defined results: a null text counts as empty; a text without words has fingerprint zero and
links like any other; a text of fewer words than a shingle is one shingle; repeated rows are
each returned; rows with a null ``doc_id`` are returned and never serve as a component's
id unless all its rows lack one. Other columns are not read.
"""

from __future__ import annotations

import functools
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import cut_lineage, text_or_empty
from gridweave.llm.components import connected_components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Variants sorted at a time, and fingerprints that a bucket may hold (8 bytes each).
BUCKET_VARIANTS, BUCKET_FINGERPRINTS = 4_000_000, 16_000_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    ws = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII case and ASCII white space only
    joined = b" ".join(ws)
    if len(ws) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED) if ws else 0
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in ws)]
    starts = [0, *(e + 1 for e in ends[: len(ws) - shingle])]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :])], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        block = h[lo : lo + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(ones * 2 > len(h)).astype(np.uint64)).sum(dtype=np.uint64))


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))


@functools.cache
def masks(radius: int = RADIUS) -> np.ndarray:
    """All masks of at most half the radius (rounded up) flipped bits."""
    half = -(-radius // 2)
    return np.array([sum(1 << b for b in c) for k in range(half + 1) for c in combinations(range(64), k)], np.uint64)


@functools.cache
def _tables(bits: int) -> np.ndarray:
    """Per byte of a word, the xor of its bits' columns: a linear hash to ``bits`` bits."""
    column = np.random.default_rng(64).permutation(np.arange(1, max(128, 1 << bits)))[:64] & ((1 << bits) - 1)
    t = np.zeros((8, 256), np.int64)
    for k in range(8):
        for b in range(8):
            t[k, (np.arange(256) >> b) & 1 == 1] ^= column[8 * k + b]
    return t


def bucket_of(x: np.ndarray, bits: int) -> np.ndarray:
    t, by = _tables(bits), x.view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(x), np.int64)
    for k in range(8):
        out ^= t[k][by[:, k]]
    return out


def _roots(member: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Link rows (member, root) reduced to one per node: its smallest connected node."""
    nodes, flat = np.unique(np.concatenate([member, root]), return_inverse=True)
    a, b = flat[: len(member)], flat[len(member) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        np.minimum.at(new, low[a], low[b])
        np.minimum.at(new, low[b], low[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    keep = low != np.arange(len(nodes))
    return nodes[keep], nodes[low[keep]]


class Indexed:
    """Distinct fingerprints by the linear hash of their bits."""

    def __init__(self, fps: np.ndarray, bits: int):
        own = bucket_of(fps, bits)
        order = np.argsort(own, kind="stable")
        self.bits, self.fps, self.own = bits, fps[order], own[order]

    def having(self, key: int) -> np.ndarray:
        a, b = np.searchsorted(self.own, [key, key + 1])
        return self.fps[a:b]


def meet(fps: Indexed, key: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints whose variants have the hash ``key`` and coincide."""
    m = masks(radius)
    kind = bucket_of(m, fps.bits)
    variants, parents = [], []
    for k in np.unique(kind):
        sel = fps.having(int(key ^ k))
        if len(sel):
            variants.append((sel[:, None] ^ m[kind == k][None, :]).ravel())
            parents.append(np.repeat(sel, int((kind == k).sum())))
    none = np.zeros(0, np.uint64)
    if not variants:
        return none, none
    v, p = np.concatenate(variants), np.concatenate(parents)
    s = np.sort(v)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return none, none
    at = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
    hit = twice[at] == v
    v, p = v[hit], p[hit]
    order = np.lexsort((p, v))
    v, p = v[order], p[order]
    begin = np.concatenate([[True], v[1:] != v[:-1]])
    root = p[np.flatnonzero(begin)][np.cumsum(begin) - 1]
    ok = (p != root) & (np.bitwise_count(p ^ root) <= radius)
    return _roots(p[ok], root[ok]) if ok.any() else (none, none)


def fingerprint_column(text):
    return F.arrow_udf(_fingerprints, "long")(text)


def sizes(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """Bits of the hash that name a bucket, and further bits by which a bucket's variants
    are taken in turns, for ``n`` distinct fingerprints."""
    every = n * len(masks(radius))
    bits = 8 if n <= BUCKET_FINGERPRINTS else int(np.ceil(np.log2(every / BUCKET_FINGERPRINTS)))
    turns = max(0, int(np.ceil(np.log2(max(1, every / BUCKET_VARIANTS)))) - bits)
    return bits, turns


def links(fps: DataFrame, radius: int = RADIUS, split: tuple[int, int] | None = None) -> DataFrame:
    """``fps(fp)`` of distinct longs -> ``(a, b)`` links that connect all within ``radius``.
    ``split`` sets what :func:`sizes` would choose."""
    bits, turns = split or sizes(fps.count(), radius)

    def send(batches):
        nonempty = np.unique(bucket_of(masks(radius), bits + turns) >> turns)
        for b in batches:
            x = b["fp"].to_numpy(np.int64).view(np.uint64)
            for lo in range(0, len(x), 8192):
                part = np.sort(x[lo : lo + 8192])
                to = ((bucket_of(part, bits + turns) >> turns)[:, None] ^ nonempty[None, :]).ravel()
                order = np.argsort(to, kind="stable")
                to, who = to[order], part[order // len(nonempty)]
                cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                ends = [*cut[1:], len(to)]
                yield pd.DataFrame({"bucket": to[cut], "block": [who[i:j].tobytes() for i, j in zip(cut, ends)]})

    def gather(key, rows):
        x = Indexed(np.frombuffer(b"".join(rows["block"]), np.uint64), bits + turns)
        found = [meet(x, (int(key[0]) << turns) | k, radius) for k in range(1 << turns)]
        a, b = (np.concatenate(f) for f in zip(*found))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    blocks = fps.mapInPandas(send, "bucket long, block binary")
    return blocks.groupBy("bucket").applyInPandas(gather, "a long, b long").distinct()


def _grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, th (the text's hash), fp, top (the component's smallest fingerprint) per row."""
    t = text_or_empty()
    marked = cut_lineage(docs.select("doc_id", F.xxhash64(t).alias("th"), fingerprint_column(t).alias("fp")))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    comp = connected_components(links(distinct.select("fp"), radius))
    top = distinct.join(comp, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("fp2"), F.coalesce("component", "fp").alias("top"))
    return cut_lineage(marked.join(top, F.col("fp") == F.col("fp2")).drop("fp2"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    rows = _grouped(docs, radius)
    lowest = rows.groupBy("top").agg(F.min("doc_id").alias("component_id"))
    return rows.join(lowest, "top").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keepers(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``keep_id, keep_hash``: id and text hash of the one document that stays of every
    group, the smallest id (a null id only where no other is)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k")
    return _grouped(docs, radius).groupBy("top").agg(first).select(F.col("k.doc_id").alias("keep_id"), F.col("k.th").alias("keep_hash"))
