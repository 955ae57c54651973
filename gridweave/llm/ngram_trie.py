"""Language-model scoring by an Elias-Fano n-gram trie.

Level 1 is the vocabulary (words by hash); an entry of level k > 1 is a pair: the node of
its first k - 1 words and its last word. Within a node's range of children a word is told
by its place in its own context: for k = 2 its place in the vocabulary, for k > 2 its rank
among the successors of the word before it, which are fewer, so the numbers are small. A
level is cut into shards of consecutive entries. A shard's file holds, as Elias-Fano
sequences, the children's numbers (each range raised above the one before, which makes the
whole monotone) and the pointers where each parent's range begins, and beside them
quantised logarithms of the discounted probabilities and, where asked for, exact counts; the
masses that contexts leave are arrays over runs of nodes. Tasks map the files, number the
n-grams of ``STEP`` bytes of text in the order of the trie, and look up each distinct one once,
whole arrays at a time, by successor search.

Model: interpolated absolute discounting,
``p(w | h) = (c(hw) - D) / c(h) + g(h) p(w | h')``, with entries under ``MIN_COUNT`` pruned
and their mass left to ``g(h) = 1 - sum of the kept terms``; at the bottom
``p(w) = (c + 0.1) / (N + 0.1 (V + 1))`` over words and one end per text (a start of text
serves as context only). Counts run over all training texts.

Counting: a task counts the pairs of its texts in arrays, cuts them by ranges into buckets and
sends each bucket as one compressed block; a bucket's blocks are added up together and written
as shards by the same task, so that no n-gram is a row of its own or sorted twice. The ranges
hold some equal numbers of tokens, as the level before counted its nodes; a node with more is
cut by its words. A level counts only n-grams whose parts were kept before, which loses none (none of the others can
reach ``MIN_COUNT``). Everything sent is distinct pairs per task, so a word or pair in a
third of all places is one entry of each block.

The model folder lies in the shared folder named by ``spark.checkpoint.dir``, which must be
mounted on the executors for its files to be mapped (a store without a mount is refused).

Defined results: a null text counts as empty and scores its end alone; a null ``doc_id`` is
held out; equal rows are scored (and learned from) each; without training texts every token
has ``p = 0.1 / 0.1``. Two words of one 64-bit hash would share an entry (for 10^9 distinct
words a chance of 3 %). Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm import elias_fano
from gridweave.llm.common import checkpoint_dir, cut_lineage, remainder, text_or_empty
from gridweave.session import intermediates

ORDER, MIN_COUNT, DISCOUNT = 2, 2, 0.75
SHARD, BUCKETS, BUCKET_TOKENS, HELD = 500_000, 64, 4_000_000, 2_000_000
STEP = 16_000_000
#: No word holds a space, so these are no words.
START, STOP = b" <s>", b" </s>"
#: Logarithms from -12 to 0 in 65,535 steps: an error of at most 0.0001.
FLOOR, STEPS = 12.0, 65_535
_VALUES = 10.0 ** (np.arange(STEPS + 1) / STEPS * FLOOR - FLOOR)


def _code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round((np.log10(np.maximum(p, 10.0**-FLOOR)) + FLOOR) / FLOOR * STEPS), 0, STEPS).astype(np.uint16)


def _value(code: np.ndarray) -> np.ndarray:
    return _VALUES[code]


def key_of(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words.to_numpy(zero_copy_only=False), repeat(42)), np.uint64, len(words))


class Level:
    """The shards of a level, opened when asked for."""

    def __init__(self, folder: str, shards: list[dict]):
        self.folder, self.shards, self._open = folder, shards, {}
        self.parent = np.array([s["parent"] for s in shards], np.uint64)
        self.word = np.array([s["word"] for s in shards], np.uint64)
        self.rank = np.concatenate([[0], np.cumsum([s["n"] for s in shards])]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.rank[-1])

    def _shard(self, k: int):
        if k not in self._open:
            self._open[k] = elias_fano.load(os.path.join(self.folder, self.shards[k]["file"]))
        return self._open[k]

    def _by_shard(self, which: np.ndarray):
        if len(which) and (which[1:] >= which[:-1]).all():
            order = None
            cut = np.flatnonzero(np.diff(which, prepend=-1))
        else:
            order = np.argsort(which, kind="stable")
            cut = np.flatnonzero(np.diff(which[order], prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(which)]):
            at = slice(a, b) if order is None else order[a:b]
            if (k := int(which[a if order is None else order[a]])) >= 0:
                yield k, at

    def find(self, parent: np.ndarray, word: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs (parent, word) in order: their nodes (-1 where there is none), places among
        their parent's children and payloads of a name. The order keeps close what is read of
        the mapped files."""
        node, place = np.full((2, len(word)), -1, np.int64)
        load = np.zeros(len(word), np.int64 if name == "count" else np.uint16)
        # a shard is asked for the pairs from its first to the next one's
        low, high = np.searchsorted(parent, self.parent, "left"), np.searchsorted(parent, self.parent, "right")
        for i in np.flatnonzero(low < high):
            low[i] += np.searchsorted(word[low[i] : high[i]], self.word[i])
        for k, (a, b) in enumerate(zip(low, [*low[1:], len(word)])):
            if a == b:
                continue
            arrays, facts = self._shard(k)
            p = (parent[a:b] - self.parent[k]).astype(np.int64)
            p = p[: np.searchsorted(p, facts["last"], "right")]
            if not len(p):
                continue
            w = word[a : a + len(p)]
            values = elias_fano.EliasFano(arrays, facts, "words")
            # begin, end and base once for each run of one parent
            cut = np.flatnonzero(np.diff(p, prepend=-1))
            many = np.diff(np.append(cut, len(p)))
            p = p[cut]
            if facts["last"]:
                begin, end = (x.astype(np.int64) for x in elias_fano.EliasFano(arrays, facts, "points").range(p))
            else:
                begin, end = np.zeros(len(p), np.int64), np.full(len(p), values.n)
            base = np.zeros(len(p), np.uint64)
            later = np.flatnonzero((begin > 0) & (begin < end))
            base[later] = values.at(begin[later] - 1) + np.uint64(1)
            # numbers of a shard's first range count from its smallest, of others from zero
            least = np.where(begin > 0, np.uint64(0), np.uint64(facts["base"]))
            first = begin.copy()
            if k and not p[0]:  # this range may have begun in a shard before
                first[0] = self._first(int(self.parent[k])) - self.rank[k]
            begin, end, base, least, first = (np.repeat(x, many) for x in (begin, end, base, least, first))
            ok = np.flatnonzero((begin < end) & (w >= least))
            pos, same = values.successor(base[ok] + (w[ok] - least[ok]))
            same &= pos < end[ok]
            ok, pos = ok[same], pos[same]
            node[a + ok], place[a + ok], load[a + ok] = self.rank[k] + pos, pos - first[ok], arrays[name][pos]
        return node, place, load

    def _first(self, parent: int) -> int:
        """The first node under a parent that has one."""
        k = max(int(np.searchsorted(self.parent, np.uint64(parent), "left")) - 1, 0)
        arrays, facts = self._shard(k)
        p = parent - int(self.parent[k])
        if p > facts["last"]:
            return int(self.rank[k + 1])
        return int(self.rank[k]) + (int(elias_fano.EliasFano(arrays, facts, "points").at(np.array([p]))[0]) if facts["last"] else 0)

    def left(self, node: np.ndarray) -> np.ndarray:
        """What nodes leave, as stored by :func:`_level` in shards of consecutive nodes (0: nothing stored)."""
        out = np.zeros(len(node), np.uint16)
        for k, at in self._by_shard(np.searchsorted(self.word, node, "right") - 1):
            a = self._shard(k)[0]["left"]
            i = (node[at] - self.word[k]).astype(np.int64)
            out[at] = np.where(i < len(a), a[np.minimum(i, len(a) - 1)], 0)
        return out

    def payload(self, node: np.ndarray, name: str) -> np.ndarray:
        out = None
        for k, at in self._by_shard(np.searchsorted(self.rank, node, "right") - 1):
            a = self._shard(k)[0][name]
            if out is None:
                out = np.zeros(len(node), np.int64 if name == "count" else a.dtype)
            out[at] = a[node[at] - self.rank[k]]
        return np.zeros(0, np.uint16) if out is None else out


class Model:
    """A trie's folder, opened in a task or on the driver."""

    def __init__(self, folder: str):
        with open(os.path.join(folder, "model.json")) as f:
            m = json.load(f)
        self.n, self.v, self.order = m["N"], m["V"], m["order"]
        self.levels = [Level(folder, s) for s in m["levels"]]
        self.backs = [Level(folder, s) for s in m["backs"]]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words' nodes (-1: unknown) and counts."""
        h = key_of(words)
        order = np.argsort(h)
        out = np.empty((2, len(h)), np.int64)
        out[0, order], _, out[1, order] = self.levels[0].find(np.zeros(len(h), np.uint64), h[order], "count")
        return out[0], out[1]

    def counts(self, node: np.ndarray, level: int = 0) -> np.ndarray:
        out = np.zeros(len(node), np.int64)
        some = np.flatnonzero(node >= 0)
        out[some] = self.levels[level].payload(node[some], "count")
        return out

    def left(self, node: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """g(h) of nodes: the mass that their children leave, and whether they have any
        (a mass near 1 is stored as 1, so the mass does not tell)."""
        out, has = np.ones(len(node)), np.zeros(len(node), bool)
        some = np.flatnonzero(node >= 0)
        if len(self.backs) > level and len(some):
            code = self.backs[level].left(node[some].astype(np.uint64))
            hit = code > 0
            out[some[hit]], has[some[hit]] = _value(code[hit]), True
        return out, has

    def bottom(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.n + 0.1 * (self.v + 1))

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        words, at, begins = number(texts)
        node, count = self.words(words)
        low = self.bottom(count)
        p, base, known = low[at], np.log10(low)[at], (count > 0)[at]
        walk = Walk(at, node, begins)
        for k in range(2, self.order + 1):
            left, has = self.left(walk.node, k - 2)
            p *= left[walk.before()]
            places, parent, word, back = walk.pairs(has)
            node, place, prob = self.levels[k - 1].find(parent, word, "prob")
            p[places] += np.where(node >= 0, _value(prob), 0.0)[back]
            if k < self.order:
                walk.on(places, back, node, place)
        keep = np.ones(len(p), bool)
        keep[begins] = False
        total = lambda x: np.add.reduceat(np.where(keep, x, 0), begins)
        return {"n_tokens": total(np.ones(len(p), np.int64)), "n_known": total(known.astype(np.int64)), "base_score": total(base), "score": total(np.log10(p))}


class Walk:
    """Texts on their way down the levels. Each place holds its n-gram as a number into the
    distinct ones (-1: none), whose nodes end with a -1 for these. Numbers follow the order of
    the trie, so each n-gram that occurs is searched once and in that order."""

    def __init__(self, at: np.ndarray, node: np.ndarray, begins: np.ndarray):
        node, back = np.unique(node, return_inverse=True)
        self.at, self.node, self.begins = back.astype(np.int32)[at], np.append(node, -1), begins
        self.first, self.bits = self.at, len(node).bit_length()
        # a word's number in its context: its place in the vocabulary
        self.word_at, self.word = self.at, self.node

    def before(self) -> np.ndarray:
        """At each place the n-gram that ends before it in its text."""
        out = np.empty_like(self.at)
        out[1:] = self.at[:-1]
        out[self.begins] = -1
        return out

    def _sorted(self, has: np.ndarray | None):
        """The places with a node before them and a known word, their order by pairs of these,
        where in it a new pair begins, and the distinct pairs (parent, word)."""
        before, some = self.before(), self.node >= 0
        places = np.flatnonzero((some if has is None else some & has)[before] & (self.word >= 0)[self.word_at])
        key = (before[places].astype(np.uint64) << np.uint64(self.bits)) | self.first[places].astype(np.uint64)
        bits = len(key).bit_length()
        if len(key) and int(key.max()).bit_length() + bits <= 64:  # sorted with their places, which is faster
            key = (key << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64)
            key.sort()
            order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
            key >>= np.uint64(bits)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        one = places[order[new]]
        return places, order, new, self.node[before[one]].astype(np.uint64), self.word[self.word_at[one]].astype(np.uint64)

    def pairs(self, has: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The places with a node before them and a known word, their distinct pairs (parent,
        word) in order, and each place's number among these."""
        places, order, new, parent, word = self._sorted(has)
        back = np.empty(len(order), np.int32)
        back[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        return places, parent, word, back

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs in order and how often they occur."""
        _, _, new, parent, word = self._sorted(None)
        return parent, word, np.diff(np.append(np.flatnonzero(new), len(new)))

    def on(self, places: np.ndarray, back: np.ndarray, node: np.ndarray, place: np.ndarray) -> None:
        """To the next level: the nodes found and their places among their parent's children."""
        at = np.full(len(self.at), -1, np.int32)
        at[places] = back
        if self.word_at is self.first:  # from here on a word is told by its rank after the word before it
            self.word_at, self.word = at, np.append(place, -1)
        self.at, self.node = at, np.append(node, -1)


def number(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of some texts, the texts as numbers into them (each from its start to
    its stop) and where each text begins. ASCII case and white space only."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)
    some = pc.greater(pc.binary_length(words), 0)  # none is empty but before, between and after white space
    upto = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False), dtype=np.int64)])
    sizes = np.diff(upto[ends], prepend=0) + 2
    begins = np.cumsum(sizes) - sizes
    words = words.filter(some).dictionary_encode()
    flat = np.zeros(int(sizes.sum()), np.int32)
    inner = np.ones(len(flat), bool)
    flat[begins + sizes - 1] = 1
    inner[begins] = inner[begins + sizes - 1] = False
    flat[inner] = words.indices.to_numpy() + 2
    return pa.concat_arrays([pa.array([START, STOP], pa.binary()), words.dictionary.cast(pa.binary())]), flat, begins


_models: dict[str, Model] = {}


def model(folder: str) -> Model:
    """The worker's model of a folder; only the last one stays open."""
    if folder not in _models:
        _models.clear()
        _models[folder] = Model(folder)
    return _models[folder]


def _steps(texts: pa.Array):
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        hi = min(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP)) + 1, len(texts))
        yield texts.slice(lo, hi - lo)
        lo = hi


def _summed(parent, word, n):
    """Equal pairs added up, in order."""
    bits = int(word.max()).bit_length() if len(word) else 0
    if len(word) and int(parent.max()).bit_length() + bits < 64:
        key = (parent << np.uint64(bits)) | word
        order = np.argsort(key, kind="stable")  # merges parts that are in order
        key = key[order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[cut] >> np.uint64(bits), key[cut] & np.uint64((1 << bits) - 1), np.add.reduceat(n[order], cut)
    order = np.lexsort((word, parent))
    parent, word = parent[order], word[order]
    cut = np.flatnonzero(np.concatenate([[True], (parent[1:] != parent[:-1]) | (word[1:] != word[:-1])])) if len(word) else order
    return parent[cut], word[cut], np.add.reduceat(n[order], cut) if len(cut) else n


def _pressed(parent, word, n) -> bytes:
    """Sorted pairs as byte planes of differences, compressed."""
    gap = np.diff(parent, prepend=np.uint64(0))
    planes = np.stack([gap, word, n.astype(np.uint64)]).view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _opened(block: bytes):
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(3, 8, -1)
    gap, word, n = np.ascontiguousarray(raw.transpose(0, 2, 1)).view(np.uint64)[..., 0]
    return np.cumsum(gap, dtype=np.uint64), word, n.astype(np.int64)


def _mounted(folder: str) -> str:
    m = re.match(r"file:/*(/.*)", folder)
    if m or "://" not in folder:
        return m[1] if m else folder
    raise ValueError(f"the trie's files are mapped, so the shared folder must be mounted: {folder}")


_SHARD = pa.schema([("kind", pa.string()), ("parent", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("file", pa.string()), ("cut", pa.list_(pa.int64())), ("weight", pa.list_(pa.int64()))])
_SHARD_DDL = "kind string, parent string, word string, n bigint, file string, cut array<bigint>, weight array<bigint>"


def _write_shard(folder: str, name: str, parent: np.ndarray, word: np.ndarray, n: np.ndarray, make, room: int = 0) -> dict:
    """Write pairs, in order, as a shard file; ``make`` gives its payload. With ``room``, where
    runs of some ``room`` tokens begin among its nodes, and their tokens."""
    local = (parent - parent[0]).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], local[1:] != local[:-1]]))
    # each range of numbers is raised above the last of the range before
    last = np.concatenate([cut[1:] - 1, [len(word) - 1]])
    base = int(word[0])
    own = word.copy()
    own[: last[0] + 1] -= np.uint64(base)
    raise_ = np.concatenate([[0], np.cumsum(own[last] + np.uint64(1))[:-1]]).astype(np.uint64)
    values = own + np.repeat(raise_, last - cut + 1)
    arrays, facts = elias_fano.build(values, "words")
    facts |= {"last": int(local[-1]), "base": base}
    if facts["last"]:
        points = np.searchsorted(local, np.arange(facts["last"] + 2)).astype(np.uint64)
        more, known = elias_fano.build(points, "points")
        arrays, facts = arrays | more, facts | known
    arrays |= make(parent.astype(np.int64), word, n)
    file = f"{name}-{int(parent[0])}-{base}"
    elias_fano.save(os.path.join(folder, file), arrays, **facts)
    at = np.zeros(0, np.int64)
    if room:
        hot = np.flatnonzero(n > room)
        at = np.unique(np.concatenate([np.flatnonzero(np.diff((np.cumsum(n) - n) // room, prepend=-1)), hot, hot[hot + 1 < len(n)] + 1]))
    return {"kind": name, "parent": str(int(parent[0])), "word": str(base), "n": len(word), "file": file, "cut": at.tolist(), "weight": np.add.reduceat(n, at).tolist() if len(at) else []}


def _in_order(made: list) -> list[dict]:
    """Shards in the order of their pairs, from their rows: one row per shard."""
    rows = ({"parent": int(r["parent"]), "word": int(r["word"]), "n": r["n"], "file": r["file"], "cut": r["cut"], "weight": r["weight"]} for r in made)
    return sorted(rows, key=lambda s: (s["parent"], s["word"]))


def _buckets(shards: list[dict], room: int, words: int) -> list[tuple[int, int]]:
    """Where the buckets of the next level begin: (parent, word), in order. A node of more than ``room`` tokens has buckets of
    its own, cut by the numbers of its words: evenly, and by halves where they are fewer."""
    out, held, rank = [(0, 0)], 0, 0
    for s in shards:
        for k, end, w in zip(s["cut"], [*s["cut"][1:], s["n"]], s["weight"]):
            if w > room and end == k + 1:
                m = -(-w // room)
                inside = {words * i // m for i in range(1, m)} | {words >> j for j in range(1, words.bit_length()) if words >> j >= 4096}
                out += [(rank + k, x) for x in sorted(inside | {0})] + [(rank + k + 1, 0)]
                held = 0
            elif held and held + w > room:
                out.append((rank + k, 0))
                held = w
            else:
                held += w
        rank += s["n"]
    return sorted(set(out))


def _vocabulary(rows: DataFrame, folder: str, count: int, room: int) -> list[dict]:
    """The first level from rows (word, n): ``word`` is the hash with its top bit flipped."""
    if not count:
        return []

    def write(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            word = t.column("word").to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
            row = _write_shard(folder, "level1", np.zeros(len(word), np.uint64), word, t.column("n").to_numpy(), _counted, room)
            yield pa.RecordBatch.from_pylist([row], _SHARD)

    ordered = rows.repartitionByRange(max(1, -(-count // SHARD)), "word").sortWithinPartitions("word")
    return _in_order(ordered.mapInArrow(write, _SHARD_DDL).collect())


def _counted(parent, word, n) -> dict[str, np.ndarray]:
    return {"count": n.astype(np.min_scalar_type(int(n.max())))}


def _level(docs: DataFrame, folder: str, stage: str, k: int, least: int, discount: float, begins: list[tuple[int, int]], room: int) -> tuple[list[dict], list[dict]]:
    """Count the k-grams seen at least ``least`` times and write their shards and those of what
    their contexts leave; with ``room``, their counts too."""
    split = sorted({p for p, w in begins if w})
    cuts = np.array(begins, np.uint64)

    def count(batches):
        held, size = [], 0

        def flush():
            parent, word, n = _summed(*(np.concatenate(x) for x in zip(*held)))
            low, high = np.searchsorted(parent, cuts[:, 0], "left"), np.searchsorted(parent, cuts[:, 0], "right")
            for i in np.flatnonzero((cuts[:, 1] > 0) & (low < high)):
                low[i] += np.searchsorted(word[low[i] : high[i]], cuts[i, 1])
            edge = np.append(low, len(parent))
            some = np.flatnonzero(edge[1:] > edge[:-1])
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_pressed(parent[a:b], word[a:b], n[a:b]) for a, b in zip(edge[some], edge[some + 1])], pa.binary())], ["bucket", "block"])

        for b in batches:
            m = model(stage)
            for texts in _steps(b.column("text")):
                words, at, starts = number(texts)
                node, seen = m.words(words)
                # a word seen less often than asked for ends no kept n-gram
                walk = Walk(at, np.where(seen >= least, node, -1), starts)
                for j in range(2, k):
                    places, parent, word, back = walk.pairs()
                    walk.on(places, back, *m.levels[j - 1].find(parent, word, "prob")[:2])
                held.append(walk.counted())
                size += len(held[-1][0])
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def payload(parent, word, c):
        return {"prob": _code((c - discount) / model(stage).counts(parent, k - 2))} | (_counted(parent, word, c) if room else {})

    def backs(node, mass):
        made = []
        cut = np.flatnonzero(np.diff(node // np.uint64(SHARD), prepend=np.uint64(2**63)))
        for a, b in zip(cut, [*cut[1:], len(node)]):
            x, first = node[a:b].astype(np.int64), int(node[a])
            left = np.zeros(x[-1] - first + 1, np.uint16)  # 0: no children kept
            left[x - first] = np.maximum(_code(1 - mass[a:b] / model(stage).counts(x, k - 2)), 1)
            elias_fano.save(os.path.join(folder, f"back{k}-{first}"), {"left": left})
            made.append({"kind": f"back{k}", "parent": "0", "word": str(first), "n": len(x), "file": f"back{k}-{first}", "cut": [], "weight": []})
        return made

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        parent, word, n = _summed(*(np.concatenate(x) for x in zip(*map(_opened, rows["block"]))))
        keep = n >= least
        parent, word, n = parent[keep], word[keep], n[keep]
        made = [_write_shard(folder, f"level{k}", parent[i : i + SHARD], word[i : i + SHARD], n[i : i + SHARD], payload, room) for i in range(0, len(n), SHARD)]
        if len(n):
            cut = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            node, total, kinds = parent[cut], np.add.reduceat(n, cut), np.diff(np.append(cut, len(n)))
            if int(node[0]) in split:  # its other children are in other buckets: added up below
                made.append({"kind": "part", "parent": str(int(node[0])), "word": "0", "n": int(total[0]), "file": "", "cut": [int(kinds[0])], "weight": []})
            else:
                made += backs(node, total - discount * kinds)
        return pa.Table.from_pylist(made, _SHARD).to_pandas()

    blocks = docs.mapInArrow(count, "bucket int, block binary")
    made = blocks.groupBy("bucket").applyInPandas(write, _SHARD_DDL).collect()  # one row per shard
    tokens, kinds = {}, {}
    for r in made:
        if r["kind"] == "part":
            p = int(r["parent"])
            tokens[p], kinds[p] = tokens.get(p, 0) + r["n"], kinds.get(p, 0) + r["cut"][0]
    rest = [x for p in sorted(tokens) for x in backs(np.array([p], np.uint64), np.array([tokens[p] - discount * kinds[p]]))]
    return _in_order([r for r in made if r["kind"] == f"level{k}"]), _in_order([r for r in made if r["kind"] == f"back{k}"] + rest)


def train(docs: DataFrame, order: int = ORDER, least: int = MIN_COUNT, discount: float = DISCOUNT) -> str:
    """Learn from every text of ``docs(text)``; the folder of the finished trie."""
    spark = docs.sparkSession
    folder = os.path.join(_mounted(checkpoint_dir(spark)), f"gw-trie-{uuid.uuid4().hex}")
    os.makedirs(folder)
    texts = docs.select(text_or_empty().alias("text"))

    def count_words(batches):
        for b in batches:
            for some in _steps(b.column("text")):
                distinct, flat, _ = number(some)
                yield pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(flat, minlength=len(distinct)))], ["w", "n"])

    words = texts.mapInArrow(count_words, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    # signed numbers in the order of the unsigned hashes: those with the top bit flipped
    h = F.xxhash64("w").bitwiseXOR(F.lit(-(2**63)).cast("bigint"))
    with intermediates(spark):
        words = cut_lineage(words.select(h.alias("h"), "n", (F.col("w") == F.lit(START)).alias("start")))
        tell = words.agg(F.count(F.lit(1)), F.sum(F.when(~F.col("start"), F.col("n"))), F.count(F.when(~F.col("start"), 1))).first()
        facts = {"N": int(tell[1] or 0), "V": int(tell[2]), "order": order, "levels": [], "backs": []}
        room = max(1, min(BUCKET_TOKENS, facts["N"] // BUCKETS))
        shards = _vocabulary(words.groupBy(F.col("h").alias("word")).agg(F.sum("n").alias("n")), folder, tell[0], room)
    stage = folder
    for k in range(1, order + 1):
        if k > 1:
            shards, backs = _level(texts, folder, stage, k, least, discount, begins, room if k < order else 0)
            facts["backs"].append(backs)
        begins = _buckets(shards, room, tell[0])
        facts["levels"].append(shards)
        stage = os.path.join(folder, f"upto-{k}") if k < order else folder  # what tasks open while a level is made
        os.makedirs(stage, exist_ok=True)
        up = "../" if k < order else ""
        with open(os.path.join(stage, "model.json.new"), "w") as f:
            json.dump(facts | {part: [[{"parent": s["parent"], "word": s["word"], "n": s["n"], "file": up + s["file"]} for s in x] for x in facts[part]] for part in ("levels", "backs")}, f)
        os.replace(os.path.join(stage, "model.json.new"), os.path.join(stage, "model.json"))
    return folder


def score_texts(docs: DataFrame, folder: str) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_tokens, n_known, base_score, score per row."""

    def score(batches):
        for b in batches:
            ids = b.column("doc_id")
            at = 0
            for texts in _steps(b.column("text")):
                got = model(folder).score(texts)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), *(pa.array(got[k]) for k in ("n_tokens", "n_known", "base_score", "score"))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def score_corpus(docs: DataFrame, order: int = ORDER, least: int = MIN_COUNT) -> DataFrame:
    """Learn from the documents outside the held-out tenth and score all."""
    held = F.coalesce(remainder("doc_id", 10) == 0, F.lit(True))
    folder = train(docs.where(~held), order, least)
    n = model(folder).n
    return score_texts(docs, folder).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
