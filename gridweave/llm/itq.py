"""Near-duplicate embeddings by iterative quantisation.

A rotation of the vectors' principal directions is learned on a bounded sample so that the
signs of the rotated vectors are balanced binary codes (``BITS`` bits; other lengths than the
sample's get signs of a fixed random projection). Codes are cut into bands of ``BAND`` bits; two vectors
whose codes differ in at most ``REACH`` bits differ in at most two bits of some band, so each
band's index, asked for a value and its variants within two flips, finds them. A pair is taken
in the first band where it is found, so once, and only within ``NEAR`` differing bits. Those
whose cosine is at least ``cosine`` are links. Equal vectors of a label are one node with a count,
so copies make no pairs.

A large label is cut into blocks of nodes, and a task compares two blocks, so a task's memory is
bounded whatever the labels; small labels share tasks. A task holds the codes and the vectors
rounded to a byte a component, with the exact norm of what rounding took away: that bounds the cosine
from both sides and decides all pairs but those next to the limit, which are judged by the cosine
of the original vectors in double precision. Links stay in their task: it returns each node's
number of links and one node that it is connected with.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and rows without a label, link with nothing; rows with equal ``vec_id`` are separate vectors; only vectors of equal
length are compared; a component's id is its smallest ``vec_id`` that is not null; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import cut_lineage
from gridweave.llm.components import connected_components

COSINE, SAMPLE, BITS, BAND, NEAR, ROUNDS = 0.98, 20_000, 64, 16, 18, 50
REACH = 3 * (BITS // BAND) - 1
#: Bytes of one block of nodes (a component is one, a node has some ``NODE_BYTES`` more), the
#: rows of a label looked at one by one rather than by bands, and pairs at a time.
BLOCK_BYTES, NODE_BYTES, FEW, CHUNK = 48 << 20, 64, 1000, 1 << 16
#: Flips of at most two bits of a band.
FLIPS = [sum(1 << k for k in c) for n in range(3) for c in combinations(range(BAND), n)]


def learn(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions by bits) of iterative quantisation on unit vectors."""
    mean = x.mean(0)
    z = x - mean
    _, axes = np.linalg.eigh(z.T @ z)
    axes = axes[:, ::-1][:, :bits]
    z = z @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((z.shape[1],) * 2))
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(z @ turn).T @ z)
        turn = (u @ vt).T
    return mean, axes @ turn


def _matrix(vectors: pa.Array):
    """Rows of a list array by length: (places, matrix in double precision)."""
    vectors = vectors.cast(pa.large_list(pa.float64())) if not pa.types.is_large_list(vectors.type) else vectors
    at = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield int(n), rows, flat[at[rows][:, None] + np.arange(n)].astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def encoder(dim: int, mean: np.ndarray, axes: np.ndarray):
    """For ``mapInArrow``: ``embedding`` is replaced by its code and its unit vector in whole
    multiples (q) of a step, off by a vector of length err."""

    def encode(batches):
        for b in batches:
            code, step, err = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows), np.zeros(b.num_rows)
            q = np.empty(b.num_rows, object)
            for n, rows, x in _matrix(b.column("embedding")):
                m, p = (mean, axes) if n == dim else (0.0, np.random.default_rng(n).standard_normal((n, BITS)))
                x = _unit(x)
                on = (x - m) @ p > 0
                code[rows] = (on.astype(np.uint64) << np.arange(on.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)
                step[rows] = by = np.abs(x).max(1) / 127
                near = np.rint(x / by[:, None])
                err[rows] = np.sqrt(((x - near * by[:, None]) ** 2).sum(1))
                q[rows] = [r.tobytes() for r in near.astype(np.int8)]
            kept = [c for c in b.schema.names if c != "embedding"]
            new = [pa.array(code.view(np.int64)), pa.array(step), pa.array(err), pa.array(q, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + new, [*kept, "code", "step", "err", "q"])

    return encode


def _cosines(a: pa.Array, b: pa.Array) -> pa.Array:
    out = np.zeros(len(a))
    for (_, rows, x), (_, _, y) in zip(_matrix(a), _matrix(b)):
        x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
        out[rows] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
    return pa.array(out)


def usable() -> Column:
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row per distinct vector of a label: node, its key (label, h1, h2), copies, vector
    and its length d."""
    grouped = rows.where("ok").groupBy("label", "h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    return cut_lineage(grouped.withColumn("node", F.monotonically_increasing_id()).withColumn("d", F.size("embedding")))


def sample(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The commonest length and the ``SAMPLE`` vectors of that length with the smallest hashes,
    in their order; a vector counts once for each of its labels.

    A bound on the hash is found by counts first, so that little more than the sample leaves
    the executors however many partitions there are."""
    d = nodes.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if d is None:
        return 0, np.zeros((0, 0))
    those = nodes.where(F.col("d") == d["d"]).withColumn("h", F.xxhash64("h1", "h2"))
    share = 1.1 * SAMPLE / d["count"]
    while True:
        few = those.where(F.col("h") < F.lit(int(share * 2.0**64) - 2**63)) if share < 1 else those
        if share >= 1 or few.count() >= SAMPLE:
            break
        share *= 4
    few = few.groupBy("h", "h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.first("embedding").alias("embedding"))
    got = few.orderBy("h", "h1", "h2").limit(SAMPLE).select("h", "times", "embedding").toArrow()
    at = np.argsort(got["h"].to_numpy(), kind="stable")
    at = np.repeat(at, np.minimum(got["times"].to_numpy()[at], SAMPLE))[:SAMPLE]
    ((_, _, x),) = _matrix(got["embedding"].combine_chunks())
    return d["d"], x[at]


def _near(cx: np.ndarray, cy: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Pairs within ``NEAR`` bits of code x[i] and each of the ``size[i]`` codes y from
    ``start[i]`` on: (i, j, differing bits), some at a time."""
    ends = np.cumsum(size)
    lo, before = 0, 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
        n, upto = size[lo:hi], ends[lo:hi] - before
        j = np.arange(upto[-1]) + np.repeat(start[lo:hi] - (upto - n), n)
        x = np.repeat(cx[lo:hi], n) ^ cy[j]
        hit = np.flatnonzero(np.bitwise_count(x) <= NEAR)
        if len(hit):
            yield lo + np.searchsorted(upto, hit, "right"), j[hit], x[hit]
        lo, before = hi, int(ends[hi - 1])


def _part(code: np.ndarray, t: int) -> np.ndarray:
    return (code >> np.uint64(BAND * t)).astype(np.uint16)


def meet(cx: np.ndarray, cy: np.ndarray | None = None):
    """(i, j) of the codes of x and y (if None, of x and later ones of x) that differ in at most
    two bits of some band and ``NEAR`` in all, each once, some at a time."""
    same = cy is None
    cy = cx if same else cy
    bands = range(BITS // BAND)
    if min(len(cx), len(cy)) <= FEW:
        start = np.arange(1, len(cx) + 1) if same else np.zeros(len(cx), np.int64)
        for i, j, x in _near(cx, cy, start, len(cy) - start):
            ok = np.any([np.bitwise_count(_part(x, t)) <= 2 for t in bands], axis=0)
            yield i[ok], j[ok]
        return
    for t in bands:
        ox, oy = (np.argsort(_part(c, t), kind="stable") for c in (cx, cy))
        sx, sy = cx[ox], cy[oy]
        v = _part(sx, t).astype(np.int64)
        at = np.searchsorted(_part(sy, t), np.arange((1 << BAND) + 1))
        size = np.diff(at)
        for m in FLIPS:
            to, rows = v ^ m, None
            start, n = at[to], size[to]
            if same and m == 0:  # each pair from one side
                start, n = np.arange(1, len(v) + 1), at[v + 1] - np.arange(1, len(v) + 1)
            elif same:
                n[to < v] = 0
            if 2 * np.count_nonzero(n) < len(n):
                rows = np.flatnonzero(n)
                start, n = start[rows], n[rows]
            for i, j, x in _near(sx if rows is None else sx[rows], sy, start, n):
                for s in range(t):  # found in an earlier band
                    new = np.bitwise_count(_part(x, s)) > 2
                    i, j, x = i[new], j[new], x[new]
                yield ox[i if rows is None else rows[i]], oy[j]


class Links:
    """Links between places: what each is connected with, and the copies it is linked to."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.others, self.root = copies, np.zeros(len(copies), np.int64), np.arange(len(copies))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.others, a, self.copies[b])
        np.add.at(self.others, b, self.copies[a])
        self.waiting.append((a, b))
        if sum(len(x) for x, _ in self.waiting) > 4 * CHUNK:
            self.join()

    def join(self) -> None:
        if not self.waiting:
            return
        a, b = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting = []
        while True:
            a, b = self.root[a], self.root[b]
            apart = a != b
            if not apart.any():
                return
            a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.root, b, a)
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _judge(q: np.ndarray, step: np.ndarray, err: np.ndarray, far: float):
    """A function of places a, b: whether their chord's half square is surely at most ``far``,
    and whether it may be."""
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # dot products are whole
    square = np.concatenate([(q[lo : lo + CHUNK].astype(np.int64) ** 2).sum(1) for lo in range(0, len(q), CHUNK)]) * step**2

    def judge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dot = np.einsum("ij,ij->i", q[a].astype(exact), q[b].astype(exact)).astype(np.float64)
        chord = np.sqrt(np.maximum(square[a] + square[b] - 2 * step[a] * step[b] * dot, 0))
        off = err[a] + err[b] + 1e-7
        return (chord + off) ** 2 / 2 < far - 1e-9, np.maximum(chord - off, 0) ** 2 / 2 <= far + 1e-9

    return judge


def compared(batches: list[pa.RecordBatch], cosine: float):
    """The pairs of a task's nodes: rows (a, b, null) for pairs to be judged, and at the end
    (a, b, n) for each node a that is connected with b, with n links. Empties the list."""
    table = pa.Table.from_batches(batches)
    batches.clear()
    two = table["i"][0] != table["j"][0]  # two blocks, or one
    label = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    second = table["second"].to_numpy()
    order = np.lexsort((second, label, table["d"].to_numpy()))
    label, second = label[order], second[order]
    d, node, copies, code, step, err = (table[c].to_numpy()[order] for c in ("d", "node", "copies", "code", "step", "err"))
    code, place = code.view(np.uint64), np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    cuts = [0, *(np.flatnonzero(np.diff(d)) + 1), len(d)]
    vectors = [np.empty((hi - lo, d[lo]), np.int8) for lo, hi in zip(cuts, cuts[1:])]
    done = 0
    for q in table["q"].chunks:
        q = q.cast(pa.large_binary())
        at, data = np.frombuffer(q.buffers()[1], np.int64)[q.offset :][: len(q) + 1], np.frombuffer(q.buffers()[2], np.int8)
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            to = place[done : done + len(q)]
            of = np.flatnonzero((lo <= to) & (to < hi))
            vectors[k][to[of] - lo] = data[at[of][:, None] + np.arange(d[lo])]
        done += len(q)
    del table, q, data, at, place, order
    links, schema = Links(copies), pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
    for first, last, of in zip(cuts, cuts[1:], vectors):
        judge, wide = _judge(of, step[first:last], err[first:last], 1 - cosine), max(1, 16 * CHUNK // of.shape[1])
        ends = [first, *(np.flatnonzero(np.diff(label[first:last])) + first + 1), last]
        for lo, hi in zip(ends, ends[1:]):
            mid = lo + int((~second[lo:hi]).sum())
            if two and not lo < mid < hi or hi - lo < 2:
                continue
            for a, b in meet(code[lo:mid], code[mid:hi]) if two else meet(code[lo:hi]):
                for k in range(0, len(a), wide):
                    x, y = a[k : k + wide] + lo, b[k : k + wide] + (mid if two else lo)
                    sure, may = judge(x - first, y - first)
                    if sure.any():
                        links.add(x[sure], y[sure])
                    if (may := may & ~sure).any():
                        x, y = pa.array(node[x[may]]), pa.array(node[y[may]])
                        yield pa.RecordBatch.from_arrays([x, y, pa.nulls(len(x), pa.int64())], schema=schema)
    links.join()
    some = np.flatnonzero(links.others)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[some], node[links.root[some]], links.others[some])], schema=schema)


def _tasks(batches):
    """The rows of each task, which follow one another."""
    kept, last = [], None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("cell", "i", "j")])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            if lo == hi:
                continue
            if kept and last != tuple(key[:, lo]):
                yield kept
                kept = []
            last = tuple(key[:, lo])
            kept.append(batch.slice(lo, hi - lo))
    if kept:
        yield kept


def pairs(nodes: DataFrame, cosine: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b, n) as :func:`compared` returns them, of all nodes."""
    spark = nodes.sparkSession
    dim, x = sample(nodes)
    mean, axes = learn(_unit(x)) if len(x) else (np.zeros(dim), np.zeros((dim, 0)))
    width = (F.col("d") + NODE_BYTES).cast("long")
    counts = cut_lineage(nodes.groupBy("label", "d").agg(F.count(F.lit(1)).alias("count")).withColumn("bytes", F.col("count") * width))
    every = counts.agg(F.sum("bytes")).first()[0] or 0
    # smaller blocks where they keep all cores at work
    block = min(block_bytes, max(block_bytes // 8, every // (2 * spark.sparkContext.defaultParallelism)))
    large = counts.where(F.col("bytes") > block // 4)  # so not many
    large = cut_lineage(large.select(F.col("label").alias("l"), F.col("d").alias("l_d"), F.ceil(F.col("bytes") / block).cast("int").alias("parts")))
    most = large.agg(F.sum(F.expr("parts * (parts + 1L) div 2"))).first()[0] or 0
    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * most, 4 * every // block_bytes if block else 1)
    coded = nodes.select("label", "d", "node", "copies", "embedding")
    fields = [f"{c} {t}" for c, t in coded.dtypes if c != "embedding"] + ["code long", "step double", "err double", "q binary"]
    coded = coded.mapInArrow(encoder(dim, mean, axes), ", ".join(fields))
    coded = coded.join(F.broadcast(large), (F.col("label") == F.col("l")) & (F.col("d") == F.col("l_d")), "left")
    own = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")
    key = F.xxhash64("label", "d")
    coded = coded.withColumn("own", own).withColumn("cell", F.when(F.col("parts").isNull(), F.pmod(key, F.lit(deal).cast("long"))).otherwise(key))
    sent = coded.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    sent = sent.select(
        "label", "d", "node", "copies", "code", "step", "err", "q", "cell", F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"),
    )

    def compare(batches):
        for task in _tasks(batches):
            yield from compared(task, cosine)

    dealt = sent.repartition(deal, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return dealt.mapInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    rows = vectors.select("vec_id", "label", "embedding", usable().alias("ok"))
    rows = rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(17), "embedding"))
    narrow = cut_lineage(rows.select("vec_id", "label", "ok", "h1", "h2"))
    nodes = nodes_of(rows)
    left = nodes.select(F.col("node").alias("a"), F.col("embedding").alias("ea"))
    right = nodes.select(F.col("node").alias("b"), F.col("embedding").alias("eb"))
    found = cut_lineage(pairs(nodes, cosine))
    close = found.where("n is null").select("a", "b").join(left, "a").join(right, "b")
    links = cut_lineage(close.where(F.arrow_udf(_cosines, "double")("ea", "eb") >= cosine).select("a", "b"))
    copies = nodes.select("node", "copies")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = ends.join(copies, F.col("b") == F.col("node")).select("a", F.col("copies").alias("n"))
    sure = found.where("n is not null")
    others = ends.unionByName(sure.select("a", "n")).groupBy(F.col("a").alias("n2")).agg(F.sum("n").alias("others"))
    comp = connected_components(links.unionByName(sure.select("a", "b")))
    named = nodes.select("node", "label", "h1", "h2", "copies").join(comp.withColumnRenamed("node", "n3"), F.col("node") == F.col("n3"), "left")
    named = named.join(others, F.col("node") == F.col("n2"), "left")
    named = named.select(F.col("label").alias("l"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.coalesce("component", "node").alias("top"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    marked = cut_lineage(narrow.join(named, F.col("ok") & (F.col("label") == F.col("l")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left"))
    lowest = marked.where("top is not null").groupBy(F.col("top").alias("top2")).agg(F.min("vec_id").alias("least"))
    done = marked.join(lowest, F.col("top") == F.col("top2"), "left").withColumn("component_id", F.when(F.col("top").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    return done.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
