"""Scores, links and rules against plain Python and DuckDB; accuracy on held-out rows."""

from __future__ import annotations

import json
import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridweave.llm import adaptive_rules, catalog, elias_fano, itq, ngram_trie, quality_mil
from gridweave.llm.common import checkpoint_dir, cut_lineage
from gridweave.llm.common import read

from .test_brute import ODD, SCHEMA, SF, ascii_lower, odd, split, texts

MID = "/root/testdata/sf0.01"


def held(d, n):
    return d is None or zlib.crc32(str(d).encode()) % n == 0


def brute_scores(rows, order, least=2, discount=0.75):
    lists = [(d, split(ascii_lower(t)) + ["</>"]) for d, t in rows]
    learn = [["<>"] + ws for d, ws in lists if not held(d, 10)]
    c = [None] + [Counter(tuple(ws[i : i + k]) for ws in learn for i in range(len(ws) - k + 1)) for k in range(1, order + 1)]
    n = sum(v for g, v in c[1].items() if g != ("<>",))
    v = sum(1 for g in c[1] if g != ("<>",))
    bottom = lambda w: (c[1][w,] + 0.1) / (n + 0.1 * (v + 1))
    kept = [None, c[1]] + [{g: m for g, m in c[k].items() if m >= least} for k in range(2, order + 1)]
    mass = [defaultdict(float) for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g, m in kept[k].items():
            mass[k][g[:-1]] += m - discount

    def p(g):
        if len(g) == 1:
            return bottom(g[0])
        h = g[:-1]
        lower = p(g[1:])
        seen = c[len(h)].get(h, 0) if h in (kept[len(h)] if len(h) > 1 else c[1]) else 0
        if not seen:
            return lower
        return (max(0, kept[len(g)].get(g, 0) - discount) if g in kept[len(g)] else 0) / seen + (1 - mass[len(g)][h] / seen) * lower

    out = {}
    for i, (d, ws) in enumerate(lists):
        full = ["<>"] + ws
        score = sum(math.log10(p(tuple(full[max(0, j - order + 1) : j + 1]))) for j in range(1, len(full)))
        base = sum(math.log10(bottom(w)) for w in ws)
        out[i] = (d, held(d, 10), len(ws), sum(c[1][w,] > 0 for w in ws), n, base, score)
    return list(out.values())


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("which", ["given", "odd"])
def test_trie(spark, which, order):
    docs = read(spark, SF, "documents").where("doc_id < 120") if which == "given" else odd(spark, ODD)
    want = sorted(brute_scores([(d, t) for d, t, _ in texts(docs)], order), key=str)
    got = sorted((tuple(r) for r in ngram_trie.score_corpus(docs, order).collect()), key=str)
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 3))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(g[6] - w[6]) <= 2e-3 * g[2] + 1e-6


def test_registered_trie_is_whole(spark):
    """Order 3 with every n-gram that was seen, also those seen once."""
    rows = [(r.doc_id, r.text or "") for r in read(spark, SF, "documents").collect()]
    want = {r[0]: r for r in brute_scores(rows, 3, least=1)}
    got = catalog.op1_elias_fano_trie(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r.score - want[r.doc_id][6]) <= 2e-3 * r.n_tokens + 1e-6


@pytest.mark.parametrize("order", [2, 3])
def test_kept_pairs_of_a_hot_context(spark, order):
    """A context whose kept pairs hold less mass than a step of the stored logarithms."""
    rows = [(1, " ".join(f"h u{i}" for i in range(20_000)) + " h k h k"), (2, "h k")]
    want = {r[0]: r[6] for r in brute_scores(rows, order)}
    got = {r.doc_id: r.score for r in ngram_trie.score_corpus(odd(spark, [(*r, "s") for r in rows]), order).collect()}
    assert not held(1, 10) and abs(got[2] - want[2]) <= 6e-3


def test_trie_without_training_texts(spark):
    got = ngram_trie.score_corpus(spark.createDataFrame([(None, "a b", None, None, None, None, None, None)], SCHEMA)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)]
    assert ngram_trie.score_corpus(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trie_shards_split_a_parent(spark, monkeypatch):
    monkeypatch.setattr(ngram_trie, "SHARD", 7)
    docs = read(spark, SF, "documents").where("doc_id < 12")
    want = {r[0]: r for r in brute_scores([(d, t) for d, t, _ in texts(docs)], 3)}
    for r in ngram_trie.score_corpus(docs, 3).collect():
        assert abs(r.score - want[r.doc_id][6]) <= 2e-3 * r.n_tokens


def test_trie_words_are_those_of_the_contract():
    """Arrow's words and starts against plain splitting."""
    given = ["", " ", "A b\x1cc\x85d\u3000e \u00c4\u00d6\x0b\x0cq\tz\r\nX  ", "a", "\0 \x1f a A", "\n\n"]
    words, flat, begins = ngram_trie.number(pa.array(["x", *given]).slice(1))
    words = words.to_pylist()
    want = [[b" <s>", *(w.encode() for w in split(ascii_lower(t))), b" </s>"] for t in given]
    assert [words[i] for i in flat] == [w for x in want for w in x]
    assert begins.tolist() == np.cumsum([0, *map(len, want)])[:-1].tolist() and len(set(words)) == len(words)


def test_level_finds_nodes_places_and_masses(tmp_path):
    """Shards that cut a parent's children, against a dictionary."""
    rng = np.random.default_rng(3)
    pairs = sorted({(int(p), int(w)) for p, w in zip(rng.integers(0, 9, 300) ** 2, rng.integers(0, 2_000, 300) ** 2)} | {(25, w) for w in range(3, 90)})
    parent, word = np.array(pairs, np.uint64).T
    load = lambda p, w, n: {"prob": n.astype(np.uint16)}
    for size in (7, 100, 1_000):
        cuts = range(0, len(pairs), size)
        made = [ngram_trie._write_shard(str(tmp_path), f"s{size}", parent[i : i + size], word[i : i + size], np.arange(i, len(pairs))[:size], load) for i in cuts]
        level = ngram_trie.Level(str(tmp_path), ngram_trie._in_order(made))
        ask = sorted({*pairs, *((int(p), int(w)) for p, w in zip(rng.integers(0, 70, 900), rng.integers(0, 5_000_000, 900)))} | {(25, 91), (25, 2), (0, 0)})
        node, place, prob = level.find(*np.array(ask, np.uint64).T, "prob")
        at, begin = {g: i for i, g in enumerate(pairs)}, {}
        for i, (p, _) in enumerate(pairs):
            begin.setdefault(p, i)
        assert node.tolist() == [at.get(g, -1) for g in ask]
        assert [(x, n) for x, n in zip(place, prob) if x >= 0] == [(at[g] - begin[g[0]], at[g]) for g in ask if g in at]
    for first, left in ((4, [9, 0, 7]), (20, [1])):
        elias_fano.save(str(tmp_path / f"back{first}"), {"left": np.array(left, np.uint16)})
    backs = ngram_trie.Level(str(tmp_path), [{"parent": 0, "word": w, "n": 1, "file": f"back{w}"} for w in (4, 20)])
    assert backs.left(np.array([21, 0, 4, 5, 6, 7, 20], np.uint64)).tolist() == [0, 0, 9, 0, 7, 0, 1]


@pytest.mark.parametrize("order", [2, 3])
def test_trie_searches_each_ngram_once(spark, monkeypatch, order):
    """Bits looked for when texts are scored, for each of their distinct n-grams: 1.0 at order 2
    and 1.3 at order 3, before 2.0 and 2.6."""
    rng = np.random.default_rng(5)
    given = [" ".join(f"w{x}" for x in rng.integers(0, 40, 60)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in given], "text string")
    trie = ngram_trie.Model(ngram_trie.train(df, order, 1))
    asked, select = [], elias_fano.EliasFano._select
    monkeypatch.setattr(elias_fano.EliasFano, "_select", lambda self, k, ones: (asked.append(len(k)), select(self, k, ones))[1])
    trie.score(pa.array(given * 3))
    lists = [["<>", *t.split(), "</>"] for t in given]
    grams = sum(len({tuple(x[i : i + k]) for x in lists for i in range(len(x) - k + 1)}) for k in range(1, order + 1))
    assert sum(asked) <= 1.5 * grams


def test_walk_numbers_without_room():
    """Places sorted with their pairs, and without where both have no room in 64 bits."""
    rng = np.random.default_rng(6)
    at, begins = rng.integers(0, 50, 2_000).astype(np.int32), np.arange(0, 2_000, 100)
    node = np.where(np.arange(50) % 7 == 3, -1, rng.permutation(50))
    plain, wide = ngram_trie.Walk(at, node, begins), ngram_trie.Walk(at, node, begins)
    wide.bits = 50
    for a, b in zip((*plain.pairs(), *plain.counted()), (*wide.pairs(), *wide.counted())):
        assert (a == b).all()
    parent, word, n = plain.counted()
    pairs = [(node[at[i - 1]], node[at[i]]) for i in range(2_000) if i % 100 and node[at[i - 1]] >= 0 and node[at[i]] >= 0]
    assert sorted(Counter(pairs).items()) == [((p, w), c) for p, w, c in zip(parent, word, n)]


def test_held_out_texts_gain(spark):
    rows = [r for r in catalog.op1_elias_fano_trie(spark, MID).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((1, 1), (5, 3), (1000, 50), (1000, 10**6), (3000, 2**62)):
        v = np.sort(rng.integers(0, u, n, dtype=np.uint64))
        e = elias_fano.EliasFano(*elias_fano.build(v, "x"), "x")
        assert (e.at(np.arange(n)) == v).all()
        q = np.concatenate([v, rng.integers(0, u + 3, 1000, dtype=np.uint64)])
        first, then = e.range(np.arange(n - 1))
        assert (first == v[:-1]).all() and (then == v[1:]).all()
        where, same = e.successor(q)
        assert (where == np.searchsorted(v, q, "left")).all() and (same == np.isin(q, v)).all()


def brute_links(rows):
    ok = [r is not None and len(r) > 0 and all(x is not None and math.isfinite(x) for x in r) and any(r) for _, r, _ in rows]
    n = len(rows)
    links = defaultdict(set)
    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
    comp = [None] * n
    for i in range(n):
        if comp[i] is None:
            todo, group = [i], {i}
            while todo:
                for k in links[todo.pop()] - group:
                    group.add(k)
                    todo.append(k)
            low = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
            for k in group:
                comp[k] = (low,)
    return Counter((rows[i][0], len(links[i]), comp[i][0], rows[i][0] == comp[i][0]) for i in range(n))


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 24)).astype(np.float32)
    rows = [(i, base[i % 40] + rng.standard_normal(24).astype(np.float32) * 0.09 * (i // 40), i % 3 if i % 40 else 0) for i in range(160)]
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    rows += [(200, None, 0), (201, [], 0), (202, [0.0] * 24, 0), (203, [None] + [1.0] * 23, 0), (204, [float("nan")] + [1.0] * 23, 0), (205, [float("inf")] * 24, 0)]
    rows += [(206, rows[0][1], None), (207, rows[0][1], 0), (207, rows[0][1], 0), (None, rows[0][1], 0), (208, [1.0, 2.0], 0), (209, [2.0, 4.0], 0), (210, [x * 0.5 for x in rows[0][1]], 0)]
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, node string")
    want, got = brute_links(rows), Counter(tuple(r) for r in itq.near_duplicates(df).collect())
    assert got == want
    assert itq.near_duplicates(df.where("false")).count() == 0


class Learned(Exception):
    pass


def test_embeddings_sample(spark, monkeypatch):
    """What the sample sends to the driver doesn't grow with the partitions."""

    def learn(x):
        raise Learned(x)

    monkeypatch.setattr(itq, "SAMPLE", 500)
    monkeypatch.setattr(itq, "learn", learn)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((12_000, 64)).astype(np.float32)
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "label": np.arange(len(x)) % 3, "embedding": list(x)}))
    # one vector under many labels counts once for each
    many = rows.where("vec_id = 0").select("vec_id", F.explode(F.expr("sequence(3L, 9000L)")).alias("label"), "embedding")
    conf, most = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize"
    nodes_of = itq.nodes_of
    for df in (rows, rows.unionByName(many)):
        nodes = nodes_of(df.withColumn("ok", itq.usable()).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(17), "embedding")))
        nodes = cut_lineage(nodes.repartition(48, "node"))
        monkeypatch.setattr(itq, "nodes_of", lambda _, nodes=nodes: nodes)
        of = nodes.select("embedding", F.xxhash64("h1", "h2").alias("h")).toArrow().sort_by("h")
        conf.set(most, "1m")  # 500 vectors of each of 48 partitions are some 4 MB
        try:
            with pytest.raises(Learned) as got:
                itq.near_duplicates(df)
        finally:
            conf.remove(most)
        assert (got.value.args[0] == itq._unit(np.stack(of["embedding"].to_numpy()[:500]).astype(np.float64))).all()


def test_embeddings_blocks(spark, monkeypatch):
    """Labels cut into blocks, small labels in common tasks: links stay those of all pairs."""
    judged, pairs = [], itq.pairs
    monkeypatch.setattr(itq, "pairs", lambda nodes, cosine: judged.append(pairs(nodes, cosine, 6_000).cache()) or judged[-1])
    rng = np.random.default_rng(14)
    base = rng.standard_normal((30, 20)).astype(np.float32)
    rows = [(i, (base[i % 30] + rng.standard_normal(20).astype(np.float32) * 0.11 * (i % 3)).tolist(), [0, 0, 0, 1, 2 + i % 97][i % 5]) for i in range(600)]
    rows += [(600 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 7)] + [(700 + i, rows[i][1][:11], 0) for i in range(90)]
    rows += [(800 + i, [x * 2 for x in rows[i][1]], rows[i][2]) for i in range(0, 60, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert Counter(tuple(r) for r in itq.near_duplicates(df).collect()) == brute_links(rows)
    assert judged[0].where("n is null").count() and judged[0].where("n is not null").count()  # both ways were taken
    judged[0].unpersist()


@pytest.mark.parametrize("nx, ny", [(1500, 1800), (3000, 1100), (50, 2000), (700, 600)])
def test_codes_meet(nx, ny):
    rng = np.random.default_rng(nx)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)

    def codes(n):
        c = base[rng.integers(0, 40, n)]
        for _ in range(14):
            c ^= (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) * (rng.random(n) < 0.7).astype(np.uint64)
        return c

    x, y = codes(nx), codes(ny)
    for other in (y, None):
        apart = x[:, None] ^ (x if other is None else other)[None, :]
        band = np.any([np.bitwise_count(apart >> np.uint64(16 * t) & np.uint64(0xFFFF)) <= 2 for t in range(4)], axis=0)
        want, got = band & (np.bitwise_count(apart) <= itq.NEAR), np.zeros(apart.shape, int)
        for a, b in itq.meet(x, other):
            np.add.at(got, (np.minimum(a, b), np.maximum(a, b)) if other is None else (a, b), 1)
        assert want.sum() > 10 and (got == (np.triu(want, 1) if other is None else want)).all()


def test_codes_recall():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, axes = itq.learn(x)
    y = x + rng.standard_normal(x.shape) * 0.025
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (x * y).sum(1) >= 0.98
    a, b = (x - mean) @ axes > 0, (y - mean) @ axes > 0
    diff = (a != b).reshape(len(x), -1, itq.BAND).sum(2)
    found = ((diff <= 2).any(1) & (diff.sum(1) <= itq.NEAR))[near]
    assert near.sum() > 500 and found.mean() > 0.995
    assert abs(a.mean(0) - 0.5).max() < 0.1  # balanced


def test_rules_against_duckdb(spark, tmp_path):
    docs = read(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    more = odd(spark, ODD + [(50 + i, ("w%d " % i) * 3 + "a b c " * i + "\nx y\nx y\n \n", "hot") for i in range(80)])
    docs = docs.unionByName(more.select("doc_id", "text", "lang", "source", "n_chars"))
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = Counter(con.execute(adaptive_rules.ORACLE).fetchall())
    got = Counter(tuple(r) for r in adaptive_rules.apply_rules(docs).collect())
    assert got == want
    assert adaptive_rules.apply_rules(docs.where("false")).count() == 0


def test_rules_keep_good_documents(spark):
    good = {r.doc_id for r in read(spark, MID, "labels").where("quality = 1 and toxic = 0").collect()}
    rows = [r for r in catalog.op9_adaptive_rules(spark, MID).collect() if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in rows) >= 0.97 * len(rows)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    y = {r.doc_id: r.quality for r in read(spark, sf, "labels").collect()}
    rows = [(r.score, r.predicted, y[r.doc_id]) for r in catalog.op6_quality_mil(spark, sf).collect() if r.held_out and r.doc_id in y]
    good, bad = [s for s, _, q in rows if q], [s for s, _, q in rows if not q]
    assert len(good) > 300 and len(bad) > 50
    order = np.argsort([s for s, _, _ in rows])
    rank = np.empty(len(rows))
    rank[order] = np.arange(1, len(rows) + 1)
    auc = (sum(r for r, (_, _, q) in zip(rank, rows) if q) - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert auc > 0.95
    assert np.mean([p for _, p, q in rows if q]) > 0.98


def test_quality_odd_rows(spark):
    docs = odd(spark, ODD)
    labels = spark.createDataFrame([(d, k % 2) for k, (d, _, _) in enumerate(ODD)] + [(3, None), (99, 1)], "doc_id long, quality int")
    got = quality_mil.quality_scores(docs, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    none = quality_mil.quality_scores(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_mil.quality_scores(docs.where("false"), labels).count() == 0


def test_passages_cover_whole_texts():
    made = [b"", b"a", b"x" * 511, b"y" * 512, b"z" * 5000, "é".encode() * 700]
    data = np.frombuffer(b"".join(made), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(m) for m in made])])
    x, first = quality_mil.encode(data, starts)
    assert np.diff(first).tolist() == [1, 1, 1, 1, 10, 3]
    for k, m in enumerate(made):
        alone, _ = quality_mil.encode(np.frombuffer(m, np.uint8), np.array([0, len(m)]))
        assert np.allclose(alone, x[first[k] : first[k + 1]])


def test_trie_leaves_no_tables_and_splits_hot_contexts(spark, monkeypatch):
    """Buckets by range write their shards themselves (op1: over the check's disk before)."""
    folder = ngram_trie._mounted(checkpoint_dir(spark))
    before = set(os.listdir(folder))
    monkeypatch.setattr(ngram_trie, "BUCKETS", 500)
    rows = [(i, " ".join(f"h u{(i * 7 + k) % 90}" for k in range(40)) + " h k h k", "s") for i in range(1, 60)]
    want = {r[0]: r for r in brute_scores([r[:2] for r in rows], 3, least=1)}
    for r in ngram_trie.score_corpus(odd(spark, rows), 3, 1).collect():
        assert abs(r.score - want[r.doc_id][6]) <= 2e-3 * r.n_tokens
    (made,) = set(os.listdir(folder)) - before
    with open(os.path.join(folder, made, "model.json")) as f:
        m = json.load(f)
    parents = [s["parent"] for s in m["levels"][1]]
    assert made.startswith("gw-trie-") and len(parents) > len(set(parents))
