"""Importance resampling, vector codes and toxicity against plain Python; held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridweave.llm import catalog, dual_tree, resampling, toxicity, vector_code
from gridweave.llm.common import read

from .test_brute import ODD, SCHEMA, SF, odd, texts

MID = "/root/testdata/sf0.01"


# ---- importance resampling


def grams(text, n):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(ws[i : i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)], len(ws)


def brute_resample(docs, target, n, buckets):
    where = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(where(g) for _, x in docs for g in grams(x, n)[0]), Counter(where(g) for x in target for g in grams(x, n)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for d, x in docs:
        g, words = grams(x, n)
        weight = sum(gain(where(v)) for v in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter()
    for k, r in enumerate(able[: 10 * len(able) // 100], 1):
        drawn[tuple(r[:4]) + (k,)] += 1
    rows = Counter(tuple(r[:4]) for r in out)
    for r, m in drawn.items():
        rows[r[:4]] -= m
    return drawn + Counter({(*r, None): m for r, m in rows.items() if m > 0})


MORE = [(i, f"Word{i % 7} the9 é{i % 3} x-y " * (i % 40), "s") for i in range(10, 120)] + [(50, "a b " * 30, "s"), (50, "a b " * 30, "s"), (None, "z " * 25, None)]


@pytest.mark.parametrize("n, buckets", [(1, 10_000), (3, 64)])
@pytest.mark.parametrize("which", ["given", "odd"])
def test_resampling(spark, which, n, buckets):
    docs = read(spark, SF, "documents") if which == "given" else odd(spark, ODD + MORE)
    target = read(spark, SF, "benchmark")
    want = brute_resample([(d, t) for d, t, _ in texts(docs)], [r.text for r in target.collect()], n, buckets)
    got = resampling.resample(docs, target, n, buckets).collect()
    assert Counter(tuple(r) for r in got) == want
    ranks = sorted(r.rank for r in got if r.rank is not None)
    assert ranks and ranks == list(range(1, len(ranks) + 1))


def test_no_run_crosses_two_texts():
    parts = ["one two", "", "three", " - ", "four five six"]
    got = Counter()
    for doc, bucket in resampling.features([p.encode() for p in parts], 2, 1 << 32):
        got.update(zip(doc.tolist(), bucket.tolist()))
    assert got == Counter((i, zlib.crc32(g.encode())) for i, p in enumerate(parts) for g in grams(p, 2)[0])


def test_hashes_of_words_of_any_length():
    words = ["a" * k for k in range(1, 120)] + ["é" * 40, "x" * 200_000]
    doc, bucket = next(resampling.features([" ".join(words).encode()], 1, 1 << 32))
    assert bucket.tolist() == [zlib.crc32(w.encode()) for w in words]


def test_resampling_of_empty_tables(spark):
    none, one = spark.createDataFrame([], SCHEMA), odd(spark, [(1, "a " * 30, "s")])
    assert resampling.resample(none, one).collect() == []
    r = resampling.resample(one, none).first()
    assert (r.n_features, r["rank"]) == (30, None)


def test_the_draw_prefers_the_target(spark):
    rows = [(i, " ".join(("gold ore vein " if i % 2 else "salt sea foam ").split() * 10), "s") for i in range(400)]
    drawn = resampling.resample(odd(spark, rows), odd(spark, [(0, "gold ore vein " * 50, "s")])).where("rank is not null").collect()
    assert len(drawn) == 40 and sum(r.doc_id % 2 for r in drawn) >= 38


# ---- vector codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, label, list) of one length that ``parts`` divides."""
    kept = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return []
    w = len(kept[0][2]) // parts
    cut = [[tuple(v[k * w : k * w + w]) for _, _, v in kept] for k in range(parts)]
    books = [[c for c in part[:entries]] for part in cut]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for k, part in enumerate(cut):
            got = [near(p, books[k])[1] for p in part]
            for e in set(got):
                mine = [p for p, g in zip(part, got) if g == e]
                books[k][e] = tuple(sum(c) // len(mine) for c in zip(*mine))
    last = [[near(p, books[k]) for p in part] for k, part in enumerate(cut)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    err = [sum(last[k][i][0] for k in range(parts)) for i in range(len(kept))]
    per = Counter()
    for (_, lab, _), e in zip(kept, err):
        per[lab] += e
    return [(i, "".join(f"{last[k][n][1]:02x}" for k in range(parts)), err[n], per[lab], sha) for n, (i, lab, _) in enumerate(kept)]


VSCHEMA = "vec_id long, embedding array<float>, label int, ints string, l string, code string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y", "z") for i, lab, v in rows], VSCHEMA)


def test_codes(spark):
    t = read(spark, SF, "embeddings").where("vec_id < 300")
    want = brute_codes([(r.vec_id, r.label, r.embedding) for r in t.collect()])
    assert sorted(map(tuple, vector_code.vector_codes(t).collect())) == sorted(want)


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    made = [(int(i), int(i) % 3 if i % 5 else None, [float(x) for x in rng.integers(-3, 4, 32) / 256]) for i in range(90)]
    made += made[:5] + [(2, 7, [0.0] * 32), (None, 1, [1.0] * 32), (None, 1, [1.0] * 32), (200, None, [-1e5] * 32)]
    bad = [(300, 1, None), (301, 1, [float("nan")] * 32), (302, 1, [None] * 32), (303, 1, [float("inf")] + [0.0] * 31)]
    got = vector_code.vector_codes(vectors(spark, made + bad)).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_codes(made))


def test_codes_of_other_lengths(spark):
    same = [(i, 0, [float(i)] * 16) for i in range(5)]
    got = {r.vec_id: r for r in vector_code.vector_codes(vectors(spark, same + [(9, 0, [1.0] * 3), (10, 4, [])])).collect()}
    want = {r[0]: r for r in brute_codes(same)}
    assert all(tuple(got[i])[:3] == want[i][:3] and got[i].codebooks_sha256 == want[i][4] for i in want)
    assert (got[9].code, got[9].error, got[9].label_error) == (None, None, 0) and got[10].code is None and got[10].label_error is None
    uneven = vector_code.vector_codes(vectors(spark, [(i, 0, [float(i * k) for k in range(21)]) for i in range(70)])).collect()
    assert len(uneven) == 70 and all(len(r.code) == 32 for r in uneven)
    assert vector_code.vector_codes(vectors(spark, [])).collect() == []


def test_integers_beyond_the_range_are_held(spark):
    r = vector_code.vector_codes(vectors(spark, [(1, 0, [3e38] * 16), (2, 0, [-3e38] * 16)])).collect()
    assert {x.error for x in r} == {0}


@pytest.mark.parametrize("n, m, dims, span", [(1, 1, 4, 10), (5, 3, 4, 3), (700, 64, 4, 200), (900, 64, 4, 4), (777, 13, 1, 50), (50, 64, 3, 2), (33, 2, 7, 1000), (16, 5, 2, 2**27), (0, 4, 2, 9), (9, 3, 0, 1)])
def test_dual_tree_against_all_distances(n, m, dims, span):
    rng = np.random.default_rng(n + m)
    p, e = rng.integers(-span, span + 1, (n, dims)), rng.integers(-span, span + 1, (m, dims))
    got, want = dual_tree.assign(p, e), ((p[:, None] - e[None]) ** 2).sum(2).argmin(1)
    assert (got.entry == want).all() and (got.counts == np.bincount(want, minlength=m)).all()
    sums = np.zeros((m, dims), np.int64)
    np.add.at(sums, want, p)
    assert (got.sums == sums).all()


def test_clustered_points_go_by_whole_nodes():
    rng = np.random.default_rng(1)
    e = rng.integers(-1000, 1000, (20, 4))
    p = e[rng.integers(0, 20, 5000)] + rng.integers(-3, 4, (5000, 4))
    assert dual_tree.assign(p, e).whole > 4500


# ---- toxicity


def test_windows_hold_the_whole_text():
    for t in ("", "a", "One  two\tthree " * 100, "x" * 1000, "é" * 500, " " * 300, "y" * 63 + " " + "z" * 200):
        parts = toxicity.windows(t)
        want = re.sub(rb"[\x09-\x0D]", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        assert b"".join(parts) == want and all(len(p) <= 2 * toxicity.WINDOW + 1 for p in parts)


def test_scores_equal_windows_one_by_one(spark):
    """The column's scores against lengths taken window by window with plain compressors."""
    import zstandard

    docs = read(spark, MID, "documents")
    m = toxicity.fit(docs, read(spark, MID, "labels").where(~toxicity.held_out()))
    assert "share" not in m
    zips = [
        zstandard.ZstdCompressor(
            dict_data=zstandard.ZstdCompressionDict(m["head"] + c + m["ordinary"]),
            compression_params=zstandard.ZstdCompressionParameters.from_level(12, min_match=3, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS),
        )
        for c in (b"", m["toxic"])
    ]
    for r in toxicity.score_documents(docs.where("doc_id < 60"), m).collect():
        saved = [len(zips[0].compress(w)) - len(zips[1].compress(w)) for w in toxicity.windows(r.text)]
        over = [x for x in saved if x >= m["least"]]
        x = [1, math.log1p(sum(v - m["least"] + 1 for v in over)), math.log1p(len(over)), math.log1p(len(saved)) / 8]
        assert r.score == pytest.approx(1 / (1 + math.exp(-float(np.dot(m["weights"], x)))))


def test_planted_words_are_found_again(spark):
    """Made texts with insults of their own: held-out toxic texts are caught, clean ones left."""
    rng = np.random.default_rng(4)
    parts = ["an", "tor", "eli", "mo", "ves", "ra", "dun", "is", "ka", "pol"]
    rows, marks = [], []
    for i in range(900):
        ws = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(120)]
        bad = int(rng.random() < 0.2)
        for _ in range(4 * bad):
            ws[rng.integers(0, 120)] = rng.choice(["Fungwit", "glarbhead,", "zibblox"])
        rows.append((i, " ".join(ws), "s"))
        marks.append((i, 1, bad))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(odd(spark, rows), labels).collect()}
    held = [(got[i].predicted, bad) for i, _, bad in marks if got[i].held_out]
    assert sum(p for p, b in held if b) >= 0.9 * sum(b for _, b in held)
    assert sum(p for p, b in held if not b) <= 0.02 * sum(1 - b for _, b in held)


def test_held_out_toxic_documents(spark):
    """Labelled rows that were not learned from: most English toxic texts are found (labels of
    the given tables mark some texts that show nothing), ordinary ones are left."""
    s = "/root/testdata/sf0.1"
    rows = toxicity.toxicity_scores(read(spark, s, "documents"), read(spark, s, "labels")).where("held_out")
    both = rows.join(read(spark, s, "labels"), "doc_id").join(read(spark, s, "documents").select("doc_id", "lang"), "doc_id").collect()
    caught = [r.predicted for r in both if r.toxic == 1 and r.lang == "en"]
    assert sum(caught) >= 0.85 * len(caught)
    clean = [r.predicted for r in both if r.toxic == 0]
    assert sum(clean) <= 0.03 * len(clean)


def test_toxicity_of_odd_rows(spark):
    docs = odd(spark, ODD + [(8, "w" * 300_000 + " and so on" * 50_000, "a")])
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, None, 0), (4, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert toxicity.toxicity_scores(spark.createDataFrame([], SCHEMA), labels).collect() == []
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.where("false")).collect()} == {0.0}


def test_registered(spark):
    assert {"op11_importance_resampling", "op12_dual_tree_codes", "op13_compression_toxicity"} <= set(catalog.QUERIES)
    assert catalog.op13_compression_toxicity(spark, SF).count() == read(spark, SF, "documents").count()
