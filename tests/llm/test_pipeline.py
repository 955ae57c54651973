"""The pipeline's stages, each on what the one before kept, and language identification."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import corpus_pipeline as P
from gridweave.llm import langid, pii, quality_mil
from gridweave.llm.common import read

from .test_brute import ODD, SF, brute_components, brute_fingerprint, brute_targets, odd, split

MID = "/root/testdata/sf0.01"


def rows(df):
    return [r.asDict() for r in df.collect()]


def stages(spark, docs, tmp, sf=SF):
    out = [docs]
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, out[-1], sf).write.parquet(path := f"{tmp}/{k}")
        out.append(spark.read.parquet(path))
    return out


def check(spark, before, kept, deduped, masked, mixed, packed, sf):
    # 1: the operator's verdict, learned from the same rows
    scores = quality_mil.quality_scores(before, read(spark, sf, "labels"))
    want = Counter(r.doc_id for r in scores.where("predicted = 1").collect())
    assert Counter(r["doc_id"] for r in rows(kept)) == want
    # 2: one document of each group
    docs = rows(kept)
    fps = [brute_fingerprint(r["text"] or "") for r in docs]
    comp = brute_components(fps)
    groups = defaultdict(list)
    for r, f in zip(docs, fps):
        groups[comp[f]].append(r["doc_id"])
    first = Counter(min((d for d in g if d is not None), default=None) for g in groups.values())
    assert Counter(r["doc_id"] for r in rows(deduped)) == first
    # 3: every row, its text masked
    texts = {(r["doc_id"], r["source"]): r["text"] for r in rows(deduped)}
    assert masked.count() == deduped.count()
    for r in rows(masked):
        t = texts[r["doc_id"], r["source"]]
        assert r["text"] == (None if t is None else pii.mask(t))
    # 4: sources near their targets, texts whole or cut at the end
    sizes, by = defaultdict(int), {}
    for r in rows(masked):
        sizes[r["source"]] += len(split(r["text"] or ""))
        by[r["doc_id"], r["source"]] = r["text"]
    target, taken = brute_targets(sizes), defaultdict(int)
    for r in rows(mixed):
        assert by[r["doc_id"], r["source"]].startswith(r["text"])
        taken[r["source"]] += len(split(r["text"]))
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    # 5: every mixed document in pieces, sequences without gaps
    got = rows(packed)
    assert sum(r["piece"] == 0 for r in got) == mixed.count()
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048


def test_stages(spark, tmp_path):
    out = stages(spark, read(spark, SF, "documents"), tmp_path)
    for df in out[1:-1]:
        assert df.columns == out[0].columns
    check(spark, *out, SF)
    whole = Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows(P.run(spark, SF)))
    assert whole == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows(out[-1]))


def test_stages_on_odd_rows_and_none(spark, tmp_path):
    docs = odd(spark, ODD)
    _, *out = stages(spark, docs, tmp_path / "odd")
    assert out[-1].count() > 0 and out[0].columns == P.COLUMNS
    *_, last = stages(spark, docs.where("false"), tmp_path / "none")
    assert last.count() == 0


def test_good_documents_stay(spark):
    kept = {r.doc_id for r in P.quality(spark, read(spark, MID, "documents"), MID).collect()}
    good = [r.doc_id for r in read(spark, MID, "labels").where("quality = 1").collect()]
    bad = [r.doc_id for r in read(spark, MID, "labels").where("quality = 0").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good)
    assert sum(d in kept for d in bad) <= 0.5 * len(bad)


def test_languages(spark):
    model = langid.learn_text(read(spark, MID, "documents"))
    pages = read(spark, MID, "pages")
    want = {r.page_id: r.url.split("/")[3] for r in pages.collect()}
    got = rows(langid.identify(pages, *model))
    known = [r for r in got if want[r["page_id"]] in model[0]]
    assert len(got) == pages.count() and len(known) > 100
    assert sum(r["lang"] == want[r["page_id"]] for r in known) >= 0.98 * len(known)
    assert all(0 < r["confidence"] <= 1 + 1e-9 for r in got)


def test_languages_of_odd_pages(spark):
    model = langid.learn_text(read(spark, MID, "documents"))
    schema = "page_id long, url string, html string, row string, lang string"
    made = [(1, None, None), (None, "x", ""), (3, "http://a.de/", "<html lang='de'>"), (3, "http://a.de/", "<html lang='de'>"), (4, "//h", "<b>" * 9000), (5, "http://h/", "<p>the and of the that " * 30)]
    got = rows(langid.identify(spark.createDataFrame([(*r, "r", "l") for r in made], schema), *model))
    assert len(got) == len(made) and all(r["lang"] in model[0] for r in got)
    assert [r["lang"] for r in got if r["page_id"] == 5] == ["en"]
    assert langid.identify(spark.createDataFrame([], schema), *model).count() == 0
    nothing = langid.learn_text(read(spark, MID, "documents").where("false"))
    assert {r["lang"] for r in rows(langid.identify(spark.createDataFrame([(*r, "r", "l") for r in made], schema), *nothing))} == {None}


def test_visible_text_and_trigrams():
    assert langid.visible("<p>a &amp; b<script>x</script><!-- y --></p>").split() == ["a", "&", "b"]
    assert len(langid.trigrams("ab")) == 2 and len(langid.trigrams("")) == 0
    assert (langid.trigrams("The Cat") == langid.trigrams("the  cat!")).all()
