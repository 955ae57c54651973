"""The operators' results against plain Python over small fixtures."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from gridweave.llm import mixing, packing, pii, simhash_ball, token_files
from gridweave.llm.common import read
from gridweave.llm.tokenization import Encoder, encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, k string, pass string"


@pytest.fixture(scope="module")
def given(spark):
    return read(spark, SF, "documents")


def odd(spark, rows):
    """Documents with nulls, repeats and columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, None, s, None, "x", "y", "z") for i, t, s in rows], SCHEMA)


ODD = [
    (1, None, "a"), (2, "", "a"), (None, "one two", None), (None, "one two", None), (3, "x" * 30_000, "b"), (4, "a b c d e f g", "b"),
    (4, "a b c d e f g", "b"), (5, " \t\n ", "a"), (6, "word " * 5_000, "c"), (7, "é ü ß 中文 <|endoftext|>", "c"),
]


def texts(df):
    return [(r.doc_id, r.text or "", r.source) for r in df.select("doc_id", "text", "source").collect()]


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_fingerprint(t):
    ws = split(ascii_lower(t))
    sh = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps):
    fps = sorted(set(fps))
    top = {f: f for f in fps}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 4:
                top[find(a)] = find(b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("which", ["given", "odd"])
def test_simhash(spark, given, which):
    docs = given if which == "given" else odd(spark, ODD)
    rows = texts(docs)
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    comp = brute_components(fps)
    low = defaultdict(list)
    for (d, _, _), f in zip(rows, fps):
        low[comp[f]].append(d)
    want = Counter((d, f"{f:016x}", min((x for x in low[comp[f]] if x is not None), default=None)) for (d, _, _), f in zip(rows, fps))
    got = Counter(tuple(r) for r in simhash_ball.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect())
    assert got == want
    kept = simhash_ball.keepers(docs).collect()
    assert len(kept) == len(set(comp.values()))


@pytest.mark.parametrize("split_by", [(8, 0), (8, 2), (9, 1)])
def test_ball_connects_what_is_near(spark, split_by):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    near = base.copy()
    for k in range(len(near)):
        for b in rng.choice(64, k % 7, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    fps = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    got = simhash_ball.links(df, split=split_by).collect()
    unsigned = lambda x: x & (2**64 - 1)
    joined = brute_components(fps.tolist())
    top = {f: f for f in fps.tolist()}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for r in got:
        a, b = unsigned(r.a), unsigned(r.b)
        assert joined[a] == joined[b]  # nothing is linked that no chain of near pairs links
        top[find(a)] = find(b)
    named = {}
    for f in joined:
        assert named.setdefault(joined[f], find(f)) == find(f)
    assert len(set(named.values())) == len(named)


def test_bucket_sizes():
    assert simhash_ball.sizes(0) == (8, 0) and simhash_ball.sizes(236_000) == (8, 0)
    assert simhash_ball.sizes(15_000_000) == (8, 5)
    bits, turns = simhash_ball.sizes(10**9)
    assert 10**9 * 2081 / 2**bits <= 16_000_000 and turns <= 3


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def brute_pii(t):
    out = []
    out += [("email", *m.span()) for m in re.finditer(EMAIL, t)]
    out += [("ip", *m.span()) for m in re.finditer(IP, t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(CARD, t):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d[-1::-2]) + sum((2 * x) // 10 + (2 * x) % 10 for x in d[-2::-2])
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(PHONE, t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_pii(spark, given):
    rng = np.random.default_rng(5)
    signs = ["@", "a", "B7", ".", "-", " ", "+", "1", "22", "255", "256", "4111111111111111", "4111 1111-1111 1111", "(", ")", "é", "中", "x@y.zz", "10.0.0.1", "+49 30 1234567"]
    made = [(i, "".join(rng.choice(signs, rng.integers(0, 25))), "s") for i in range(400)]
    docs = given.select("doc_id", "text", "source").unionByName(odd(spark, ODD + made).select("doc_id", "text", "source"))
    want = Counter()
    for d, t, _ in texts(docs):
        s = brute_pii(t)
        n = Counter(k for k, *_ in s)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want[(d, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest())] += 1
    got = pii.pii_digest(docs).collect()
    assert Counter(tuple(r[:6]) for r in got) == want
    base = {"email", "ip", "card", "phone"}
    for r in got:
        kept = ",".join(x for x in r.spans.split(",") if x.split(":")[0] in base)
        assert hashlib.sha256(kept.encode()).hexdigest() == r.base_sha256


def test_pii_more_kinds_and_mask():
    t = "Bank account IBAN DE89 3704 0044 0532 0130 00 and social security 123-45-6789 is on file for the holder of the old passport; serial 123-45-6789 sample"
    kinds = [k for k, *_ in pii.find_spans(t)]
    assert kinds.count("iban") == 1 and kinds.count("ssn") == 1
    assert not pii.find_spans("IBAN DE88 3704 0044 0532 0130 00")
    assert not pii.find_spans("part 123-45-6789 of a plain text")
    assert pii.mask("write a@b.cc or +49 30 1234567.") == "write [EMAIL] or [PHONE]."
    assert pii.mask("1" * 200_000 + "@" + "a." * 1000) is not None  # linear in the text


def test_iban_ends_at_its_countrys_length():
    for iban, after in (
        ("DE89 3704 0044 0532 0130 00", " BIC COBADEFF"), ("DE89370400440532013000", " 2024"), ("GB82 WEST 1234 5698 7654 32", " AB 12 CD 34"),
        ("NO93 8601 1117 947", " 1"), ("MT84MALT011000012345MTLCAST001S", " X"), ("BE68 5390 0754 7034", ""),
    ):
        t = "IBAN " + iban + after
        assert [x[:3] for x in pii.find_spans(t) if x[0] == "iban"] == [("iban", 5, 5 + len(iban))], t
        assert pii.mask(t).startswith("IBAN [IBAN]")
    # a code in front and a second number behind a first
    both = "REF AB12 DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32"
    assert [both[a:b] for k, a, b, _ in pii.find_spans(both) if k == "iban"] == ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    assert not [x for x in pii.find_spans("IBAN DE89370400440532013000X and DE88 3704 0044 0532 0130 00 BIC") if x[0] == "iban"]


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, free = float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        total, over = sum(w[s] for s in free), 0.0
        for s in free:
            target[s] += left * w[s] / total
        for s in list(free):
            if target[s] >= 3 * sizes[s]:
                over += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                free.discard(s)
        left = over
    return target


@pytest.mark.parametrize("which", ["given", "odd"])
def test_mixing(spark, given, which):
    docs = given if which == "given" else odd(spark, ODD)
    rows = texts(docs)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(split(t))
    target = brute_targets(sizes)
    got = [r.asDict() for r in mixing.mixed_taken(docs, block=64).collect()]
    assert len(got) == len(rows)
    by = defaultdict(Counter)
    for (d, t, s) in rows:
        by[d][(len(split(t)), sizes[s])] += 1
    taken = defaultdict(int)
    for r in got:
        assert by[r["doc_id"]][(r["size"], r["source_size"])] > 0
        assert any(abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) for s in target if sizes[s] == r["source_size"])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_size"], round(r["target"], 3)] += r["taken"]
    for (z, t), n in taken.items():
        same = sum(1 for s in target if sizes[s] == z and abs(target[s] - t) < 1e-2)
        assert abs(n - same * t) <= same * 1.01
    again = [r.asDict() for r in mixing.mixed_taken(docs.repartition(5), block=64).collect()]
    key = lambda r: str(sorted(r.items()))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_documents_take_prefixes(spark, given):
    docs = given.where("doc_id < 60")
    rows = {r.doc_id: r.text for r in docs.collect()}
    taken = {r.doc_id: r.taken for r in mixing.mixed_taken(docs, block=64).collect()}
    words = Counter()
    for r in mixing.mixed_documents(docs, block=64).collect():
        assert rows[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        words[r.doc_id] += len(split(r.text))
    assert {d: n for d, n in taken.items() if n} == dict(words)


def test_slots_follow_the_shares(spark, given):
    sizes = mixing.sized(given)
    plan = mixing.targets(sizes)
    share = {r.sk: r.target for r in plan.collect()}
    slots = [r.sk for r in mixing.schedule(plan, 64).orderBy("slot").collect()]
    total = sum(share.values())
    for upto in (200, len(slots)):
        n = Counter(slots[:upto])
        assert all(abs(n[s] - upto * t / total) < 6 for s, t in share.items())


@pytest.mark.parametrize("which", ["given", "short"])
def test_slots_choose_the_blocks(spark, given, which):
    """``short``: sources far below a slot's share beside one that fills most slots."""
    docs = given if which == "given" else odd(spark, [(i, "w " * 200, "b") for i in range(200)] + [(1000 + i, "v " * (30 + i), f"s{i:02}") for i in range(25)])
    sizes = mixing.sized(docs)
    plan = mixing.targets(sizes)
    target = {r.sk: r.target for r in plan.collect()}
    need = {s: -(-int(t) // 64) for s, t in target.items()}
    rows = mixing.mix(sizes, plan, 64).collect()
    blocks, filled = defaultdict(set), Counter()
    for r in rows:
        blocks[r.slot].add((r.sk, r.rank))
        filled[r.slot] += r.length
    assert sorted(blocks) == list(range(sum(need.values())))  # every slot has a block, every block a slot
    assert all(len(b) == 1 for b in blocks.values())
    order = [next(iter(blocks[s])) for s in range(len(blocks))]
    for s, n in need.items():  # a source's slots take its blocks in order
        assert [k for x, k in order if x == s] == list(range(n))
    assert all(filled[i] == min(64, int(target[s]) - 64 * k) for i, (s, k) in enumerate(order))
    # the golden-ratio points decide the source of all but the slots that change hands
    edges, names = np.cumsum([target[s] for s in sorted(target)]) / sum(target.values()), sorted(target)
    points = [names[int(np.searchsorted(edges, (i + 1) * mixing.PHI % 1.0, "right"))] for i in range(len(order))]
    extra = sum(max(0, n - need[s]) for s, n in Counter(points).items())
    assert sum(a != b for a, (b, _) in zip(points, order)) == extra and (which == "given" or extra > 0)
    first = {}
    for r in rows:
        first[r.doc_id] = min(first.get(r.doc_id, r.slot), r.slot)
    for r in mixing.mixed_taken(docs, block=64).collect():
        assert r.slot == first.get(r.doc_id) and (r.slot is None) == (r.taken == 0)


def test_mixed_documents_stand_in_slot_order(spark, given):
    rows = mixing.mix(sizes := mixing.sized(given), mixing.targets(sizes), 64).collect()
    place = defaultdict(list)
    for r in rows:
        place[r.doc_id, r["pass"]].append((r.slot, r.at))
    want = [d for d, _ in sorted(place, key=lambda x: min(place[x]))]
    assert [r.doc_id for r in mixing.mixed_documents(given, block=64).collect()] == want


@pytest.fixture(scope="module")
def hf():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t


def test_encoder_gives_the_tokenizers_ids(hf):
    rng = np.random.default_rng(8)
    signs = ["a", "b", " ", "\n", "\t", "  ", "it's", "'s", ".", "!?", "é", " ", "<|endoftext|>", "12", "x1", "\r\n", "中", "…", ",", ". ", " .", "\x1c"]
    made = ["".join(rng.choice(signs, rng.integers(0, 12))) for _ in range(4000)]
    e = encoder("byte_bpe_50k.json")
    assert [x.tolist() for x in e.encode(made)] == [x.ids for x in hf.encode_batch(made, add_special_tokens=False)]
    e._forget() if len(e._numbers) > 10 else None
    assert [x.tolist() for x in e.encode(made)] == [x.ids for x in hf.encode_batch(made, add_special_tokens=False)]


def test_words_and_signs_share_what_is_encoded(hf):
    """A word met with other signs behind it is not encoded again (op3: the check's CPU seconds)."""
    rng = np.random.default_rng(11)
    letters, signs = list("abzÉéñßжЯ"), ["", ".", ",", "'", "'s", "'ll", "!!", "***", "…", "²", ").", "-", "_x", "4", "\x01", "\x01.", "\n", "\t", "中", "\u0301"]
    words = ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(60)]
    made = [" ".join(rng.choice(words) + rng.choice(signs) + rng.choice(signs) for _ in range(rng.integers(1, 9))) for _ in range(3000)]
    made += ["", " ", "\n", "a\n", "\na", " a", "a ", ".", "'s", "a'", "\x01", "a\n.", "x" * 5000 + "." * 5000, "ا، ب", "\ufeffa.", "a\u180eb", "e\u0301."]
    e = Encoder("byte_bpe_50k.json")
    assert [x.tolist() for x in e.encode(made)] == [x.ids for x in hf.encode_batch(made, add_special_tokens=False)]
    plain = [w + s for w in words for s in [".", ",", "!!", "***", ").", ""]]
    e = Encoder("byte_bpe_50k.json")
    assert [x.tolist() for x in e.encode([" ".join(plain)])] == [hf.encode(" ".join(plain), add_special_tokens=False).ids]
    assert len(e._numbers) <= len(set(words)) + 6


def test_special_strings_are_recognised(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made = ["x<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "one\n<|endoftext|>two", "<|endoftext>", "no such string"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in made]
    assert want[0] == [87, 50256]
    rng, signs = np.random.default_rng(9), ["a", " ", "\n", "  ", "it's", ".", "é", "<|endoftext|>", "<|", "|>", "endoftext", "12", "\t", "中"]
    mixed = ["".join(rng.choice(signs, rng.integers(0, 12))) for _ in range(3000)]
    assert [x.tolist() for x in encoder("byte_bpe_50k.json").encode(mixed)] == [x.ids for x in plain.encode_batch(mixed, add_special_tokens=False)]
    assert [x.tolist() for x in encoder("byte_bpe_50k.json").encode(made)] == want
    docs, at = odd(spark, [(i, t, "s") for i, t in enumerate(made)]), 0
    for r in sorted(token_files.read_documents(spark, token_files.write_tokens(docs)).collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want[r.doc_id]) + 1, crc([*want[r.doc_id], 2]))
        at += r.n_tokens
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack_documents(docs).collect()}
    assert got == {i: (len(ids) + 1, crc([*ids, 0])) for i, ids in enumerate(want)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("which,block,bits", [("given", 65_536, False), ("given", 500, True), ("odd", 64, False)])
def test_token_files(spark, given, hf, which, block, bits):
    docs = given if which == "given" else odd(spark, [r for r in ODD if r[0] is not None])
    rows = sorted(texts(docs), key=lambda r: r[0])
    got = sorted(map(tuple, token_files.read_documents(spark, token_files.write_tokens(docs, block=block, bits=bits)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    want, at = [], 0
    for d, t, _ in rows:
        ids = [*hf.encode(t, add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        for ids in (rng.integers(0, 2**32, n, dtype=np.uint32), rng.integers(0, 50_000, n, dtype=np.uint32), np.zeros(n, np.uint32)):
            for bits in (False, True):
                assert (token_files.from_planes(token_files.to_planes(ids, bits), n) == ids).all()


@pytest.mark.parametrize("which", ["given", "odd"])
def test_packing(spark, given, hf, which):
    docs = given if which == "given" else odd(spark, ODD)
    want = Counter()
    for d, t, _ in texts(docs):
        ids = [*hf.encode(t, add_special_tokens=False).ids, 0]
        head = len(ids) % 2048 or 2048
        cut = [0, *range(head, len(ids), 2048)] if len(ids) > 2048 else [0]
        for k, (a, b) in enumerate(zip(cut, [*cut[1:], len(ids)])):
            want[(d, k, a, b - a, crc(ids[a:b]))] += 1
    got = packing.pack_documents(docs).collect()
    assert Counter(tuple(r[:5]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= 1.03 * -(-sum(r.length for r in got) // 2048) + 1


def fewest(sizes, limit):
    """The least number of sequences, by search over small instances."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, gaps):
        if len(gaps) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(gaps)
            return
        for g in sorted({x for x in gaps if x >= sizes[i]}):
            rest = list(gaps)
            rest.remove(g)
            go(i + 1, [*rest, g - sizes[i]])
        go(i + 1, [*gaps, limit - sizes[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(11)
    for _ in range(300):
        limit = int(rng.integers(6, 30))
        sizes = rng.integers(1, limit + 1, int(rng.integers(1, 9))).tolist()
        plan = packing.Plan.__new__(packing.Plan)
        plan.limit, plan.left = limit, dict(sorted(Counter(sizes).items(), reverse=True))
        plan.ranges, plan.given, plan.gaps = defaultdict(list), defaultdict(int), defaultdict(list)
        plan.sequences = plan.fixed = 0
        plan._reduce()
        rest = [s for s, n in plan.left.items() for _ in range(n)]
        assert plan.fixed + fewest(rest, limit) == fewest(sizes, limit), (limit, sizes)
        full = packing.Plan(Counter(sizes), limit)
        used = defaultdict(int)
        for s, found in full.ranges.items():
            for _, n, q, _ in found:
                for k in range(n):
                    used[q + k] += s
        assert max(used.values()) <= limit and sum(used.values()) == sum(sizes)


@pytest.mark.parametrize("schema", [SCHEMA])
def test_empty_tables(spark, schema):
    none = spark.createDataFrame([], schema)
    assert simhash_ball.near_duplicates(none).count() == 0
    assert pii.pii_digest(none).count() == 0
    assert mixing.mixed_taken(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert token_files.read_documents(spark, token_files.write_tokens(none)).count() == 0
