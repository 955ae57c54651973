from pyspark.sql import functions as F

from gridweave.operators import frontier as FR


def test_expand_cycle_and_labels(spark):
    edges = spark.createDataFrame(
        [("a", "b", {"k": "1"}), ("b", "c", {"k": "2", "j": "x"}), ("c", "a", {}), ("b", "d", None)],
        "src_url string, dst_url string, label map<string,string>",
    )
    seeds = spark.createDataFrame([("a", {"root": "r", "k": "0"})], "url string, labels map<string,string>")
    out = {r.url: (r.depth, r.labels) for r in FR.expand(seeds, edges, labels=True).collect()}
    assert out["a"][0] == 0 and out["b"][0] == 1 and out["c"][0] == 2 and out["d"][0] == 2
    assert out["c"][1] == {"root": "r", "k": "2", "j": "x"}
    assert out["d"][1] == {"root": "r", "k": "1"}


def test_follow_next_and_redirects(spark):
    nxt = spark.createDataFrame([("p1", "p2"), ("p2", "p3"), ("q1", "q2")], "src_url string, dst_url string")
    seeds = spark.createDataFrame([("p1",), ("q1",)], "url string")
    hops = {r.url: r.hop for r in FR.follow_next(seeds, nxt).collect()}
    assert hops == {"p1": 0, "p2": 1, "p3": 2, "q1": 0, "q2": 1}
    f = spark.createDataFrame([("u1", "s1")], "url string, step_id string")
    red = spark.createDataFrame([("u1", "u1b"), ("zz", "zz2")], "from_url string, to_url string")
    got = sorted((r.url, r.step_id) for r in FR.apply_redirects(f, red).collect())
    assert got == [("u1", "s1"), ("u1b", "s1")]


def test_assign_steps_last_wins(spark):
    frontier = spark.createDataFrame([("p", "root")], "url string, step_id string")
    links = spark.createDataFrame(
        [("p", 0, "x", "Apple"), ("p", 1, "y", "the end"), ("p", 2, "x", "banana")],
        "src_url string, pos bigint, dst_url string, text string",
    )
    steps = spark.createDataFrame(
        [("root", 0, "^[A-Z]", "cap", False), ("root", 1, "a$", "a_end", False), ("root", 2, "^the", None, True)],
        "step_id string, cond_ord int, regex string, child_step string, is_next boolean",
    )
    got = {r.url: r.step_id for r in FR.assign_steps(frontier, links, steps).collect()}
    assert got == {"x": "a_end", "y": "root"}


def test_unmatched_and_fallback(spark):
    pages = spark.createDataFrame([(1, "u1", "<h1>One</h1>"), (2, "u2", "<h1>Two</h1>")], "page_id bigint, url string, html string")
    links = spark.createDataFrame([(1, "Alpha"), (2, "beta")], "page_id bigint, text string")
    miss = sorted((r.page_id, r.selector) for r in FR.unmatched_selectors(links, pages, ["^[A-Z]", "a$"]).collect())
    assert miss == [(2, "^[A-Z]")]
    hits = spark.createDataFrame([("u1", "c1", "L")], "src_url string, dst_url string, label string")
    out = sorted((r.src_url, r.url, r.kind) for r in FR.fallback_self(pages, hits, F.lit("self")).collect())
    assert out == [("u1", "c1", "child"), ("u2", "u2", "self")]


def test_bucketed_walk_equals_the_plain_one(spark):
    import random

    from gridweave.operators.frontier import expand_bucketed

    rng = random.Random(5)
    rows = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", {f"k{rng.randrange(3)}": str(i)}) for i in range(90)] + [("n0", None, None), (None, "n1", None), ("n0", "n0", {"k9": "x"})]
    edges = spark.createDataFrame(rows, "src_url string, dst_url string, label map<string,string>")
    seeds = spark.createDataFrame([("n0", {"s": "0"}), ("n0", {"s": "0"}), ("n7", None), ("alone", None)], "url string, labels map<string,string>")
    key = lambda r: (r.url, r.depth, sorted((r.labels or {}).items()) if "labels" in r else None)
    for labels in (False, True):
        want = sorted(key(r) for r in FR.expand(seeds, edges, labels=labels).collect())
        assert sorted(key(r) for r in expand_bucketed(seeds, edges, labels=labels, buckets=4).collect()) == want
    assert expand_bucketed(seeds.limit(0), edges, buckets=4).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gw_")and "reach" in t.name]


def test_a_level_shuffles_its_own_finds_only(spark, monkeypatch):
    """Joins with the edges and the visited URLs take both from their buckets."""
    plans, plain = [], FR._new_urls

    def kept(*a):
        out = plain(*a)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(FR, "_new_urls", kept)
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(3)], "src_url string, dst_url string")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert FR.expand_bucketed(spark.createDataFrame([("n0",)], "url string"), edges, buckets=4).count() == 4
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(plans) == 4
    for p in plans:  # one exchange, of the found URLs
        assert p.count("Exchange") == 1 and "Exchange hashpartitioning(url" in p and p.count("SortMergeJoin") == 2, p
