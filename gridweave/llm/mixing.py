"""Mix sources to target weights by a low-discrepancy schedule.

Every source's documents are put in a hashed order and laid end to end as one stream of
words, repeated as often as its target asks, and cut into blocks of ``block`` words. Slot
``i`` of the mix gets the golden-ratio point ``frac((i + 1) * phi)``, which the cumulative
target shares map to a source; a source's slots, ranked, take its blocks in order. Any
prefix of the slots thus holds the sources in nearly their target shares. There are as many
slots as blocks: slots beyond a source's last block, its latest ones, go to the sources whose
slots run short by the sequence's discrepancy. A source's last block is cut so that it gives
its target exactly (rounded down to whole words). Only words of a block in a slot are taken.

Targets: all sources share the sum of all sizes by weight; a target stops at ``passes``
times its source's size and the excess is shared anew by weight, in closed form: with
sources sorted by cap over weight, the first whose cap exceeds its share of what is left
fixes the level of all after it.

Ordered sums and ranks are two-level (buckets of the hashed order or of slots, then a sum
over buckets), so a source with a third of all rows spreads over many tasks.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own,
last in order; repeated rows are separate documents; the order rests on ``doc_id``, the
text's hash and nothing else, so reruns agree. A document that lies in several blocks counts
to the slot of its first. Other columns are kept by ``mixed_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import cut_lineage, text_or_empty, words

PHI = (math.sqrt(5) - 1) / 2
BLOCK, PASSES, WEIGHTS = 1024, 3, (1, 2, 3)
ORDER_BUCKETS, SLOT_BUCKET = 1024, 4096


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``oh`` (hash of id, text and source) and ``k``, which numbers rows
    that agree in all three; (doc_id, oh, k) then names a row, and equal rows are as good
    as each other."""
    docs = docs.withColumn("oh", F.xxhash64("doc_id", text_or_empty(), F.col("source").cast("string")))
    return docs


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "oh").orderBy("oh")))


def sized(docs: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, oh, k, source, size in words, and ``ob``, its
    bucket of the hashed order."""
    rows = _keyed(docs).select("doc_id", "oh", F.col("source").cast("string").alias("source"), F.size(words(text_or_empty())).cast("long").alias("size"))
    return _numbered(rows).withColumn("ob", F.pmod(F.xxhash64("oh", F.lit(7)), F.lit(ORDER_BUCKETS)).cast("int"))


def targets(sizes: DataFrame, passes: int = PASSES, weights: tuple = WEIGHTS) -> DataFrame:
    """``source, sk, source_size, target`` with one row per source (``sk``: its number in
    code point order, null last). Windows here run over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumn("sk", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sk") % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", passes * F.col("source_size").cast("double"))
    up = everything.orderBy(F.col("cap") / F.col("w"), "sk")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    # the first row in this order that stays under its cap fixes the level of the rest
    level = F.min(F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "sk", "level"))).over(everything)["level"]
    return per.withColumn("target", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap")))).select("source", "sk", "source_size", "target")


def _before(df: DataFrame, keys: list[str], bucket: str, order: list, value: Column, out: str) -> DataFrame:
    """``out``: sum of ``value`` over the rows of the same keys that come earlier; a window
    within each bucket plus the earlier buckets' sums."""
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__s"))
    over = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, bucket, F.coalesce(F.sum("__s").over(over), F.lit(0)).alias("__in"))
    own = df.withColumn("__own", F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(sums, [*keys, bucket]).withColumn(out, F.col("__own") + F.col("__in")).drop("__own", "__in")


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """``slot, sk, rank``: which block (``rank``) of which source every slot takes; each
    block of each target has one slot, and the slots are numbered from 0 without gaps."""
    spark = plan.sparkSession
    ordered = Window.partitionBy(F.lit(0)).orderBy("sk")
    share = plan.withColumn("hi", F.sum("target").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    # each share begins exactly where the one before ends, so every point has one source
    share = share.withColumn("lo", F.coalesce(F.lag("hi").over(ordered), F.lit(0.0))).withColumn("total", F.max("hi").over(Window.partitionBy(F.lit(0))))
    share = share.where("hi > lo").select("sk", (F.col("lo") / F.col("total")).alias("lo"), (F.col("hi") / F.col("total")).alias("hi"))
    need = plan.select("sk", F.ceil(F.floor("target") / block).alias("need"))
    slots = need.agg(F.sum("need")).first()[0] or 0
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(PHI), F.lit(1.0)).alias("u"))
    # a lookup of the point in the cumulative shares: an equality join on coarse cells of
    # [0, 1), each source covering its cells, then the exact test
    cells = 1024
    points = points.withColumn("cell", F.floor(F.col("u") * cells))
    cover = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.least(F.col("hi"), F.lit(1 - 1e-12)) * cells))))
    hit = points.join(cover, "cell").where("u >= lo and u < hi").select("slot", "sk")
    hit = hit.withColumn("sb", F.floor(F.col("slot") / SLOT_BUCKET))
    dealt = cut_lineage(_before(hit, ["sk"], "sb", ["slot"], F.lit(1), "rank").join(need, "sk"))
    # slots beyond a source's blocks go to blocks beyond their source's slots, of which there
    # are as many; both are the sequence's discrepancy, a few for every source
    had = dealt.groupBy("sk").agg(F.count(F.lit(1)).alias("had"))
    short = need.join(had, "sk", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("need > had")
    short = short.select("sk", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank"))
    nth = lambda *by: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)).alias("nth")
    moved = dealt.where("rank >= need").select("slot", nth("slot")).join(short.select("sk", nth("rank", "sk")), "nth").select("slot", "sk")
    filled = dealt.where("rank < need").select("slot", "sk").unionByName(moved)
    filled = filled.withColumn("sb", F.floor(F.col("slot") / SLOT_BUCKET))
    return _before(filled, ["sk"], "sb", ["slot"], F.lit(1), "rank").select("slot", "sk", "rank")


def mix(sizes: DataFrame, plan: DataFrame, block: int = BLOCK, passes: int = PASSES) -> DataFrame:
    """The mix: ``slot, sk, rank, doc_id, oh, k, pass, start, length, at`` rows, each a run of
    ``length`` words of a document from its word ``start``, in the slot that takes it, ``at``
    words after the slot's begin."""
    rows = sizes.join(plan, sizes["source"].eqNullSafe(plan["source"])).drop(plan["source"]).where("size > 0")
    rows = _before(rows, ["sk"], "ob", ["oh", "doc_id", "k"], F.col("size"), "off")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    rows = rows.withColumn("from", F.col("pass") * F.col("source_size") + F.col("off"))
    rows = rows.withColumn("to", F.least(F.col("from") + F.col("size"), F.floor("target")))
    rows = rows.where(F.col("to") > F.col("from"))
    rows = rows.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    a, b = F.greatest("from", F.col("rank") * block), F.least("to", (F.col("rank") + 1) * block)
    at = (a - F.col("rank") * block).alias("at")
    pieces = rows.select("sk", "rank", "doc_id", "oh", "k", "pass", (a - F.col("from")).alias("start"), (b - a).alias("length"), at)
    return pieces.join(schedule(plan, block), ["sk", "rank"])


def _same(left: DataFrame, right: DataFrame):
    """Rows of one document on both sides; ``k`` in a form that is no join key, so that a
    side dealt by (doc_id, oh) stays where it is."""
    return left["doc_id"].eqNullSafe(right["d2"]) & (left["oh"] == right["oh2"]) & (left["k"] - right["k2"] == 0)


def mixed_taken(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken and slot (the first one that takes words of
    it, null if none does) for every row of ``docs``."""
    sizes = cut_lineage(sized(docs))
    plan = cut_lineage(targets(sizes).coalesce(1))
    taken = mix(sizes, plan, block).groupBy(F.col("doc_id").alias("d2"), F.col("oh").alias("oh2"), F.col("k").alias("k2")).agg(F.sum("length").alias("words"), F.min("slot").alias("slot"))
    rows = sizes.join(plan, sizes["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    return rows.join(taken, _same(rows, taken), "left").select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "slot")


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents with the columns of ``docs``: one row per document and pass in
    which it is taken, sorted by where the slots place its first word. Where a target ends inside a document that row's text ends after
    its last taken word (and ``n_chars``, where there is one, follows). Documents without
    a word take part in no mix and are left out."""
    sizes = cut_lineage(sized(docs))
    plan = cut_lineage(targets(sizes).coalesce(1))
    keys = [F.col("doc_id").alias("d2"), F.col("oh").alias("oh2"), F.col("k").alias("k2")]
    runs = mix(sizes, plan, block).groupBy(*keys, "pass").agg(F.sum("length").alias("__len"), F.min(F.struct("slot", "at")).alias("__place"))
    runs = runs.join(sizes.select(*[F.col(c).alias(a) for c, a in (("doc_id", "d3"), ("oh", "oh3"), ("k", "k3"))], F.col("size").alias("__size")), F.col("d2").eqNullSafe(F.col("d3")) & (F.col("oh2") == F.col("oh3")) & (F.col("k2") == F.col("k3")))
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), "doc_id", "text", "source")
    rows = _numbered(_keyed(whole).drop("text", "source"))
    rows = rows.join(runs, _same(rows, runs)).orderBy("__place")
    text = F.col("__row")["text"]
    some = F.when(F.col("__len") < F.col("__size"), _first_words(text, F.col("__len"))).otherwise(text)
    out = [some.alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in names]
    done = rows.select(*out)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else done


def _first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word, white space within as it is."""
    broken = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each part ends with a word
    return F.array_join(F.slice(broken, F.lit(1), n.cast("int")), "")
