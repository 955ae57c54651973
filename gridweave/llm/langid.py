"""Language identification by Bayesian evidence fusion.

Four pieces of evidence about a page's language are added as logarithms:

* its text: a naive Bayes model of letter trigrams (hashed to ``BINS`` bins), counted over
  all labelled documents per language; as neighbouring trigrams are not independent, the log
  likelihood counts for at most ``WORTH`` trigrams;
* the language that its markup declares: a confusion table P(declared | language);
* the suffix of its address: P(suffix | language), weighed by ``KAPPA`` against the number of other
  pages of its domain, as a domain that is well known says by itself what its suffix hints at;
* its host: a prior of the host smoothed towards its domain's, that towards that of all pages
  (Dirichlet weights ``KAPPA``).

Pages carry no true labels, so the tables are counts of the text model's posteriors, summed
by grouped aggregation (a page's own share is taken out again before it is scored).
Every table has a row per value and language, is joined by its key, and is never collected.

Defined results: a null page counts as empty; without text, and for texts without a
trigram, the likelihood is even; missing declarations, addresses or hosts are values of
their own that speak evenly; texts of any length are read whole; repeated rows are scored each; without labelled documents there
are no languages and ``lang`` is null; other columns are not read.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import cut_lineage, text_or_empty

BINS, WORTH, KAPPA, ALPHA = 16_384, 40, 5.0, 0.5

_BEGIN = re.compile(r"<(script|style)\b[^>]*>|<!--", re.I)
_END = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), None: re.compile("-->")}
_TAG = re.compile(r"<[^>]*>")
_OTHER = re.compile(r"[^a-zß-ɏͰ-￿]+")


def visible(html: str) -> str:
    """The text of a page, in time linear in its length: an end that was looked for in vain is
    not looked for again, and after the last ``>`` there are no tags."""
    last = html.rfind(">") + 1
    parts, at, search, never = [], 0, 0, set()
    while m := _BEGIN.search(html, search, last):
        kind = m[1] and m[1].lower()
        end = None if kind in never else _END[kind].search(html, m.end())
        if end:
            parts.append(html[at : m.start()])
            at = search = end.end()
        else:
            never.add(kind)
            search = m.end()
    parts.append(html[at:last])
    return unescape(_TAG.sub(" ", " ".join(parts)) + html[max(at, last) :])


def trigrams(text: str) -> np.ndarray:
    """Bins of the letter trigrams of the lower-cased text, words set off by a space."""
    s = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    g = c[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ c[2:] * np.uint64(0x165667B19E3779F9)
    g ^= g >> np.uint64(29)
    return ((g * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(50)).astype(np.int64) % BINS


def learn_text(docs: DataFrame, lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log P(bin | language), counted over every labelled text. What comes
    back is ``BINS`` numbers per language."""

    def count(batches):
        for b in batches:
            held: dict[str, np.ndarray] = {}
            for name, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                one = np.bincount(trigrams(text), minlength=BINS)
                held[name] = held[name] + one if name in held else one
            for name, n in held.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], ["lang", "bin", "n"])

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), text_or_empty().alias("text"))
    sums = rows.mapInArrow(count, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    table = np.full((len(langs), BINS), ALPHA)
    table[np.searchsorted(langs, sums["lang"]), sums["bin"]] += sums["n"] if len(sums) else 0
    return langs, np.log(table / table.sum(1, keepdims=True)) if langs else table


def text_column(langs: list[str], table: np.ndarray):
    """An Arrow function html -> log likelihood per language (relative to the best)."""

    def score(pages: pa.Array) -> pa.Array:
        out = []
        for html in pages.to_pylist():
            bins = trigrams(visible(html))
            ll = table[:, bins].sum(1) * (min(1.0, WORTH / len(bins)) if len(bins) else 0.0) if langs else np.zeros(0)
            out.append((ll - ll.max()).tolist() if len(ll) else [])
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(score, "array<double>")


def declared_language(html: Column) -> Column:
    """The primary subtag that the html element declares, or the empty string."""
    tag = F.regexp_extract(html, r"(?i)<html(\s[^>]*)", 1)
    return F.lower(F.regexp_extract(tag, r"(?i)\slang\s*=\s*[\"']?([a-z]{2,3})", 1))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def identify(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """``pages(page_id, url, html)`` -> page_id, lang, confidence, text_lang, declared,
    suffix, host for every row."""
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    host = host_of(url)
    rows = pages.select(
        "page_id", host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"),
        declared_language(html).alias("declared"), text_column(langs, table)(html).alias("ll"),
    )
    # repeated rows need a name of their own, which the written table fixes
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    if not langs:
        none = F.lit(None)
        return rows.select("page_id", none.cast("string").alias("lang"), none.cast("double").alias("confidence"), none.cast("string").alias("text_lang"), "declared", "suffix", "host")
    names = F.array(*[F.lit(x) for x in langs])
    # each page's posterior from its text, which the tables sum
    whole = F.aggregate("ll", F.lit(0.0), lambda a, x: a + F.exp(x))
    post = rows.select("row", "host", "domain", "suffix", "declared", F.posexplode(F.transform("ll", lambda x: F.exp(x) / whole)).alias("l", "p"))
    each = cut_lineage(post.withColumn("ll", F.log(F.greatest("p", F.lit(1e-30)))))
    sums = lambda *keys: each.groupBy(*keys, "l").agg(F.sum("p").alias("_".join(["n", *keys])))
    k = len(langs)
    t = each.join(F.broadcast(sums().withColumnRenamed("n", "n_all")), "l")  # a row per language
    for keys in (["suffix"], ["domain"], ["host"], ["declared"]):
        n = sums(*keys)
        of = F.sum(f"n_{keys[0]}").alias(f"t_{keys[0]}")
        n = n.join(n.groupBy(*keys).agg(of), keys)
        t = t.join(n, [*keys, "l"])
    kinds = each.agg(F.count_distinct("declared").alias("kd"), F.count_distinct("suffix").alias("ks"), F.sum("p").alias("total"))
    t = t.join(F.broadcast(kinds), F.lit(True))  # one row
    own = lambda c: F.greatest(F.col(c) - F.col("p"), F.lit(0.0))  # noqa: E731  without the page itself
    others = lambda c: F.greatest(F.col(c) - 1, F.lit(0.0))
    every = (own("n_all") + ALPHA) / (others("total") + ALPHA * k)
    prior = every
    for key in ("domain", "host"):
        prior = (own(f"n_{key}") + KAPPA * prior) / (others(f"t_{key}") + KAPPA)
    said = lambda key, kinds: F.when(F.col(key) == "", F.lit(0.0)).otherwise(F.log((own(f"n_{key}") + ALPHA) / (own("n_all") + ALPHA * F.col(kinds))))
    hint = KAPPA / (others("t_domain") + KAPPA)
    fused = F.col("ll") + F.log(prior) + said("declared", "kd") + hint * said("suffix", "ks")
    best = t.select("row", "l", fused.alias("s"), "ll").groupBy("row").agg(
        F.max_by("l", F.struct("s", -F.col("l"))).alias("l"), F.max("s").alias("top"), F.collect_list("s").alias("all"), F.max_by("l", F.struct("ll", -F.col("l"))).alias("tl")
    )  # one value per language
    confidence = 1 / F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    best = best.select("row", F.element_at(names, F.col("l") + 1).alias("lang"), confidence.alias("confidence"), F.element_at(names, F.col("tl") + 1).alias("text_lang"))
    return rows.join(best, "row").select("page_id", "lang", "confidence", "text_lang", "declared", "suffix", "host")
