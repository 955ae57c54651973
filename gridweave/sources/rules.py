"""Rule sets: literal rows, plain mappings and XML rule files.

A rule set is configuration (tens of rows), so it is built on the driver and later
broadcast by the operators after a size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.functions.text import decode_references

RULES_SCHEMA = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("regex", T.StringType()),
    ]
)


def rules_frame(spark: SparkSession, rule_id: str, rows) -> DataFrame:
    """Rules from literal ``(ord, kind, source, target, regex)`` tuples."""
    import pandas as pd

    data = [(rule_id, int(o), k, s, t, r) for o, k, s, t, r in rows]
    pdf = pd.DataFrame(data, columns=[f.name for f in RULES_SCHEMA.fields]).astype({"ord": "int32"})
    # A pandas frame becomes a local relation through Arrow: no Python worker job.
    return spark.createDataFrame(pdf, RULES_SCHEMA)


def rules_from_dict(spark: SparkSession, rule_id: str, mapping: dict, regexes: dict | None = None) -> DataFrame:
    """Rules from an ordered ``{source: target}`` mapping; keys starting with ``@``
    are select rules, ``regexes`` optionally gives their second regex."""
    regexes = regexes or {}
    rows = []
    for i, (src, tgt) in enumerate(mapping.items()):
        kind = "select" if src.startswith("@") else "attr"
        rows.append((i, kind, src, tgt, regexes.get(src) if kind == "select" else None))
    return rules_frame(spark, rule_id, rows)


# Schema of one <spider> element of an XML rule file, as the Spark XML source reads it.
# The url tree's depth is taken from the files.
_COL = T.StructType(
    [
        T.StructField("_attri", T.StringType()),
        T.StructField("_select", T.StringType()),
        T.StructField("_regex", T.StringType()),
        T.StructField("_text", T.StringType()),
    ]
)
_COND = T.StructType(
    [
        T.StructField("_xpath", T.StringType()),
        T.StructField("_regex", T.StringType()),
    ]
)


def _url_type(depth: int) -> T.StructType:
    fields = [
        T.StructField("_value", T.StringType()),
        T.StructField("_mapping", T.StringType()),
        T.StructField("_output", T.StringType()),
        T.StructField("_xpath", T.StringType()),
        T.StructField("_regex", T.StringType()),
        T.StructField("_text", T.StringType()),
        T.StructField("next", T.ArrayType(_COND)),
    ]
    if depth > 1:
        fields.append(T.StructField("url", T.ArrayType(_url_type(depth - 1))))
    else:  # deepest level read: children are only counted, not unrolled
        fields.append(T.StructField("url", T.ArrayType(T.StructType([T.StructField("_value", T.StringType())]))))
    return T.StructType(fields)


def _spider_schema(depth: int) -> T.StructType:
    """Schema of a ``<spider>`` element whose url tree has ``depth`` levels. Outputs are
    kept as their XML text, so any sink tag comes through."""
    rule = T.StructType([T.StructField("_id", T.StringType()), T.StructField("table", T.StructType([T.StructField("col", T.ArrayType(_COL))]))])
    return T.StructType(
        [
            T.StructField("_id", T.StringType()),
            T.StructField("_class", T.StringType()),
            T.StructField("_is_active", T.StringType()),
            T.StructField("url", T.ArrayType(_url_type(depth))),
            T.StructField("mapping", T.ArrayType(rule)),
        ]
    )


def url_depth(spark: SparkSession, path: str) -> int:
    """The deepest nesting of ``<url>`` in the rule files (rule files are configuration,
    read whole)."""
    marks = spark.read.text(path, wholetext=True).select(
        F.regexp_extract_all(F.regexp_replace("value", r"(?s)<!--.*?-->", ""), F.lit(r"<(/?url\b)[^>]*?(/?)>"), 1).alias("t"),
        F.regexp_extract_all(F.regexp_replace("value", r"(?s)<!--.*?-->", ""), F.lit(r"<(/?url\b)[^>]*?(/?)>"), 2).alias("s"),
    )
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a, x):
        now = a["now"] + F.when(x["t"].startswith("/"), -1).otherwise(1)
        most = F.greatest(a["most"], now)
        return F.struct(F.when(x["s"] == "/", a["now"]).otherwise(now).alias("now"), most.alias("most"))

    deep = marks.select(F.aggregate(F.arrays_zip("t", "s"), state, step)["most"].alias("d")).agg(F.max("d")).first()[0]
    return max(1, deep or 1)


def read_spiders(spark: SparkSession, path: str, depth: int | None = None) -> DataFrame:
    """S2 (raw): one row per ``<spider>`` with the file it came from."""
    return (
        spark.read.format("xml")
        .option("rowTag", "spider")
        .option("valueTag", "_text")
        .schema(_spider_schema(depth or url_depth(spark, path)))
        .load(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """XML rule files to ``(steps, rules, outputs)``.

    steps: spider_id, class, is_active, step_id, parent_step, cond_ord, url, xpath,
    regex, is_next, mapping_id, output_id. ``step_id`` is the path of child indexes.
    rules: spider_id, rule_id (mapping id or ``default``), ord, kind, source, target, regex.
    outputs: spider_id, output_id (or ``default``), sink, key.
    """
    depth = url_depth(spark, path)
    sp = read_spiders(spark, path, depth).select(
        F.col("_id").alias("spider_id"),
        F.col("_class").alias("class"),
        F.col("_is_active").alias("is_active"),
        "url",
        "mapping",
    )
    head = ["spider_id", "class", "is_active"]
    # Unroll the url tree level by level, to the depth of the files.
    level = sp.select(
        *head,
        F.posexplode("url").alias("cond_ord", "u"),
    ).select(
        *head,
        F.array(F.col("cond_ord")).alias("step_id"),
        F.lit(None).cast("array<int>").alias("parent_step"),
        "cond_ord",
        "u",
    )
    levels = []
    for d in range(depth):
        levels.append(level)
        if d == depth - 1:
            break
        # Children: url conditions first, then next-page conditions; their index is the
        # position among all condition children, as in the file.
        level = level.select(
            *head,
            F.col("step_id").alias("parent_step"),
            F.posexplode_outer("u.url").alias("cond_ord", "child"),
        ).where(F.col("child").isNotNull()).select(
            *head,
            F.concat("parent_step", F.array("cond_ord")).alias("step_id"),
            "parent_step",
            "cond_ord",
            F.col("child").alias("u"),
        )
    url_text = F.trim(F.coalesce(F.col("u._text"), F.col("u._value")))

    def flat(lv):
        # Each level's struct type differs (one nesting less per level), so levels are
        # flattened to the same columns before the union.
        st = lv.select(
            *head,
            "step_id",
            "parent_step",
            "cond_ord",
            url_text.alias("url"),
            F.col("u._xpath").alias("xpath"),
            F.col("u._regex").alias("regex"),
            F.lit(False).alias("is_next"),
            F.col("u._mapping").alias("mapping_id"),
            F.col("u._output").alias("output_id"),
        )
        # The XML reader keeps url and next children in separate arrays; next
        # conditions are numbered after the url conditions of the same step.
        nx = lv.select(
            *head,
            "step_id",
            F.greatest(F.coalesce(F.size("u.url"), F.lit(0)), F.lit(0)).alias("n_urls"),
            F.posexplode("u.next").alias("n_ord", "n"),
        ).select(
            *head,
            F.col("step_id"),
            F.col("step_id").alias("parent_step"),
            (F.col("n_urls") + F.col("n_ord")).alias("cond_ord"),
            F.lit(None).cast("string").alias("url"),
            F.col("n._xpath").alias("xpath"),
            F.col("n._regex").alias("regex"),
            F.lit(True).alias("is_next"),
            F.lit(None).cast("string").alias("mapping_id"),
            F.lit(None).cast("string").alias("output_id"),
        )
        return st.unionByName(nx)

    steps_out = flat(levels[0])
    for lv in levels[1:]:
        steps_out = steps_out.unionByName(flat(lv))

    rules = (
        sp.select("spider_id", F.explode("mapping").alias("m"))
        .select(
            "spider_id",
            F.coalesce(F.col("m._id"), F.lit("default")).alias("rule_id"),
            F.posexplode("m.table.col").alias("ord", "c"),
        )
        .select(
            "spider_id",
            "rule_id",
            F.col("ord").cast("int").alias("ord"),
            F.when(F.col("c._select").isNotNull(), F.lit("select")).otherwise(F.lit("attr")).alias("kind"),
            F.coalesce(F.col("c._select"), F.col("c._attri")).alias("source"),
            F.col("c._text").alias("target"),
            F.when(F.col("c._select").isNotNull(), F.col("c._regex")).alias("regex"),
        )
    )
    return steps_out, rules, read_outputs(spark, path)


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """The sinks of every ``<outputs>`` element, whatever their tags: spider_id, output_id
    (or ``default``), sink, key."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?s)<!--.*?-->", "").alias("v"))
    spiders = files.select(F.explode(F.regexp_extract_all("v", F.lit(r"(?s)(<spider\b.*?</spider>)"), 1)).alias("v"))
    attr_id = lambda c: F.regexp_extract(c, r"""^<\w+\b[^>]*?\bid\s*=\s*["']([^"']*)["']""", 1)
    none = lambda c: F.when(c != "", c)
    sets = spiders.select(none(attr_id(F.col("v"))).alias("spider_id"), F.explode(F.regexp_extract_all("v", F.lit(r"(?s)(<outputs\b.*?</outputs>)"), 1)).alias("o"))
    tags = F.regexp_extract_all(F.regexp_replace("o", r"(?s)^<outputs\b[^>]*>", ""), F.lit(r"(?s)<([A-Za-z_][\w.-]*)\b[^>]*>([^<]*)</\1\s*>"), 0)
    rows = sets.select("spider_id", F.coalesce(none(attr_id(F.col("o"))), F.lit("default")).alias("output_id"), F.explode(tags).alias("x"))
    text = F.trim(F.regexp_extract("x", r"(?s)>([^<]*)<", 1))
    sink = F.regexp_extract("x", r"^<([A-Za-z_][\w.-]*)", 1).alias("sink")
    return rows.withColumn("raw", text).select("spider_id", "output_id", sink, decode_references("raw").alias("key"))


def select_rules(steps: DataFrame, group: str | None = None, rule_set_id: str | None = None) -> DataFrame:
    """S3: keep active rule sets (``is_active`` absent counts as active, otherwise it must
    equal ``True``), optionally only one group and/or one id; error when none is left."""
    active = F.col("is_active").isNull() | (F.col("is_active") == "True")
    out = steps.where(active)
    if group is not None:
        out = out.where(F.col("class") == group)
    if rule_set_id is not None:
        out = out.where(F.col("spider_id") == rule_set_id)
    if out.isEmpty():
        raise ValueError(f"no active rule set matches id={rule_set_id!r} group={group!r}")
    return out


def seeds(steps: DataFrame) -> DataFrame:
    """Seed URLs = root steps. A blank seed is an error (checked by the caller via
    :func:`check_seeds`), returned rows are trimmed URLs."""
    return steps.where(F.col("parent_step").isNull() & ~F.col("is_next")).select(
        "spider_id", "step_id", "url"
    )


def check_seeds(seed_df: DataFrame) -> DataFrame:
    blank = seed_df.where(F.col("url").isNull() | (F.trim(F.col("url")) == ""))
    if not blank.isEmpty():
        raise ValueError("a root step has no URL")
    return seed_df
