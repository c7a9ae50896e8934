"""URL filters by path-template trees, in DataFrame operations alone.

Fixed rules decide where one fits.  For all other urls each host has a tree of path templates: variable
segments (numbers, hexadecimal strings, long names with digits) become wildcards by their shape, and a node
with many different children becomes one wildcard child, from the root down to the real depth of the paths.  On
every level children whose share of unwanted labels does not differ from that of their siblings together, by
the two-proportion z-test with a pooled variance, are merged into one branch.  A
template is rejected where its share of unwanted labels, smoothed towards the corpus's, passes a limit.

Pages are first summed up to counts by (host, template), so that the tree is built from distinct templates,
however many pages one host has; a node's rows and the verdicts meet over salted keys, and only pages with a
number meet labels.

Defined results: a null url or one without ``://`` has empty host and path and is judged as the template of
the empty host; urls without any label take the corpus's share; repeated pages and null ids stay separate rows;
an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, UPPER, durable

#: Fixed rules: (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
SALTS = 16


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(whole, F.lit("://")), F.regexp_replace(whole, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits, or null."""
    fits = [
        F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
               F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def template(path: Column) -> Column:
    """Segments of a path, of any depth, with the variable ones as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(r"^[0-9]+$"), "{n}").when(s.rlike(r"^[0-9]+\.[a-zA-Z]{1,5}$"), F.concat(F.lit("{n}."), F.regexp_extract(s, r"([a-zA-Z]+)$", 1)))
                         .when(s.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "{h}").when((F.length(s) > 24) | s.rlike(r"[0-9].*[0-9].*[0-9]"), "{s}").otherwise(s))


def _steps(nodes: DataFrame, *columns: str) -> DataFrame:
    """One row a segment of every leaf: its level, and its head, a digest of all segments before it and their places.

    The digest is two running sums of hashes over a leaf's segments, so that a path takes time and room linear in its depth.
    """
    before = Window.partitionBy("host", "leaf").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), "level", "child").cast("decimal(38,0)")).over(before), F.lit(0))
    steps = nodes.select("host", "leaf", *columns, F.posexplode("parts").alias("level", "child"))
    return steps.withColumn("head", F.concat_ws(":", "level", total(1), total(2)))


def _wild(nodes: DataFrame, levels: DataFrame) -> DataFrame:
    """Make wildcards of the segments at ``levels``, an array a leaf."""
    at = F.coalesce("wild", F.array().cast("array<int>"))
    return nodes.join(levels, ["host", "leaf"], "left").withColumn("parts", F.transform("parts", lambda s, i: F.when(F.array_contains(at, i), F.lit("*")).otherwise(s))).drop("wild")


def _generalised(nodes: DataFrame, most_children: int) -> DataFrame:
    """Where a node has over ``most_children`` different children, they become one wildcard.

    That joins what lies below, so a round takes only nodes with no such node above them; rounds go on until none is left.
    """
    while True:
        steps = _steps(nodes)
        many = steps.groupBy("host", "head").agg(F.count_distinct("child").alias("children")).filter(F.col("children") > most_children).select("host", "head")
        salted = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # all leaves of a host meet at its root
        hit = steps.withColumn("salt", F.pmod(F.xxhash64("leaf"), F.lit(SALTS)).cast("int")).join(salted, ["host", "head", "salt"], "left_semi")
        levels = durable(hit.groupBy("host", "leaf").agg(F.array(F.min("level")).alias("wild")), "url-many")
        if levels.isEmpty():
            return nodes
        nodes = durable(_wild(nodes, levels), "url-tree")


def differs(n: Column, bad: Column, others: Column, bad_others: Column) -> Column:
    """The two-proportion z statistic of a child and its siblings; null where either has no label, or all labels are alike."""
    pooled = F.try_divide(bad + bad_others, n + others)
    spread = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), others))
    return F.try_divide(F.abs(F.try_divide(bad, n) - F.try_divide(bad_others, others)), F.sqrt(spread))


def _merged(nodes: DataFrame, z: float) -> DataFrame:
    """Children whose share is not significantly off their siblings' become one wildcard, on all levels at once."""
    steps = durable(_steps(nodes, "labelled", "bad"), "url-steps")
    # a node has ``most_children`` children at most by now, so these rows and their join are small
    here = steps.groupBy("host", "head", "child").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    parents = here.groupBy("host", "head").agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"))
    off = differs(F.col("n"), F.col("b"), F.col("pn") - F.col("n"), F.col("pb") - F.col("b"))
    alike = here.join(parents, ["host", "head"]).filter(F.coalesce(off, F.lit(0.0)) < z).select("host", "head", "child")
    salted = alike.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = steps.withColumn("salt", F.pmod(F.xxhash64("leaf"), F.lit(SALTS)).cast("int")).join(salted, ["host", "head", "child", "salt"], "left_semi")
    return _wild(nodes, hit.groupBy("host", "leaf").agg(F.collect_list("level").alias("wild")))


def templates(pages: DataFrame, most_children: int = 24, z: float = 2.58, smoothing: float = 8.0) -> DataFrame:
    """From (host, path, labelled, bad): the final template and smoothed share of each (host, first template)."""
    leaves = pages.groupBy("host", template(F.col("path")).alias("first")).agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    leaves = durable(leaves, "url-leaves")
    leaf = F.md5(F.array_join("first", "/").cast("binary")).alias("leaf")
    nodes = durable(_merged(_generalised(leaves.select("*", leaf, F.col("first").alias("parts")), most_children), z), "url-tree")
    corpus = leaves.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.5)).alias("prior"))
    summed = nodes.groupBy("host", "parts").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    scored = summed.crossJoin(F.broadcast(corpus)).withColumn("impurity", (F.col("bad") + F.col("prior") * smoothing) / (F.col("labelled") + smoothing))
    salted = scored.select("host", "parts", "labelled", "impurity").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # one template may hold most of a host's
    own = nodes.select("host", "first", "parts", F.pmod(F.xxhash64("leaf"), F.lit(SALTS)).cast("int").alias("salt"))
    return own.join(salted, ["host", "parts", "salt"]).withColumn("template", F.concat(F.lit("/"), F.array_join("parts", "/"))).drop("parts", "salt")


def judge(pages: DataFrame, labels: DataFrame, limit: float = 0.5, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Verdict of every page.  ``pages``: page_id, url; ``labels``: url_key and bad (0 or 1) of known urls.

    A page's key is the last number in its path.
    """
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = split.withColumn("url_key", F.expr("try_cast(regexp_extract(path, '/([0-9]{1,18})[^/0-9]*/?$', 1) as bigint)"))
    known = labels.filter("url_key is not null").groupBy("url_key").agg(F.max("bad").alias("bad"))
    labelled = keyed.filter("url_key is not null").join(known, "url_key", "left").select("host", "path", F.when(F.col("bad").isNotNull(), 1).otherwise(0).alias("labelled"), F.coalesce("bad", F.lit(0)).alias("bad"))
    counted = labelled.union(keyed.filter("url_key is null").select("host", "path", F.lit(0), F.lit(0)))  # these would all meet at the null key
    learned = templates(counted).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shaped = split.withColumn("first", template(F.col("path"))).withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    return (
        shaped.join(learned, ["host", "first", "salt"], "left").withColumn("hit", rule)
        .select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                F.coalesce(F.col("hit.verdict"), F.when(F.col("impurity") > limit, "block").otherwise("allow")).alias("verdict"),
                "template", F.col("impurity").alias("score"))
    )


def op10_url_filter(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdicts of all pages; a page is unwanted where its document's label is of low quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    return judge(pages.select("page_id", "url"), labels.select(F.col("doc_id").cast("long").alias("url_key"), bad.alias("bad")))
