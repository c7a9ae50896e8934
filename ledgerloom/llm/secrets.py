"""Secret scans: candidate strings, and a random forest that removes false positives; DataFrame operations alone.

Candidates are unbroken runs of 16 or more key characters with a digit among them, however long; the stretches
between signs inside such runs (a key at the end of a path) that are of that form too; tokens of three or more
parts between dots; private keys between their dashed lines; and values assigned to
credential names, whatever their length and characters.  Each gets features of
five kinds: its length, the transitions between its character classes, its coverage by dictionary words, the
path it was found in, and its neighbouring words.  A random forest (Spark's own, in the JVM) is trained from
labelled findings, a bounded sample, and scores every finding.

Without findings labelled by hand the query labels some itself, with narrow rules of high precision: keys of a
vendor's exact form and values assigned to credential names are true; numbers alone, UUIDs and parts of
addresses are false; all others stay unlabelled, and the forest decides on them.  As the rules look at what
stands around a finding, the forest also learns from each labelled one without that, so that it cannot just
repeat the rules.  (A test plants secrets and
lookalikes that no rule labels, and holds the forest to precision and recall on them.)  Findings themselves are
never written to the shared folder: only the features and labels of labelled ones are, until the forest has grown.

Defined results: null and empty texts have no findings; a null path counts as empty; a null id stays; repeated
rows give their findings each; without findings of both labels a finding keeps the share of true labels (0.5 if
none) as its score; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bound, discard, durable, sums_before

KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
#: Parts between dots, as in signed web tokens; and private keys.
DOTTED = r"(?<![A-Za-z0-9_.-])(?=[A-Za-z_.-]*+[0-9])[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,}){2,}"
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*+-----END [A-Z ]*PRIVATE KEY-----"
#: Forms that vendors document for their keys.
VENDOR = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+){2}|-----BEGIN [\s\S]*)$"
SHORTEST = 16
BEFORE, AFTER = 40, 24
#: Words whose letters count as covered; common words and the usual placeholders.
DICTIONARY = ("the", "and", "for", "with", "that", "this", "from", "have", "not", "you", "are", "your", "test", "example", "sample", "dummy", "change", "user", "name", "file", "data", "value", "version", "image", "page", "index", "default", "string", "config", "server", "table", "order", "number", "report", "update", "release", "build", "http", "html", "www", "com")
CREDENTIAL = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private)"
#: A credential's name and the value assigned to it, which ends the match.
ASSIGNED = CREDENTIAL + r"""[A-Za-z0-9_-]*+["'`]?[ \t]*+(?:=>|:=|[=:])[ \t]*+["'`]?((?<=")[^"\r\n]++|(?<=')[^'\r\n]++|(?<=`)[^`\r\n]++|(?<!["'`])[^\s"'`,;]++)"""
HARMLESS = r"(?i)(?:example|sample|dummy|placeholder|test|sha-?[0-9]*|md5|commit|checksum|isbn|order|invoice|card|phone|tel|uuid|https?|www)"
FEATURES = ("length", "digits", "uppers", "lowers", "symbols", "transitions", "hex_only", "variety", "coverage", "vowels",
            "path_depth", "path_harmless", "assigned", "quoted", "credential_near", "harmless_near", "address")
#: What stands around a finding, by which the rules below label.
CONTEXT = ("assigned", "quoted", "credential_near", "harmless_near", "address")


PLACES = "array<struct<start:int,finding:string>>"


def _places(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, finding) of all matches of a pattern; a group must end its match."""
    between, found, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))
    sizes = F.zip_with(lengths(F.slice(between, 1, F.size(found))), lengths(found), lambda b, m: b + m)
    starts = bound(sizes, lambda z: F.zip_with(sums_before(z), z, lambda at, n: at + n))  # where each match ends
    return F.zip_with(starts, values, lambda end, v: F.struct((end - F.length(v)).alias("start"), v.alias("finding")))


def _segments(place: Column) -> Column:
    """(start, finding) of the stretches between signs of a finding that are candidates themselves; none where it has no sign inside."""
    whole = F.length(F.regexp_replace(place["finding"], "=+$", ""))
    parts = F.split(place["finding"], "[^A-Za-z0-9]", -1)
    starts = sums_before(F.transform(parts, lambda s: F.length(s) + 1))
    placed = F.zip_with(parts, starts, lambda s, at: F.struct((place["start"] + at).alias("start"), s.alias("finding")))
    cut = F.filter(placed, lambda x: (F.length(x["finding"]) >= SHORTEST) & (F.length(x["finding"]) < whole) & x["finding"].rlike("[0-9]"))
    return F.when(place["finding"].rlike("[+/_-]"), cut).otherwise(F.array().cast(PLACES))


def candidates(docs: DataFrame, *, path_col: str = "source") -> DataFrame:
    """(doc_id, path, start, finding, before, after) of every candidate in the whole texts; start counts characters from 0."""
    text = F.col("text")
    named = docs.select("doc_id", F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), "text").filter(text.rlike(KEY) | text.rlike(ASSIGNED) | text.rlike(DOTTED) | text.rlike(PEM))
    runs = named.select("*", _places(text, KEY).alias("runs"))
    more = [F.when(F.contains(text, F.lit(sign)), _places(text, pattern)).otherwise(F.array().cast(PLACES)) for sign, pattern in ((".", DOTTED), ("PRIVATE KEY", PEM))]
    places = F.array_distinct(F.concat(F.col("runs"), F.flatten(F.transform("runs", _segments)), _places(text, ASSIGNED, 1), *more))
    hits = runs.select("doc_id", "path", "text", F.explode(places).alias("hit"))
    begin, end = F.col("hit.start"), F.col("hit.start") + F.length("hit.finding")
    return hits.select(
        "doc_id", "path", F.col("hit.start").alias("start"), F.col("hit.finding").alias("finding"),
        text.substr(F.greatest(begin - BEFORE, F.lit(0)) + 1, F.least(begin, F.lit(BEFORE))).alias("before"), text.substr(end + 1, F.lit(AFTER)).alias("after"),
    )


def with_features(found: DataFrame) -> DataFrame:
    c, length = F.col("finding"), F.length("finding")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / length
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    rest = F.length(F.regexp_replace(F.lower(c), "|".join(DICTIONARY), ""))
    near = F.concat_ws(" ", "before", "after")
    flag = lambda condition: condition.cast("double")
    columns = {
        "length": length.cast("double"), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "symbols": share(r"[^A-Za-z0-9]"),
        "transitions": (runs - 1) / length, "hex_only": flag(c.rlike("^[0-9a-f]+$") | c.rlike("^[0-9A-F]+$")), "variety": F.size(F.array_distinct(F.split(c, ""))) / length,
        "coverage": 1 - rest / length, "vowels": share("(?i)[aeiou]"),
        "path_depth": (F.size(F.split("path", "/")) - 1).cast("double"), "path_harmless": flag(F.col("path").rlike("(?i)test|doc|example|sample|fixture|mock")),
        "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"']?$")), "quoted": flag(F.col("before").rlike("[\"'`]$")),
        "credential_near": flag(F.col("before").rlike(CREDENTIAL)), "harmless_near": flag(near.rlike(HARMLESS)), "address": flag(F.col("before").rlike(r"(?:://|@|www\.|/)[^\s]*$") | F.col("after").rlike(r"^[@.][A-Za-z]")),
    }
    return found.select("*", *[value.alias(name) for name, value in columns.items()])


def narrow_labels(featured: DataFrame) -> DataFrame:
    """Add ``label``: 1.0, 0.0 or null, by rules that speak only where they are sure: of assigned values, on those in a key's form."""
    c, before = F.col("finding"), F.col("before")
    true = c.rlike(VENDOR) | (before.rlike(CREDENTIAL + r"[\"']?\s*[=:]\s*[\"']?$") & c.rlike("^" + KEY + "$"))
    false = c.rlike("^[0-9]+$") | c.rlike(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$") | (F.col("address") == 1) | c.rlike(r"^[0-9/_-]+$")
    return featured.withColumn("label", F.when(false & ~true, 0.0).when(true & ~false, 1.0))


def scan(docs: DataFrame, labelled: DataFrame | None = None, *, path_col: str = "source", sample: int = 20_000, trees: int = 24, depth: int = 6, seed: int = 13, limit: float = 0.5) -> DataFrame:
    """Every finding with ``score`` and ``kept``.  ``labelled``: rows with the features and ``label``, else ``narrow_labels``.

    The forest learns from ``sample`` findings of each label at most, in the order of a hash.
    """
    found = narrow_labels(with_features(candidates(docs, path_col=path_col)))
    known = found if labelled is None else labelled
    order = F.xxhash64(F.lit(seed), *([] if labelled is not None else ["finding", "before"]), *FEATURES)
    # one pass over the texts: the features alone of all labelled findings
    known = durable(known.filter(F.col("label").isin(0.0, 1.0)).select(order.alias("order"), *FEATURES, "label"), "labelled-features")
    chosen = [known.filter(F.col("label") == v).orderBy("order", *FEATURES).limit(sample).select(*FEATURES, "label") for v in (0.0, 1.0)]
    learnt = durable(chosen[0].union(chosen[1]), "learnt-features")
    discard(known)
    if labelled is None:
        bare = learnt.select(*[F.lit(0.0).alias(c) if c in CONTEXT else F.col(c) for c in FEATURES], "label")
    both = learnt if labelled is not None else learnt.union(bare)
    seen = {r["label"]: r["count"] for r in learnt.groupBy("label").count().collect()}
    if len(seen) < 2:
        discard(learnt)
        return found.withColumn("score", F.lit(float(next(iter(seen), 0.5)))).withColumn("kept", F.col("score") >= limit)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="forest_features")
    forest = RandomForestClassifier(featuresCol="forest_features", labelCol="label", predictionCol="forest_prediction", rawPredictionCol="forest_raw", probabilityCol="forest_probability", numTrees=trees, maxDepth=depth, seed=seed)
    model = forest.fit(assembler.transform(both))
    discard(learnt)
    scored = model.transform(assembler.transform(found))
    return scored.withColumn("score", vector_to_array("forest_probability")[1]).withColumn("kept", F.col("score") >= limit)


def op4_secret_scan(docs: DataFrame) -> DataFrame:
    """Every finding of the whole table with its score; ``kept`` findings are secrets."""
    found = scan(docs.select("doc_id", "text", "source"))
    return found.select("doc_id", "start", "finding", "score", "kept", F.col("label").cast("int").alias("rule_label"))
