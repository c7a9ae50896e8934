"""The ordered rule engine: rules become Columns, and a fold over the matching ones decides.

Household rules come before shipped ones.  A household rule's category and counterparty replace what an
earlier rule set; a shipped rule only fills what is empty.  Tags add up in the order they were first given.  A
rule that stops ends the pass.  Lines of equity accounts are never decided.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import suggest_pattern as suggest
from ledgerloom.functions.text import unaccented
from ledgerloom.operators.matching import _LABEL
from ledgerloom.plans.bridge import Ledger

LONGEST_PATTERN = 200


@dataclass(frozen=True)
class Rule:
    id: str
    priority: int
    pattern: str | None = None
    at_least: str | None = None  # signed decimal bounds, both inclusive
    at_most: str | None = None
    kind: str | None = None
    account: str | None = None
    category: str | None = None
    counterparty: str | None = None
    tags: tuple[str, ...] = ()
    stop: bool = False
    shipped: bool = False

    def __post_init__(self) -> None:
        if not (self.category or self.counterparty or self.tags):
            raise ValueError(f"rule {self.id} has no effect")
        if not any(x is not None for x in (self.pattern, self.at_least, self.at_most, self.kind, self.account)):
            raise ValueError(f"rule {self.id} has no condition")


def ordered(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (r.shipped, r.priority, r.id))


def runnable(pattern: str | None) -> str | None:
    """A pattern as the JVM will run it, its accents gone like the text's; None for one that is too long or that it cannot compile, which matches nothing."""
    if pattern is None:
        return None
    text = "".join(c for c in unicodedata.normalize("NFD", pattern.removeprefix("(?i)")) if not unicodedata.combining(c))
    if len(pattern) > LONGEST_PATTERN:
        return None
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(f"(?iu){text}")
    except (Py4JJavaError, IllegalArgumentException):
        return None
    return f"(?iu){text}"


def with_matches(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``matches``: of the ordered rules with a pattern, whether it is in the description.  Done on transactions, once each, before they meet their entries."""
    folded = rows.withColumn("folded", unaccented(F.col("description")))
    tests = [F.coalesce(F.col("folded").rlike(p), F.lit(False)) if (p := runnable(r.pattern)) else F.lit(False) for r in ordered(rules)]
    return folded.withColumn("matches", F.array(*tests)).drop("folded")


def _fits(rule: Rule, place: int) -> Column:
    out = F.lit(True)
    if rule.pattern is not None:
        out = out & F.col("matches")[place]
    if rule.at_least is not None:
        out = out & (F.col("amount") >= F.lit(rule.at_least).cast("decimal(28,10)"))
    if rule.at_most is not None:
        out = out & (F.col("amount") <= F.lit(rule.at_most).cast("decimal(28,10)"))
    if rule.kind is not None:
        out = out & (F.col("kind") == rule.kind)
    if rule.account is not None:
        out = out & (F.col("account_id") == rule.account)
    return F.coalesce(out, F.lit(False))


def decide(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``decision``: struct (category, rule_id, counterparty, tags), or null where no rule fits."""
    if "matches" not in lines.columns:
        lines = with_matches(lines, rules)
    text = lambda v: F.lit(v).cast("string")
    hits = F.array_compact(F.array(*[
        F.when(_fits(r, k), F.struct(F.lit(r.id).alias("id"), text(r.category).alias("category"), text(r.counterparty).alias("counterparty"),
                                  F.array(*[F.lit(t) for t in r.tags]).cast("array<string>").alias("tags"), F.lit(r.stop).alias("stop"), F.lit(r.shipped).alias("shipped")))
        for k, r in enumerate(ordered(rules))
    ]))

    def step(a: Column, r: Column) -> Column:
        sets = r["category"].isNotNull() & ~(r["shipped"] & a["category"].isNotNull()) & ~a["done"]
        names = r["counterparty"].isNotNull() & ~(r["shipped"] & a["counterparty"].isNotNull()) & ~a["done"]
        return F.struct(
            F.when(sets, r["category"]).otherwise(a["category"]).alias("category"), F.when(sets, r["id"]).otherwise(a["rule_id"]).alias("rule_id"),
            F.when(names, r["counterparty"]).otherwise(a["counterparty"]).alias("counterparty"),
            F.when(a["done"], a["tags"]).otherwise(F.array_distinct(F.concat(a["tags"], r["tags"]))).alias("tags"), (a["done"] | r["stop"]).alias("done"))

    none = F.lit(None).cast("string")
    start = F.struct(none.alias("category"), none.alias("rule_id"), none.alias("counterparty"), F.array().cast("array<string>").alias("tags"), F.lit(False).alias("done"))
    held = lines.withColumn("hits", hits)
    decision = F.when((F.size("hits") > 0) & (F.col("classification") != "equity"), F.aggregate("hits", start, step))
    return held.withColumn("decision", decision).drop("hits", "matches")


def eligible(lines: DataFrame) -> DataFrame:
    """Lines that rules may decide: those without a category, or whose category a rule gave; a choice by hand stays."""
    return lines.filter("category_id is null or rule_id is not null")


def provenance(decided: DataFrame, own: DataFrame) -> DataFrame:
    """Add ``source`` (household or shipped), ``country`` and ``rule_name`` to lines with ``rule_id``; a shipped rule's id is country/name, ``own`` names the household's (id, name)."""
    shipped = F.contains("rule_id", F.lit("/"))
    named = decided.join(own.select(F.col("id").alias("rule_id"), F.col("name").alias("own_name")), "rule_id", "left")
    return named.select(
        *decided.columns, F.when(shipped, "shipped").when(F.col("rule_id").isNotNull(), "household").alias("source"), F.when(shipped, F.split_part("rule_id", F.lit("/"), F.lit(1))).alias("country"),
        F.when(shipped, F.split_part("rule_id", F.lit("/"), F.lit(2))).otherwise(F.col("own_name")).alias("rule_name"))


def shipped_categories(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Shipped rules (id, key) with the household's category of that key; a rule whose key it lacks has none."""
    return rules.join(categories.filter("key is not null").select("key", F.col("id").alias("category_id")), "key", "left")


class RuleSetError(ValueError):
    """What is wrong with a rule set, and where."""


#: The fields of a rule set's file and of what it holds.
SET_FIELDS = {"$comment", "country", "rules"}
RULE_FIELDS = {"$comment", "id", "name", "priority", "when", "then", "stopOnMatch"}
WHEN_FIELDS, THEN_FIELDS = {"descriptionMatches", "amountBetween"}, {"category", "counterparty"}
CONDITION_FIELDS = {"descriptionMatches", "amountBetween", "accountId"}
_DECIMAL = re.compile(r"-?\d+(?:\.\d+)?")


@dataclass(frozen=True)
class RuleSet:
    country: str
    rules: tuple[Rule, ...]  # in the order in which they run
    names: dict[str, str]

    @property
    def categories(self) -> list[str]:
        """Keys that the rules point at, in the order of the rules."""
        return list(dict.fromkeys(r.category for r in self.rules if r.category is not None))


def _known(value: object, fields: set[str], where: str) -> dict:
    if not isinstance(value, dict):
        raise RuleSetError(f"{where}: not an object")
    for name in value:
        if name not in fields:
            raise RuleSetError(f"{where}: unknown field {name}")
    return value


def _conditions(raw: dict, where: str) -> dict[str, str]:
    """The conditions of a rule as arguments of ``Rule``; each has to be one that can be tested, and the bounds of an amount in order."""
    out = {}
    if (pattern := raw.get("descriptionMatches")) is not None:
        if not isinstance(pattern, str) or not pattern.strip() or runnable(pattern) is None:
            raise RuleSetError(f"{where}: descriptionMatches is no expression")
        out["pattern"] = pattern
    if (bounds := raw.get("amountBetween")) is not None:
        if not isinstance(bounds, list) or len(bounds) != 2 or not all(isinstance(b, str) and _DECIMAL.fullmatch(b) for b in bounds) or Decimal(bounds[0]) > Decimal(bounds[1]):
            raise RuleSetError(f"{where}: amountBetween is no pair of amounts in order")
        out["at_least"], out["at_most"] = bounds
    if (account := raw.get("accountId")) is not None:
        if not isinstance(account, str) or not account:
            raise RuleSetError(f"{where}: accountId is no account")
        out["account"] = account
    if not out:
        raise RuleSetError(f"{where}: no condition, so it would match everything")
    return out


def parse_conditions(raw: object) -> dict[str, str] | None:
    """A household rule's stored conditions, or None where this version cannot use them; fields that it does not know are passed over."""
    if not isinstance(raw, dict) or any(raw.get(k, "") is None for k in CONDITION_FIELDS):
        return None
    try:
        return _conditions({k: v for k, v in raw.items() if k in CONDITION_FIELDS}, "rule")
    except RuleSetError:
        return None


def parse_rule_set(text: str, categories: set[str]) -> RuleSet:
    """A shipped rule set from JSON, checked whole: no field may be unknown, no two rules may share an id, and every rule needs a condition and an effect."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise RuleSetError(f"set: not JSON, {e}") from None
    raw = _known(raw, SET_FIELDS, "set")
    country, listed = raw.get("country"), raw.get("rules")
    if not isinstance(country, str) or not re.fullmatch("[A-Z]{2}", country):
        raise RuleSetError("set: country is no code of two letters")
    if not isinstance(listed, list) or not listed:
        raise RuleSetError("set: rules is no array of rules")
    rules, names = {}, {}
    for place, one in enumerate(listed):
        where = f"rule {place}"
        one = _known(one, RULE_FIELDS, where)
        key, name, priority = one.get("id"), one.get("name"), one.get("priority")
        if not isinstance(key, str) or not re.fullmatch("[a-z0-9]+(?:-[a-z0-9]+)*", key):
            raise RuleSetError(f"{where}: id is not in kebab case")
        if key in rules:
            raise RuleSetError(f"{where}: two rules share the id {key}")
        if not isinstance(name, str) or not name.strip():
            raise RuleSetError(f"{where}: name is missing")
        if not isinstance(priority, int) or isinstance(priority, bool):
            raise RuleSetError(f"{where}: priority is no whole number")
        when, then = _known(one.get("when"), WHEN_FIELDS, f"{where}, when"), _known(one.get("then"), THEN_FIELDS, f"{where}, then")
        category, counterparty = then.get("category"), then.get("counterparty")
        if category is not None and category not in categories:
            raise RuleSetError(f"{where}: no category {category}")
        if counterparty is not None and (not isinstance(counterparty, str) or not counterparty):
            raise RuleSetError(f"{where}: counterparty is no name")
        if category is None and counterparty is None:
            raise RuleSetError(f"{where}: no effect")
        rules[key] = Rule(f"{country.lower()}/{key}", priority, category=category, counterparty=counterparty, stop=one.get("stopOnMatch") is True, shipped=True, **_conditions(when, where))
        names[f"{country.lower()}/{key}"] = name.strip()
    return RuleSet(country, tuple(ordered(list(rules.values()))), names)


#: A household's rules and a shipped set, over the bridge's labels.
RULES = [
    Rule("h1", 1, "marché", category="groceries", tags=("food",)),
    Rule("h2", 2, "gare|station", category="transport"),
    Rule("h3", 3, at_least="100000", category="large", tags=("check", "large")),
    Rule("h4", 4, "cantine", category="restaurant", counterparty="Cantine Bleue", tags=("food",), stop=True),
    Rule("h5", 5, kind="transfer", category="transfer", tags=("internal",)),
    Rule("s1", 1, "librairie", category="books", counterparty="Librairie", shipped=True),
    Rule("s2", 2, "pharmacie|mutuelle", category="health", shipped=True),
    Rule("s3", 3, "electrique", category="energy", shipped=True),
    Rule("s4", 4, "^prlv", category="direct-debit", counterparty="Creditor", shipped=True),
    Rule("s5", 5, "^carte", category="card", shipped=True),
    Rule("s6", 6, "(unclosed", category="never", shipped=True),
]


def lines_of(ledger: Ledger) -> DataFrame:
    heads = with_matches(ledger.transactions.select("transaction_id", "description", "kind", "counterparty", "booked_on"), RULES)
    return ledger.entries.join(heads, "transaction_id").join(ledger.accounts.select("account_id", "classification"), "account_id")


def rule_decisions(ledger: Ledger) -> DataFrame:
    return decide(lines_of(ledger), RULES).filter("decision is not null").select(
        "transaction_id", "account_id", F.col("decision.category").alias("category"), F.col("decision.rule_id").alias("rule_id"), F.col("decision.counterparty").alias("new_counterparty"), F.array_join("decision.tags", ",").alias("tags"))


def rule_counts(ledger: Ledger) -> DataFrame:
    return rule_decisions(ledger).filter("category is not null").groupBy("category").agg(F.count("*").alias("n"))


def rule_preview_delta(ledger: Ledger) -> DataFrame:
    """What applying the rules writes: counterparties, only where the bank gave none."""
    return decide(lines_of(ledger), RULES).filter("decision.counterparty is not null and counterparty is null").select("transaction_id", F.col("decision.counterparty").alias("counterparty")).distinct()


def tag_union(ledger: Ledger) -> DataFrame:
    """A transaction's tags over all its lines."""
    tags = decide(lines_of(ledger), RULES).filter("size(decision.tags) > 0").select("transaction_id", F.explode("decision.tags").alias("tag")).distinct()
    return tags.groupBy("transaction_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))


def suggested_patterns(ledger: Ledger) -> DataFrame:
    return ledger.transactions.select("transaction_id", suggest(F.col("description")).alias("pattern"))


def _fold_sql() -> str:
    """The same fold as nested selects, one a rule."""
    sql = """SELECT e.transaction_id, e.account_id, e.amount, t.kind, t.counterparty, lower(strip_accents(t.description)) AS d, cast(NULL AS varchar) AS category,
        cast(NULL AS varchar) AS rule_id, cast(NULL AS varchar) AS cp, '' AS tags, false AS done, false AS hit FROM {entries} e JOIN {transactions} t ON t.transaction_id = e.transaction_id JOIN {accounts} a ON a.account_id = e.account_id WHERE classification <> 'equity'"""
    for r in ordered(RULES):
        parts = ["NOT done"]
        if r.pattern is not None:
            parts.append(f"regexp_matches(d, strip_accents('{r.pattern}'))" if r.pattern != "(unclosed" else "false")
        if r.at_least is not None:
            parts.append(f"amount >= {r.at_least}")
        if r.kind is not None:
            parts.append(f"kind = '{r.kind}'")
        fits = " AND ".join(parts)
        category = f"CASE WHEN f{' AND category IS NULL' if r.shipped else ''} THEN '{r.category}' ELSE category END"
        rule_id = f"CASE WHEN f{' AND category IS NULL' if r.shipped else ''} THEN '{r.id}' ELSE rule_id END"
        cp = f"CASE WHEN f{' AND cp IS NULL' if r.shipped else ''} THEN '{r.counterparty}' ELSE cp END" if r.counterparty else "cp"
        tags = "tags"
        for t in r.tags:
            tags = f"CASE WHEN f AND NOT list_contains(string_split({tags}, ','), '{t}') THEN CASE WHEN {tags} = '' THEN '{t}' ELSE {tags} || ',{t}' END ELSE {tags} END"
        sql = f"SELECT transaction_id, account_id, amount, kind, counterparty, d, {category} AS category, {rule_id} AS rule_id, {cp} AS cp, {tags} AS tags, done OR (f AND {str(r.stop).lower()}) AS done, hit OR f AS hit FROM (SELECT *, {fits} AS f FROM ({sql}) x) y"
    return f"SELECT * FROM ({sql}) z WHERE hit"


_SUGGEST = "array_to_string(list_slice([w for w in string_split({0}, ' ') if w <> '' AND w <> '#' AND NOT list_contains([{1}], w) AND NOT regexp_matches(w, '^[0-9]+$')], 1, 2), ' ')"


def _oracles() -> dict[str, str]:
    from ledgerloom.functions.text import BOILERPLATE

    fold = _fold_sql()
    return {
        "rule_decisions": f"SELECT transaction_id, account_id, category, rule_id, cp AS new_counterparty, tags FROM ({fold}) w",
        "rule_counts": f"SELECT category, count(*) AS n FROM ({fold}) w WHERE category IS NOT NULL GROUP BY 1",
        "rule_preview_delta": f"SELECT DISTINCT transaction_id, cp AS counterparty FROM ({fold}) w WHERE cp IS NOT NULL AND counterparty IS NULL",
        "tag_union": f"SELECT transaction_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT transaction_id, unnest(string_split(tags, ',')) AS tag FROM ({fold}) w WHERE tags <> '') u GROUP BY 1",
        "suggested_patterns": "SELECT transaction_id, " + _SUGGEST.replace("{0}", "label").replace("{1}", ", ".join(f"'{b}'" for b in BOILERPLATE)) + f" AS pattern FROM (SELECT transaction_id, {_LABEL} AS label FROM {{transactions}}) t",
    }


ORACLES = _oracles()
QUERIES = {n: globals()[n] for n in ORACLES}
