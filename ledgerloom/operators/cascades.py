"""What goes with a row that is deleted: references between tables, followed in order.

A reference either takes its row along (cascade) or is emptied (set null), with the columns that mean nothing without it.
The result is deltas for the store: keys of rows that go, and rows as they are afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.bridge import Ledger


@dataclass(frozen=True)
class Reference:
    table: str
    column: str
    target: str
    cascades: bool
    emptied: tuple[str, ...] = field(default=())  # with the column itself, where it does not cascade


#: The ledger's own references.
REFERENCES = (
    Reference("rules", "category_id", "categories", True), Reference("entries", "category_id", "categories", False), Reference("entries", "rule_id", "rules", False),
    Reference("rules_tags", "rule_id", "rules", True), Reference("rules_tags", "tag_id", "tags", True), Reference("transactions_tags", "tag_id", "tags", True), Reference("transactions_tags", "transaction_id", "transactions", True),
    Reference("entries", "transaction_id", "transactions", True),
)
KEYS = {"categories": ("id",), "rules": ("id",), "tags": ("id",), "transactions": ("id",), "entries": ("id",), "rules_tags": ("rule_id", "tag_id"), "transactions_tags": ("transaction_id", "tag_id")}


def in_order(references: tuple[Reference, ...]) -> list[str]:
    """Tables, each after all that its cascading references lead to; raises on a circle."""
    left, out = {r.table for r in references} | {r.target for r in references}, []
    while left:
        free = sorted(t for t in left if not any(r.table == t and r.target in left for r in references if r.cascades))
        if not free:
            raise ValueError(f"references in a circle: {sorted(left)}")
        out += free
        left -= set(free)
    return out


def deleted(tables: dict[str, DataFrame], gone: dict[str, DataFrame], references: tuple[Reference, ...] = REFERENCES, keys: dict[str, tuple[str, ...]] = KEYS) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(keys of the rows that go, changed rows) by table, from the rows ``gone`` (by key) that are asked to go.

    Keys that no row has are passed over.  A row that two references reach goes once, and one that goes is not changed too.
    """
    removed: dict[str, DataFrame] = {}
    for name in in_order(references):
        if name not in tables:
            continue
        rows, key = tables[name], list(keys[name])
        parts = [rows.join(gone[name].select(*key).distinct(), key, "left_semi").select(*key)] if name in gone else []
        for r in references:
            if r.table == name and r.cascades and r.target in removed:
                parts.append(rows.join(removed[r.target].toDF(r.column), r.column, "left_semi").select(*key))
        if parts:
            removed[name] = reduce(DataFrame.union, parts).distinct()
    changed: dict[str, DataFrame] = {}
    for name in tables:
        hits = [r for r in references if r.table == name and not r.cascades and r.target in removed]
        if not hits:
            continue
        rows = tables[name].join(removed[name], list(keys[name]), "left_anti") if name in removed else tables[name]
        for r in hits:
            lost = removed[r.target].toDF(r.column).withColumn(f"lost_{r.column}", F.lit(True))
            rows = rows.join(lost, r.column, "left")
        flags = [F.coalesce(F.col(f"lost_{r.column}"), F.lit(False)) for r in hits]
        rows = rows.filter(reduce(lambda a, b: a | b, flags))
        for c in tables[name].columns:
            empty = [flag for r, flag in zip(hits, flags, strict=True) if c in (r.column, *r.emptied)]
            if empty:
                rows = rows.withColumn(c, F.when(~reduce(lambda a, b: a | b, empty), F.col(c)))
        changed[name] = rows.select(tables[name].columns)
    return removed, changed


def _tables(ledger: Ledger) -> dict[str, DataFrame]:
    """Categories, rules and tags from the parts' brands, types and sizes; entries and tags of transactions from the lines that sell them."""
    part = ledger.table("part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("string").alias("size"))
    sold = ledger.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return {
        "categories": part.select(F.col("p_brand").alias("id")).distinct(), "tags": part.select(F.col("size").alias("id")).distinct(),
        "rules": part.groupBy(F.col("p_type").alias("id")).agg(F.min("p_brand").alias("category_id")),
        "rules_tags": part.select(F.col("p_type").alias("rule_id"), F.col("size").alias("tag_id")).distinct(),
        "transactions_tags": sold.select(F.col("l_orderkey").alias("transaction_id"), F.col("size").alias("tag_id")).distinct(),
        "entries": sold.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("transaction_id"), F.col("p_brand").alias("category_id"), F.col("p_type").alias("rule_id")),
    }


def cascaded_deletes(ledger: Ledger) -> DataFrame:
    """What goes and what changes when the categories Brand#1x and the tags of sizes that end in 0 are deleted."""
    tables = _tables(ledger)
    gone = {"categories": tables["categories"].filter("id like 'Brand#1%'"), "tags": tables["tags"].filter("id like '%0'")}
    removed, changed = deleted(tables, gone)
    outs = [rows.select(F.lit(name).alias("table_name"), F.concat_ws("|", *rows.columns).alias("key"), F.lit(True).alias("removed"), F.lit(None).cast("string").alias("category_id"), F.lit(None).cast("string").alias("rule_id")) for name, rows in removed.items()]
    outs += [rows.select(F.lit(name).alias("table_name"), F.col("id").alias("key"), F.lit(False).alias("removed"), "category_id", "rule_id") for name, rows in changed.items()]
    return reduce(DataFrame.unionByName, outs)


_SOLD = "lineitem JOIN part ON l_partkey = p_partkey"
ORACLES = {
    "cascaded_deletes": f"""
        WITH rules AS (SELECT p_type AS id, min(p_brand) AS category_id FROM part GROUP BY p_type), lost AS (SELECT id FROM rules WHERE category_id LIKE 'Brand#1%')
        SELECT 'categories' AS table_name, p_brand AS "key", true AS removed, cast(NULL AS varchar) AS category_id, cast(NULL AS varchar) AS rule_id FROM part WHERE p_brand LIKE 'Brand#1%' GROUP BY p_brand
        UNION ALL SELECT 'tags', cast(p_size AS varchar), true, NULL, NULL FROM part WHERE p_size % 10 = 0 GROUP BY p_size
        UNION ALL SELECT 'rules', id, true, NULL, NULL FROM lost
        UNION ALL SELECT DISTINCT 'rules_tags', concat(p_type, '|', p_size), true, NULL, NULL FROM part WHERE p_type IN (SELECT id FROM lost) OR p_size % 10 = 0
        UNION ALL SELECT DISTINCT 'transactions_tags', concat(l_orderkey, '|', p_size), true, NULL, NULL FROM {_SOLD} WHERE p_size % 10 = 0
        UNION ALL SELECT 'entries', concat(l_orderkey, ':', l_linenumber), false, CASE WHEN p_brand NOT LIKE 'Brand#1%' THEN p_brand END, CASE WHEN p_type NOT IN (SELECT id FROM lost) THEN p_type END
        FROM {_SOLD} WHERE p_brand LIKE 'Brand#1%' OR p_type IN (SELECT id FROM lost)""",
}
QUERIES = {"cascaded_deletes": cascaded_deletes}
