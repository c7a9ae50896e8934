"""Posting transactions and reversing them: a batch is checked whole against what stands, and is written whole or refused.

A commit follows the version that its checks have read, so of two reversals of one transaction, posted at once, one is
checked again and refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ledger import LedgerError
from ledgerloom.operators.store import Conflict, Store
from ledgerloom.plans.bridge import Ledger

#: What a transaction may be refused for; the first that holds is told.
REASONS = ("fewer than two entries", "unknown account", "entry not in its account's currency", "does not balance", "reverses a transaction that is not there", "reverses a reversal", "already reversed", "external id is taken")
ATTEMPTS = 5


def refusals(heads: DataFrame, entries: DataFrame, accounts: DataFrame, standing: DataFrame) -> DataFrame:
    """(transaction_id, reason) of the transactions of a batch that cannot be posted.

    ``heads``: transaction_id, reverses_id, external_id; ``entries``: transaction_id, account_id, amount, currency; ``accounts``: account_id,
    currency; ``standing``: the heads posted before.  Of several in a batch that reverse one transaction, or bring one external id, the
    first by transaction_id may stand.
    """
    own = accounts.select("account_id", F.col("currency").alias("own_currency"), F.lit(True).alias("known"))
    legs = entries.join(own, "account_id", "left")
    sums = legs.groupBy("transaction_id", "currency").agg(
        F.sum("amount").alias("rest"), F.count("*").alias("n"), F.max(F.col("known").isNull()).alias("unknown"), F.max(F.coalesce(F.col("currency") != F.col("own_currency"), F.lit(False))).alias("foreign"))
    each = sums.groupBy("transaction_id").agg(F.max(F.col("rest") != 0).alias("unbalanced"), F.sum("n").alias("n"), F.max("unknown").alias("unknown"), F.max("foreign").alias("foreign"))
    targets = standing.select(F.col("transaction_id").alias("reverses_id"), F.lit(True).alias("there"), F.col("reverses_id").isNotNull().alias("is_reversal"))
    gone = standing.filter("reverses_id is not null").select("reverses_id", F.lit(True).alias("gone")).distinct()
    taken = standing.filter("external_id is not null").select("external_id", F.lit(True).alias("taken")).distinct()
    turn = lambda c: F.when(F.col(c).isNotNull(), F.row_number().over(Window.partitionBy(c, F.when(F.col(c).isNull(), F.col("transaction_id"))).orderBy("transaction_id")))  # noqa: E731  nulls do not meet
    asked = heads.select("transaction_id", "reverses_id", "external_id").withColumns({"nth_reversal": turn("reverses_id"), "nth_external": turn("external_id")})
    # most heads reverse nothing and bring no id: they are spread by their own, and meet nothing, or all of them went to one task
    spread = asked.join(each, "transaction_id", "left").withColumns({"target": F.coalesce("reverses_id", "transaction_id"), "name": F.coalesce("external_id", F.col("transaction_id").cast("string"))})
    met = spread
    for right, key, own in ((targets, "target", "reverses_id"), (gone, "target", "reverses_id"), (taken, "name", "external_id")):
        right = right.withColumnRenamed(own, "right_key")
        met = met.join(right, (F.col(key) == F.col("right_key")) & F.col(own).isNotNull(), "left").drop("right_key")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reverses = F.col("reverses_id").isNotNull()
    tests: list[Column] = [F.coalesce("n", F.lit(0)) < 2, yes("unknown"), yes("foreign"), yes("unbalanced"), reverses & ~yes("there"), reverses & yes("is_reversal"),
                           reverses & (yes("gone") | (F.col("nth_reversal") > 1)), F.col("external_id").isNotNull() & (yes("taken") | (F.col("nth_external") > 1))]
    first = F.coalesce(*(F.when(t, F.lit(r)) for t, r in zip(tests, REASONS, strict=True)))
    return met.select("transaction_id", first.alias("reason")).filter("reason is not null")


def _held(store: Store, version: int) -> DataFrame:
    """Heads that stand at a version; none in a store without any."""
    try:
        return store.read("transactions", version)
    except KeyError:
        return store.spark.createDataFrame([], "transaction_id long, reverses_id long, external_id string")


def post(store: Store, heads: DataFrame, entries: DataFrame, accounts: DataFrame) -> int:
    """Append a batch, all or nothing; raises with the first refusals.  A batch that another commit overtakes is checked again."""
    for _ in range(ATTEMPTS):
        version = store.version()
        refused = refusals(heads, entries, accounts, _held(store, version)).orderBy("transaction_id").limit(5).collect()
        if refused:
            raise LedgerError("; ".join(f"{r['transaction_id']}: {r['reason']}" for r in refused))
        try:
            return store.commit({"transactions": heads, "entries": entries}, follows=version)
        except Conflict:
            continue
    raise Conflict(f"overtaken {ATTEMPTS} times")


def reverse(store: Store, asked: DataFrame, accounts: DataFrame) -> int:
    """Post reversals of ``asked`` (transaction_id, new_id, booked_on): entries of the other sign, which name what they reverse."""
    held, legs = store.read("transactions").drop("version"), store.read("entries").drop("version")
    known = asked.withColumnRenamed("transaction_id", "reverses_id")
    same = [c for c in held.columns if c not in ("transaction_id", "reverses_id", "external_id", "booked_on")]
    was = held.select(F.col("transaction_id").alias("reverses_id"), *same)
    heads = known.join(was, "reverses_id", "left").select(F.col("new_id").alias("transaction_id"), "reverses_id", F.lit(None).cast("string").alias("external_id"), "booked_on", *same)
    missing = known.join(was, "reverses_id", "left_anti").orderBy("reverses_id").limit(5).collect()
    if missing:
        raise LedgerError("; ".join(f"{r['reverses_id']}: {REASONS[4]}" for r in missing))
    entries = legs.join(known.select(F.col("reverses_id").alias("transaction_id"), "new_id"), "transaction_id").withColumn("amount", (-F.col("amount")).cast("decimal(28,10)")).drop("transaction_id").withColumnRenamed("new_id", "transaction_id")
    return post(store, heads, entries.select(legs.columns), accounts)


def posting_refusals(ledger: Ledger) -> DataFrame:
    """All transactions posted once more, with a fault of one kind in every fiftieth, against those that stand."""
    of = F.col("transaction_id") % 50
    heads = ledger.base_transactions.select(
        (F.col("transaction_id") + F.lit(5_000_000_000)).alias("transaction_id"), F.when(of == 5, F.col("transaction_id") + 5).when(of == 6, -F.col("transaction_id")).when(of == 7, F.col("transaction_id") + F.lit(1_000_000_000)).alias("reverses_id"),
        F.when(of == 8, F.col("external_id")).alias("external_id"))
    own = F.startswith("account_id", F.lit("C"))
    entries = ledger.base_entries.filter((of != 4) | own).select(
        (F.col("transaction_id") + F.lit(5_000_000_000)).alias("transaction_id"), F.when((of == 2) & own, F.lit("missing")).otherwise(F.col("account_id")).alias("account_id"),
        F.when((of == 1) & own, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(28,10)").alias("amount"), F.when((of == 3) & own, F.lit("XXX")).otherwise(F.col("currency")).alias("currency"))
    return refusals(heads, entries, ledger.accounts, ledger.transactions)


ORACLES = {
    "posting_refusals": """
        WITH heads AS (SELECT transaction_id AS id, transaction_id + 5000000000 AS transaction_id, CASE transaction_id % 50 WHEN 5 THEN transaction_id + 5 WHEN 6 THEN -transaction_id WHEN 7 THEN transaction_id + 1000000000 END AS reverses_id,
                CASE WHEN transaction_id % 50 = 8 THEN external_id END AS external_id FROM {base_transactions}),
        legs AS (SELECT transaction_id AS id, CASE WHEN transaction_id % 50 = 2 AND account_id LIKE 'C%' THEN 'missing' ELSE account_id END AS account_id,
                CASE WHEN transaction_id % 50 = 1 AND account_id LIKE 'C%' THEN amount + 1 ELSE amount END AS amount, CASE WHEN transaction_id % 50 = 3 AND account_id LIKE 'C%' THEN 'XXX' ELSE currency END AS currency
            FROM {base_entries} WHERE transaction_id % 50 <> 4 OR account_id LIKE 'C%'),
        told AS (SELECT l.id, count(*) AS n, bool_or(a.account_id IS NULL) AS unknown, bool_or(coalesce(l.currency <> a.currency, false)) AS outside FROM legs l LEFT JOIN {accounts} a ON a.account_id = l.account_id GROUP BY l.id),
        rests AS (SELECT DISTINCT id FROM (SELECT id, currency FROM legs GROUP BY id, currency HAVING sum(amount) <> 0) r),
        reasons AS (SELECT h.transaction_id, CASE WHEN coalesce(n, 0) < 2 THEN 'fewer than two entries' WHEN unknown THEN 'unknown account' WHEN outside THEN 'entry not in its account''s currency' WHEN r.id IS NOT NULL THEN 'does not balance'
                WHEN h.reverses_id IS NOT NULL AND t.transaction_id IS NULL THEN 'reverses a transaction that is not there' WHEN t.reverses_id IS NOT NULL THEN 'reverses a reversal'
                WHEN h.reverses_id IN (SELECT reverses_id FROM {transactions} WHERE reverses_id IS NOT NULL) THEN 'already reversed'
                WHEN h.external_id IN (SELECT external_id FROM {transactions} WHERE external_id IS NOT NULL) THEN 'external id is taken' END AS reason
            FROM heads h LEFT JOIN told USING (id) LEFT JOIN rests r USING (id) LEFT JOIN {transactions} t ON t.transaction_id = h.reverses_id)
        SELECT transaction_id, reason FROM reasons WHERE reason IS NOT NULL""",
}
QUERIES = {"posting_refusals": posting_refusals}
