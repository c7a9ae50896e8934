"""Balances, net worth and what derives from them.  Entries are summed before they meet the accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.bridge import Ledger

MONEY = "decimal(38,10)"


def account_balances(ledger: Ledger) -> DataFrame:
    """One row an account, those without entries included."""
    sums = ledger.entries.groupBy("account_id").agg(F.sum("amount").alias("total"))
    return ledger.accounts.join(sums, "account_id", "left").select(
        "household_id", "account_id", "name", "kind", "classification", "currency", "closed_on", F.coalesce("total", F.lit(0).cast(MONEY)).cast(MONEY).alias("balance")
    )


def net_worth(ledger: Ledger) -> DataFrame:
    """Per household: balances in its base currency, equity left out."""
    own = account_balances(ledger).filter("classification <> 'equity'").join(ledger.households.select("household_id", "base_currency"), "household_id")
    return own.filter("currency = base_currency").groupBy("household_id", "base_currency").agg(F.sum("balance").cast(MONEY).alias("net_worth"))


def _open(ledger: Ledger) -> DataFrame:
    return account_balances(ledger).filter("closed_on is null")


def asset_debt_totals(ledger: Ledger) -> DataFrame:
    total = lambda kind: F.sum(F.when(F.col("classification") == kind, F.col("balance")).otherwise(F.lit(0).cast(MONEY))).cast(MONEY)
    return _open(ledger).filter("classification <> 'equity'").groupBy("household_id", "currency").agg(
        total("asset").alias("assets"), F.abs(total("liability")).alias("debts"), F.count("*").alias("accounts"))


def allocation_by_kind(ledger: Ledger) -> DataFrame:
    """Positive asset balances by kind, with their share of the household's total in per cent."""
    by_kind = _open(ledger).filter("classification = 'asset' and balance > 0").groupBy("household_id", "currency", "kind").agg(F.sum("balance").cast(MONEY).alias("balance"))
    whole = F.sum("balance").over(Window.partitionBy("household_id", "currency"))
    return by_kind.withColumn("share", F.round(F.col("balance").cast("double") / whole.cast("double") * 100, 4))


def account_share(ledger: Ledger) -> DataFrame:
    """Each open account's share of its classification's total; 0 where that is 0."""
    whole = F.sum("balance").over(Window.partitionBy("household_id", "currency", "classification")).cast("double")
    return _open(ledger).filter("classification <> 'equity'").select(
        "household_id", "account_id", "balance", F.coalesce(F.round(F.try_divide(F.col("balance").cast("double") * 100, whole), 2), F.lit(0.0)).alias("share"))


def subtree_balances(ledger: Ledger) -> DataFrame:
    """Balances summed up the tree of portfolio paths: each region holds its nations, the root all of them."""
    worth = net_worth(ledger).join(ledger.households.select("household_id", "path"), "household_id")
    parts = F.split("path", "[.]")
    nodes = worth.withColumn("node", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))))
    return nodes.groupBy("node", "base_currency").agg(F.sum("net_worth").cast(MONEY).alias("net_worth"), F.count("*").alias("households"))


def daily_running_balance(ledger: Ledger) -> DataFrame:
    """Per household account and day: movement and balance so far."""
    days = (
        ledger.entries.filter(F.startswith("account_id", F.lit("C"))).join(ledger.transactions.select("transaction_id", "booked_on"), "transaction_id")
        .groupBy("account_id", "booked_on").agg(F.sum("amount").cast(MONEY).alias("movement"))
    )
    return days.withColumn("balance", F.sum("movement").over(Window.partitionBy("account_id").orderBy("booked_on")).cast(MONEY))


def reconciliation_gap(ledger: Ledger) -> DataFrame:
    """Ledger balance against the closing balance that a statement of all original entries would report."""
    stated = ledger.base_entries.groupBy("account_id").agg(F.sum("amount").cast(MONEY).alias("closing"))
    return account_balances(ledger).join(stated, "account_id").select("account_id", "balance", "closing", (F.col("closing") - F.col("balance")).cast(MONEY).alias("gap"))


ORACLES = {
    "account_balances": """SELECT a.household_id, a.account_id, name, kind, classification, currency, closed_on, cast(coalesce(total, 0) AS decimal(38,10)) AS balance
        FROM {accounts} a LEFT JOIN (SELECT account_id, sum(amount) AS total FROM {entries} GROUP BY 1) s ON a.account_id = s.account_id""",
    "net_worth": """SELECT a.household_id, h.base_currency, cast(coalesce(sum(amount), 0) AS decimal(38,10)) AS net_worth FROM {accounts} a JOIN {households} h ON a.household_id = h.household_id
        LEFT JOIN {entries} e ON e.account_id = a.account_id WHERE classification <> 'equity' AND a.currency = base_currency GROUP BY 1, 2""",
    "asset_debt_totals": """SELECT household_id, currency, cast(sum(CASE WHEN classification = 'asset' THEN balance ELSE 0 END) AS decimal(38,10)) AS assets,
        cast(abs(sum(CASE WHEN classification = 'liability' THEN balance ELSE 0 END)) AS decimal(38,10)) AS debts, count(*) AS accounts
        FROM (SELECT a.household_id, a.account_id, a.currency, classification, coalesce(sum(amount), 0) AS balance FROM {accounts} a LEFT JOIN {entries} e ON e.account_id = a.account_id
              WHERE closed_on IS NULL AND classification <> 'equity' GROUP BY 1, 2, 3, 4) x GROUP BY 1, 2""",
    "allocation_by_kind": """SELECT household_id, currency, kind, balance, round(cast(balance AS double) / cast(sum(balance) OVER (PARTITION BY household_id, currency) AS double) * 100, 4) AS share FROM
        (SELECT household_id, currency, kind, cast(sum(balance) AS decimal(38,10)) AS balance FROM (SELECT a.household_id, a.account_id, a.currency, kind, coalesce(sum(amount), 0) AS balance FROM {accounts} a
            LEFT JOIN {entries} e ON e.account_id = a.account_id WHERE closed_on IS NULL AND classification = 'asset' GROUP BY 1, 2, 3, 4) x WHERE balance > 0 GROUP BY 1, 2, 3) y""",
    "account_share": """SELECT household_id, account_id, balance, coalesce(round(cast(balance AS double) * 100 / nullif(cast(sum(balance) OVER (PARTITION BY household_id, currency, classification) AS double), 0), 2), 0) AS share
        FROM (SELECT a.household_id, a.account_id, a.currency, classification, cast(coalesce(sum(amount), 0) AS decimal(38,10)) AS balance FROM {accounts} a LEFT JOIN {entries} e ON e.account_id = a.account_id
              WHERE closed_on IS NULL AND classification <> 'equity' GROUP BY 1, 2, 3, 4) x""",
    "subtree_balances": """WITH worth AS (SELECT h.path, h.base_currency, h.household_id, coalesce(sum(amount), 0) AS w FROM {accounts} a JOIN {households} h ON a.household_id = h.household_id
            LEFT JOIN {entries} e ON e.account_id = a.account_id WHERE classification <> 'equity' AND a.currency = base_currency GROUP BY 1, 2, 3),
        nodes AS (SELECT DISTINCT path AS node FROM worth UNION SELECT DISTINCT split_part(path, '.', 1) || '.' || split_part(path, '.', 2) FROM worth UNION SELECT 'home')
        SELECT node, base_currency, cast(sum(w) AS decimal(38,10)) AS net_worth, count(*) AS households FROM nodes JOIN worth ON path = node OR starts_with(path, node || '.') GROUP BY 1, 2""",
    "daily_running_balance": """SELECT account_id, booked_on, movement, cast(sum(movement) OVER (PARTITION BY account_id ORDER BY booked_on) AS decimal(38,10)) AS balance FROM
        (SELECT account_id, booked_on, cast(sum(amount) AS decimal(38,10)) AS movement FROM {entries} e JOIN {transactions} t ON e.transaction_id = t.transaction_id WHERE account_id LIKE 'C%' GROUP BY 1, 2) d""",
    "reconciliation_gap": """SELECT e.account_id, b.balance, c.closing, cast(c.closing - b.balance AS decimal(38,10)) AS gap FROM {accounts} e
        JOIN (SELECT account_id, cast(sum(amount) AS decimal(38,10)) AS balance FROM {entries} GROUP BY 1) b ON b.account_id = e.account_id
        JOIN (SELECT account_id, cast(sum(amount) AS decimal(38,10)) AS closing FROM {base_entries} GROUP BY 1) c ON c.account_id = e.account_id""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
