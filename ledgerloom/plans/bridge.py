"""The ledger as views over the given star-schema tables.

The same text runs in Spark SQL and in DuckDB: names in braces are tables or other views.  Entries are the
exception: Spark builds them from one read of the lines, where the text would read these four times.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VIEWS: dict[str, str] = {
    "households": """
        SELECT n_nationkey AS household_id, n_name AS name,
               CASE WHEN n_nationkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS base_currency,
               concat('home.r', cast(n_regionkey AS varchar(4)), '.n', cast(n_nationkey AS varchar(4))) AS path
        FROM {nation}""",
    "accounts": """
        SELECT concat('C', cast(c_custkey AS varchar(20))) AS account_id, c_nationkey AS household_id, c_name AS name,
               CASE c_custkey % 7 WHEN 0 THEN 'cash' WHEN 1 THEN 'savings' WHEN 2 THEN 'securities' WHEN 3 THEN 'loan'
                    WHEN 4 THEN 'credit_card' WHEN 5 THEN 'real_estate' ELSE 'crypto' END AS kind,
               CASE WHEN c_custkey % 7 IN (3, 4) THEN 'liability' ELSE 'asset' END AS classification,
               CASE WHEN c_custkey % 50 = 0 THEN 'GBP' WHEN c_nationkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
               CASE WHEN c_custkey % 41 = 0 THEN DATE '1999-01-01' END AS closed_on
        FROM {customer}
        UNION ALL
        SELECT concat('X', cast(n_nationkey AS varchar(4)), ':', cast(s_suppkey AS varchar(20))), n_nationkey, s_name,
               'opening_balance', 'equity', CASE WHEN n_nationkey % 2 = 0 THEN 'EUR' ELSE 'USD' END, cast(NULL AS date)
        FROM {nation} CROSS JOIN {supplier}""",
    "base_transactions": """
        SELECT o_orderkey AS transaction_id, c_nationkey AS household_id, c_custkey AS custkey,
               cast(o_orderdate AS date) AS booked_on,
               CASE o_orderstatus WHEN 'F' THEN 'withdrawal' WHEN 'O' THEN 'deposit' ELSE 'transfer' END AS kind,
               CASE WHEN c_nationkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
               concat(CASE o_orderkey % 3 WHEN 0 THEN 'CARTE ' WHEN 1 THEN 'PRLV ' ELSE 'VIR ' END,
                      CASE WHEN o_orderkey % 3 = 0 THEN concat(lpad(cast(day(o_orderdate) AS varchar(2)), 2, '0'), '/',
                                lpad(cast(month(o_orderdate) AS varchar(2)), 2, '0'), ' ') ELSE '' END,
                      CASE o_orderkey % 8 WHEN 0 THEN 'Marché Nord' WHEN 1 THEN 'Gare Centrale' WHEN 2 THEN 'Électrique du Lac'
                           WHEN 3 THEN 'Librairie du Port' WHEN 4 THEN 'Pharmacie des Arts' WHEN 5 THEN 'Station Est'
                           WHEN 6 THEN 'Cantine Bleue' ELSE 'Mutuelle Sud' END,
                      ' ', cast(10000 + o_orderkey % 90000 AS varchar(10))) AS description,
               CASE WHEN o_orderkey % 5 = 0 THEN c_name END AS counterparty,
               CASE WHEN o_orderkey % 4 = 0 THEN concat('ext-', cast(o_orderkey AS varchar(20))) END AS external_id,
               o_orderkey % 60 AS import_id
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "transactions": """
        SELECT transaction_id, household_id, custkey, booked_on, kind, currency, description, counterparty, external_id, import_id,
               cast(NULL AS bigint) AS reverses_id
        FROM {base_transactions}
        UNION ALL
        SELECT transaction_id + 1000000000, household_id, custkey, cast(booked_on + INTERVAL 3 DAY AS date), kind, currency,
               concat('Reversal of ', cast(transaction_id AS varchar(20))), cast(NULL AS varchar(50)), cast(NULL AS varchar(50)), import_id, transaction_id
        FROM {base_transactions} WHERE transaction_id % 97 = 0""",
    "base_entries": """
        SELECT l_orderkey AS transaction_id, household_id,
               concat('X', cast(household_id AS varchar(4)), ':', cast(l_suppkey AS varchar(20))) AS account_id,
               cast(CASE kind WHEN 'deposit' THEN -l_extendedprice ELSE l_extendedprice END AS decimal(28, 10)) AS amount,
               currency, l_partkey AS instrument_id, cast(l_quantity AS decimal(38, 18)) AS quantity
        FROM {lineitem} JOIN {base_transactions} ON l_orderkey = transaction_id
        UNION ALL
        SELECT l_orderkey, max(household_id), concat('C', cast(max(custkey) AS varchar(20))),
               cast(-sum(cast(CASE kind WHEN 'deposit' THEN -l_extendedprice ELSE l_extendedprice END AS decimal(28, 10))) AS decimal(28, 10)),
               max(currency), cast(NULL AS bigint), cast(NULL AS decimal(38, 18))
        FROM {lineitem} JOIN {base_transactions} ON l_orderkey = transaction_id GROUP BY l_orderkey""",
    "entries": """
        SELECT transaction_id, household_id, account_id, amount, currency, instrument_id, quantity FROM {base_entries}
        UNION ALL
        SELECT transaction_id + 1000000000, household_id, account_id, cast(-amount AS decimal(28, 10)), currency, instrument_id, -quantity
        FROM {base_entries} WHERE transaction_id % 97 = 0""",
    "statement_lines": """
        SELECT transaction_id AS source_id, household_id, transaction_id % 10 AS variant, currency,
               CASE WHEN transaction_id % 10 = 2 THEN cast(booked_on + INTERVAL 2 DAY AS date) ELSE booked_on END AS booked_on,
               CASE WHEN transaction_id % 10 = 3 THEN 'Inconnu' ELSE description END AS description,
               CASE WHEN transaction_id % 28 = 0 THEN concat('gone-', cast(transaction_id AS varchar(20))) ELSE external_id END AS external_id
        FROM {base_transactions}""",
}
#: Every 97th transaction is reversed by one whose id is so much larger.
REVERSED_EVERY, REVERSAL = 97, 1_000_000_000
MONEY, QUANTITY = "decimal(28,10)", "decimal(38,18)"
TABLES = ("nation", "customer", "supplier", "orders", "lineitem")


class Ledger:
    """The views of one data folder; each is built once, lazily, and stays a plan."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._built = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        if name not in self._built:
            if name in ("base_entries", "entries"):
                self._built[name] = self._entries(reversals=name == "entries")
            else:
                self._built[name] = self.sql(VIEWS[name]) if name in VIEWS else self.table(name)
        return self._built[name]

    def _entries(self, reversals: bool) -> DataFrame:
        """One row a leg: each line's equity account, and with an order's first line the household's own, with the sum of all; each again for a reversal.

        The sum is a window over the order's few lines, by the shuffle that joins lines and orders.
        """
        heads = self.base_transactions.select("transaction_id", "household_id", "custkey", "kind", "currency")
        amount = F.when(F.col("kind") == "deposit", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).cast(MONEY)
        leg = lambda account, sum_, part, size: F.struct(account.alias("account_id"), sum_.cast(MONEY).alias("amount"), part.cast("long").alias("instrument_id"), size.cast(QUANTITY).alias("quantity"))
        outside = F.concat(F.lit("X"), F.col("household_id").cast("string"), F.lit(":"), F.col("l_suppkey").cast("string"))
        own = F.concat(F.lit("C"), F.col("custkey").cast("string"))
        lines = self.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice").join(heads, F.col("l_orderkey") == F.col("transaction_id"))
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
        every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        told = lines.withColumn("amount", amount).withColumn("nth", F.row_number().over(order)).withColumn("total", F.sum("amount").over(every))
        outer = leg(outside, F.col("amount"), F.col("l_partkey"), F.col("l_quantity"))
        both = F.when(F.col("nth") == 1, F.array(outer, leg(own, -F.col("total"), F.lit(None), F.lit(None)))).otherwise(F.array(outer))
        legs = told.select("transaction_id", "household_id", "currency", F.explode(both).alias("leg"))
        if not reversals:
            return legs.select("transaction_id", "household_id", "leg.account_id", "leg.amount", "currency", "leg.instrument_id", "leg.quantity")
        signs = F.when(F.col("transaction_id") % REVERSED_EVERY == 0, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))
        signed = legs.select("*", F.explode(signs).alias("sign"))
        back = F.col("sign") < 0
        return signed.select(
            F.when(back, F.col("transaction_id") + REVERSAL).otherwise(F.col("transaction_id")).alias("transaction_id"), "household_id", "leg.account_id",
            F.when(back, -F.col("leg.amount")).otherwise(F.col("leg.amount")).cast(MONEY).alias("amount"), "currency", "leg.instrument_id",
            F.when(back, -F.col("leg.quantity")).otherwise(F.col("leg.quantity")).cast(QUANTITY).alias("quantity"))

    def sql(self, text: str) -> DataFrame:
        names = {n for n in (*VIEWS, *TABLES) if "{" + n + "}" in text}
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


def oracle(text: str) -> str:
    """DuckDB SQL: ``text`` over the views that it names, as common table expressions."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for n in VIEWS:
            if "{" + n + "}" in sql and n not in needed:
                visit(VIEWS[n])
                needed.append(n)

    visit(text)
    plain = lambda sql: re.sub(r"\{(" + "|".join((*VIEWS, *TABLES)) + r")\}", r"\1", sql)
    ctes = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in needed)
    body = plain(text)
    if not ctes:
        return body
    return f"WITH {ctes}, {body.strip()[5:]}" if body.strip().upper().startswith("WITH ") else f"WITH {ctes} {body}"
