"""Changes to accounts, categories and imports as rows to append; the store's newest row of a key is its state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import classification, trimmed
from ledgerloom.operators.ledger import LedgerError

LONGEST_NAME = 120
#: The accounts that a new household starts with.
STARTERS = (("cash", "Cash"), ("savings", "Savings"), ("opening_balance", "Opening balance"))


def new_accounts(asked: DataFrame) -> DataFrame:
    """Account rows from (household_id, account_id, name, kind, currency); refuses names that are blank or too long, and odd currencies."""
    clean = asked.withColumn("name", trimmed(F.regexp_replace("name", r"\s+", " "))).withColumn("currency", F.upper("currency"))
    bad = clean.filter((F.col("name") == "") | (F.length("name") > LONGEST_NAME) | ~F.col("currency").rlike("^[A-Z]{3,10}$"))
    if not bad.isEmpty():
        raise LedgerError("an account needs a name of 1 to 120 characters and a currency code")
    return clean.withColumns({"classification": classification(F.col("kind")), "closed_on": F.lit(None).cast("date")})


def closed_accounts(balances: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows that close accounts (account_id, closed_on); refuses where a balance is not 0."""
    held = asked.join(balances.select("account_id", "balance"), "account_id")
    if not held.filter("balance <> 0").isEmpty():
        raise LedgerError("an account closes at a balance of 0")
    return held.select("account_id", "closed_on")


def household_seed(spark: SparkSession, household_id: int, name: str, currency: str) -> dict[str, DataFrame]:
    """What creating a household appends: itself, its root portfolio and its first accounts."""
    return {
        "households": spark.createDataFrame([(household_id, name, currency)], "household_id long, name string, base_currency string"),
        "portfolios": spark.createDataFrame([(household_id, "home")], "household_id long, path string"),
        "accounts": new_accounts(spark.createDataFrame([(household_id, f"{household_id}:{k}", n, k, currency) for k, n in STARTERS], "household_id long, account_id string, name string, kind string, currency string")),
    }


def standard_categories(existing: DataFrame, shipped: DataFrame) -> DataFrame:
    """Rows to append so that every shipped (key, name) exists: a category of that name takes the key on, else a new one."""
    missing = shipped.join(existing.filter("key is not null").select("key"), "key", "left_anti")
    free = existing.filter("key is null").groupBy(F.lower("name").alias("folded")).agg(F.min("id").alias("id"))
    return missing.withColumn("folded", F.lower("name")).join(free, "folded", "left").select(F.coalesce("id", F.concat(F.lit("std:"), F.col("key"))).alias("id"), "key", "name", F.col("id").isNotNull().alias("adopted"))


def recategorised(lines: DataFrame, choice: DataFrame) -> DataFrame:
    """Rows that give a transaction's lines a category by hand, (transaction_id, category_id): equity lines stay, and no rule is named any more."""
    return lines.filter("classification <> 'equity'").join(choice, "transaction_id").select("transaction_id", "account_id", "category_id", F.lit(None).cast("string").alias("rule_id"))


def rolled_back(transactions: DataFrame, entries: DataFrame, import_id: int, new_id: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Reversals, and their entries, of all transactions of an import that still stand."""
    gone = transactions.filter("reverses_id is not null").select(F.col("reverses_id").alias("transaction_id"))
    standing = transactions.filter((F.col("import_id") == import_id) & F.col("reverses_id").isNull()).join(gone, "transaction_id", "left_anti")
    fresh = F.col("transaction_id") + 1_000_000_000 if new_id is None else new_id
    heads = standing.withColumn("reverses_id", F.col("transaction_id")).withColumn("transaction_id", fresh).withColumn("external_id", F.lit(None).cast("string"))
    negated = {"amount": (-F.col("amount")).cast("decimal(28,10)"), "quantity": (-F.col("quantity")).cast("decimal(38,18)")}
    return heads, entries.join(standing.select("transaction_id"), "transaction_id", "left_semi").withColumns(negated).withColumn("transaction_id", fresh)


def renamed_accounts(accounts: DataFrame, asks: DataFrame) -> DataFrame:
    """Changed rows of ``asks`` (account_id, name): names are cleaned and refused as those of new accounts, and unknown accounts are refused."""
    named = asks.select("account_id", trimmed(F.regexp_replace("name", r"\s+", " ")).alias("name"))
    if not named.filter((F.col("name") == "") | (F.length("name") > LONGEST_NAME)).isEmpty() or not named.join(accounts, "account_id", "left_anti").isEmpty():
        raise LedgerError("an account needs a name, and must be known")
    return accounts.drop("name").join(named, "account_id").select(accounts.columns)


def reopened_accounts(accounts: DataFrame, asks: DataFrame) -> DataFrame:
    """Changed rows of the accounts of ``asks`` (account_id) that are closed: open again."""
    return accounts.filter("closed_on is not null").join(asks.select("account_id"), "account_id", "left_semi").withColumn("closed_on", F.lit(None).cast("date"))


def without_category(categories: DataFrame, lines: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Categories without those of ``gone`` (id), and the lines that bore them, now without category and rule."""
    bare = lines.join(gone.select(F.col("id").alias("category_id")), "category_id", "left_semi").withColumns({"category_id": F.lit(None).cast("string"), "rule_id": F.lit(None).cast("string")})
    return categories.join(gone.select("id"), "id", "left_anti"), bare.select(lines.columns)


def memberships(members: DataFrame, households: DataFrame, user: str) -> DataFrame:
    """(household_id, name, role) of the households that a user belongs to, by name."""
    return members.filter(F.col("user_id") == user).join(households.select("household_id", "name"), "household_id").select("household_id", "name", "role").orderBy("name", "household_id")
