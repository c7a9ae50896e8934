"""An import as one flow: candidates are bound to accounts, compared with the ledger, and what is new is committed with keys and rules as one version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import dedupe_hash, normalise_label, plain_decimal
from ledgerloom.operators.ledger import LedgerError, validate
from ledgerloom.operators.matching import bind_accounts, merge_keys, verdicts
from ledgerloom.operators.rules import Rule, decide
from ledgerloom.operators.store import Store
from ledgerloom.sources.statements import EXTERNAL


def bound(candidates: DataFrame, binding: DataFrame, overrides: DataFrame) -> DataFrame:
    """Candidates (ordinal, account, amount, ...) with the ids of both their accounts, their entries' shape, label and hash; refused where one has no account.

    ``binding`` (label, account_id) holds a row for the outside's label too; ``overrides`` (ordinal, account_id) is for single candidates.
    """
    own = bind_accounts(candidates.withColumnRenamed("account", "label"), binding, overrides)
    if not own.filter("account_id is null").isEmpty():
        raise LedgerError("a candidate has no account")
    outside = binding.filter(F.col("label") == EXTERNAL).agg(F.min("account_id").alias("outside_id"))
    leg = lambda account, amount: F.concat_ws(":", account, plain_decimal(amount))
    both = F.array_sort(F.array(leg(F.col("account_id"), F.col("amount")), leg(F.col("outside_id"), -F.col("amount"))))
    told = own.drop("problem").crossJoin(outside).withColumn("shape", F.array_join(both, "|")).withColumn("folded", F.coalesce(normalise_label(F.col("description")), F.lit("")))
    return told.withColumn("hash", dedupe_hash(F.col("booked_on"), F.col("shape"), F.col("folded")))


def preview(household_id: int, candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """(ordinal, verdict, transaction_id) of bound candidates against the household's standing rows, as ``verdicts`` takes these."""
    asks = candidates.select(F.lit(household_id).cast("long").alias("household_id"), F.col("ordinal").cast("long").alias("source_id"), "booked_on", "external_id", "shape", F.col("folded").alias("label"), "hash")
    return verdicts(asks, rows).withColumnRenamed("source_id", "ordinal")


def deltas(import_id: int, household_id: int, candidates: DataFrame, decided: DataFrame, accounts: DataFrame, rules: list[Rule], keys: DataFrame | None = None, new_id: Column | None = None) -> dict[str, DataFrame]:
    """What an import appends: itself, new transactions, their entries, keys of new and of merged rows that ``keys`` lacks, and the rules' decisions.

    ``decided`` is the preview as a person has confirmed it: what is ``new`` is written, and any other candidate
    leaves its key on the row that it is.
    """
    told = candidates.join(decided.select("ordinal", "verdict", F.col("transaction_id").alias("held_id")), "ordinal")
    fresh = F.lit(import_id).cast("long") * 1_000_000 + F.col("ordinal") if new_id is None else new_id
    new = told.filter("verdict = 'new'").withColumn("transaction_id", fresh)
    heads = new.select("transaction_id", F.lit(household_id).cast("long").alias("household_id"), "booked_on", "kind", "currency", "description", "counterparty", "external_id", F.lit(import_id).cast("long").alias("import_id"), F.lit(None).cast("long").alias("reverses_id"))
    side = lambda account, amount: F.struct(account.alias("account_id"), amount.cast("decimal(28,10)").alias("amount"))
    legs = F.array(side(F.col("account_id"), F.col("amount")), side(F.col("outside_id"), -F.col("amount")))
    entries = new.select("transaction_id", "currency", F.explode(legs).alias("e")).select(
        "transaction_id", "e.account_id", "e.amount", "currency", F.lit(None).cast("long").alias("instrument_id"), F.lit(None).cast("decimal(38,18)").alias("quantity"))
    of_merged = told.filter("verdict <> 'new' and held_id is not null").select(F.col("held_id").alias("transaction_id"), "hash").distinct()
    all_keys = merge_keys(new.select("transaction_id", "hash"), of_merged)
    lines = entries.join(heads.select("transaction_id", "kind", "description", "counterparty"), "transaction_id").join(accounts.select("account_id", "classification"), "account_id")
    decisions = decide(lines, rules).filter("decision is not null").select("transaction_id", "account_id", "decision.category", "decision.rule_id", "decision.counterparty", "decision.tags") if rules else None
    run = heads.agg(F.count("*").alias("written")).select(F.lit(import_id).cast("long").alias("import_id"), F.lit(household_id).cast("long").alias("household_id"), "written")
    out = {"imports": run, "transactions": heads, "entries": entries, "keys": all_keys if keys is None else all_keys.join(keys, ["transaction_id", "hash"], "left_anti")}
    return out | ({"decisions": decisions} if decisions is not None else {})


def commit(store: Store, parts: dict[str, DataFrame], accounts: DataFrame) -> int:
    """Check what an import appends and make all of it visible at once, as the version that is returned; refused whole where an invariant breaks."""
    validate(parts["transactions"], parts["entries"], accounts)
    return store.commit(parts)
