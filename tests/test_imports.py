from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import imports
from ledgerloom.operators.ledger import CurrencyMismatch, LedgerError
from ledgerloom.operators.rules import Rule
from ledgerloom.operators.store import Store

CANDIDATE = "ordinal long, account string, booked_on date, kind string, description string, counterparty string, external_id string, amount decimal(28,10), currency string"
ROW = "household_id long, transaction_id long, booked_on date, external_id string, shape string, label string, keys array<string>"


def _file(spark):
    d = lambda day: date(2026, 1, day)
    return spark.createDataFrame([
        (1, "main", d(5), "withdrawal", "CARTE Marché 12345", None, None, Decimal("-10"), "EUR"), (2, "main", d(5), "withdrawal", "CARTE Marché 12345", None, None, Decimal("-10"), "EUR"),
        (3, "main", d(6), "deposit", "Pay", None, "x1", Decimal("99.5"), "EUR"), (4, "side", d(7), "deposit", None, None, None, Decimal("1"), "EUR")], CANDIDATE)


def test_an_import_from_candidates_to_a_version(spark, tmp_path):
    accounts = spark.createDataFrame([("A", "EUR", "asset"), ("B", "EUR", "asset"), ("X", "EUR", "equity")], "account_id string, currency string, classification string")
    binding = spark.createDataFrame([("main", "A"), ("EXTERNAL", "X")], "label string, account_id string")
    none = spark.createDataFrame([], "ordinal long, account_id string")
    with pytest.raises(LedgerError):
        imports.bound(_file(spark), binding, none)
    ready = imports.bound(_file(spark), binding, spark.createDataFrame([(4, "B")], "ordinal long, account_id string"))
    store, rules = Store(spark, str(tmp_path / "s")), [Rule("h1", 1, "marche", category="groceries", tags=("food",))]
    first = imports.preview(3, ready, spark.createDataFrame([], ROW))
    assert {r["verdict"] for r in first.collect()} == {"new"}
    assert imports.commit(store, imports.deltas(1, 3, ready, first, accounts, rules), accounts) == 1
    assert store.read("transactions").count() == 4 and store.read("entries").agg(F.sum("amount")).first()[0] == 0
    assert {(r["transaction_id"], r["account_id"], r["category"]) for r in store.read("decisions").collect()} == {(1_000_001, "A", "groceries"), (1_000_002, "A", "groceries")}
    # the same file again: each row is one that is there, and no key is written twice
    keys = store.read("keys").select("transaction_id", "hash")
    held = store.read("transactions").join(keys.groupBy("transaction_id").agg(F.collect_list("hash").alias("keys")), "transaction_id")
    shapes = ready.select((F.lit(1_000_000) + F.col("ordinal")).alias("transaction_id"), "shape", F.col("folded").alias("label"))
    rows = held.join(shapes, "transaction_id").select("household_id", "transaction_id", "booked_on", "external_id", "shape", "label", "keys")
    again = imports.preview(3, ready, rows)
    assert {(r["ordinal"], r["verdict"], r["transaction_id"]) for r in again.collect()} == {(k, "certain", 1_000_000 + k) for k in (1, 2, 3, 4)}
    parts = imports.deltas(2, 3, ready, again, accounts, rules, keys)
    assert parts["keys"].count() == 0 and parts["transactions"].count() == 0 and parts["imports"].first()["written"] == 0
    # another way to write a row leaves its key on that row
    other = ready.filter("ordinal = 3").withColumn("hash", F.lit("other"))
    merged = imports.deltas(2, 3, other, again, accounts, [], keys)["keys"].collect()
    assert [(r["transaction_id"], r["hash"]) for r in merged] == [(1_000_003, "other")]
    # a refused import leaves nothing
    with pytest.raises(CurrencyMismatch):
        imports.commit(store, imports.deltas(3, 3, ready, first, accounts.withColumn("currency", F.lit("USD")), rules), accounts.withColumn("currency", F.lit("USD")))
    assert store.version() == 1
