from datetime import date
from decimal import Decimal

import pytest

from ledgerloom.functions.text import rounded
from ledgerloom.operators import changes, ledger, rules
from ledgerloom.plans.bridge import Ledger


def test_accounts_open_and_close(spark):
    seed = changes.household_seed(spark, 1, "Home", "eur")
    assert {(r["kind"], r["classification"], r["currency"]) for r in seed["accounts"].collect()} == {("cash", "asset", "EUR"), ("savings", "asset", "EUR"), ("opening_balance", "equity", "EUR")}
    with pytest.raises(ledger.LedgerError):
        changes.new_accounts(spark.createDataFrame([(1, "a", " ", "cash", "EUR")], "household_id long, account_id string, name string, kind string, currency string"))
    held = spark.createDataFrame([("a", Decimal(0)), ("b", Decimal(1))], "account_id string, balance decimal(28,10)")
    ask = lambda a: spark.createDataFrame([(a, date(2026, 1, 1))], "account_id string, closed_on date")
    assert changes.closed_accounts(held, ask("a")).count() == 1
    with pytest.raises(ledger.LedgerError):
        changes.closed_accounts(held, ask("b"))


def test_shipped_categories_adopt_names(spark):
    have = spark.createDataFrame([("1", None, "food"), ("2", "rent", "Rent")], "id string, key string, name string")
    shipped = spark.createDataFrame([("food", "Food"), ("rent", "Rent"), ("fun", "Fun")], "key string, name string")
    assert {tuple(r) for r in changes.standard_categories(have, shipped).collect()} == {("1", "food", "Food", True), ("std:fun", "fun", "Fun", False)}


def test_a_choice_by_hand_spares_equity(spark):
    lines = spark.createDataFrame([(1, "a", "asset"), (1, "x", "equity")], "transaction_id long, account_id string, classification string")
    got = changes.recategorised(lines, spark.createDataFrame([(1, "c")], "transaction_id long, category_id string")).collect()
    assert [(r["account_id"], r["category_id"], r["rule_id"]) for r in got] == [("a", "c", None)]


def test_rolling_back_twice_adds_nothing(spark):
    book = Ledger(spark, "/root/testdata/sf0.001")
    heads, entries = changes.rolled_back(book.transactions, book.entries, 11)
    assert heads.count() > 0 and ledger.unbalanced(entries).count() == 0
    both = book.transactions.unionByName(heads)
    assert changes.rolled_back(both, book.entries.unionByName(entries), 11)[0].count() == 0


def test_accounts_are_renamed_and_reopened(spark):
    have = spark.createDataFrame([("a", "Old", date(2026, 1, 1)), ("b", "B", None)], "account_id string, name string, closed_on date")
    assert [tuple(r) for r in changes.renamed_accounts(have, spark.createDataFrame([("b", " New ")], "account_id string, name string")).collect()] == [("b", "New", None)]
    for ask in (("b", "  "), ("z", "Z")):
        with pytest.raises(ledger.LedgerError):
            changes.renamed_accounts(have, spark.createDataFrame([ask], "account_id string, name string"))
    assert [tuple(r) for r in changes.reopened_accounts(have, spark.createDataFrame([("a",), ("b",)], "account_id string")).collect()] == [("a", "Old", None)]


def test_a_category_leaves_its_lines_bare(spark):
    categories = spark.createDataFrame([("1", "Food"), ("2", "Rent")], "id string, name string")
    lines = spark.createDataFrame([(1, "1", "r"), (2, "2", "r")], "transaction_id long, category_id string, rule_id string")
    left, bare = changes.without_category(categories, lines, spark.createDataFrame([("1",)], "id string"))
    assert [tuple(r) for r in left.collect()] == [("2", "Rent")] and [tuple(r) for r in bare.collect()] == [(1, None, None)]


def test_memberships_provenance_and_eligibility(spark):
    members = spark.createDataFrame([("u", 2, "viewer"), ("u", 1, "owner"), ("v", 1, "admin")], "user_id string, household_id long, role string")
    homes = spark.createDataFrame([(1, "Zoe's"), (2, "Ann's")], "household_id long, name string")
    assert [tuple(r) for r in changes.memberships(members, homes, "u").collect()] == [(2, "Ann's", "viewer"), (1, "Zoe's", "owner")]
    decided = spark.createDataFrame([(1, "h1"), (2, "fr/bakery"), (3, None)], "transaction_id long, rule_id string")
    own = spark.createDataFrame([("h1", "Mine")], "id string, name string")
    assert {tuple(r)[1:] for r in rules.provenance(decided, own).select("transaction_id", "source", "country", "rule_name").collect()} == {("household", None, "Mine"), ("shipped", "fr", "bakery"), (None, None, None)}
    lines = spark.createDataFrame([(1, None, None), (2, "c", None), (3, "c", "r")], "transaction_id long, category_id string, rule_id string")
    assert {r["transaction_id"] for r in rules.eligible(lines).collect()} == {1, 3}
    shipped = spark.createDataFrame([("x", "food"), ("y", "fun")], "id string, key string")
    assert {(r["id"], r["category_id"]) for r in rules.shipped_categories(shipped, spark.createDataFrame([("7", "food"), ("8", None)], "id string, key string")).collect()} == {("x", "7"), ("y", None)}


def test_filters_by_category_and_tag_and_date_ranges(spark):
    book = Ledger(spark, "/root/testdata/sf0.001")
    ids = [r[0] for r in book.transactions.select("transaction_id").orderBy("transaction_id").limit(3).collect()]
    decided = spark.createDataFrame([(ids[0], "food", ["a", "b"]), (ids[1], "food", ["c"]), (ids[2], "rent", ["a"])], "transaction_id long, category string, tags array<string>")
    pick = lambda **f: {r["transaction_id"] for r in ledger.filtered(book, ledger.Filters(**f), decided).collect()}
    assert pick(category="food") == set(ids[:2]) and pick(tag="a") == {ids[0], ids[2]} and pick(category="food", tag="a") == {ids[0]}
    with pytest.raises(ValueError):
        ledger.filtered(book, ledger.Filters(tag="a"))
    early = spark.createDataFrame([(1, date(2026, 1, 2), date(2026, 1, 1))], "transaction_id long, booked_on date, value_on date")
    with pytest.raises(ledger.DateRange):
        ledger.validate(early, book.entries.limit(0), book.accounts)
    money = spark.createDataFrame([(Decimal("2.345"),), (Decimal("2.355"),), (Decimal("-2.345"),)], "a decimal(28,10)")
    assert [r[0] for r in money.select(rounded(money["a"], 2)).collect()] == [Decimal("2.34"), Decimal("2.36"), Decimal("-2.34")]
