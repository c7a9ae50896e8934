from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException

from ledgerloom.operators import access, store
from ledgerloom.plans.bridge import Ledger
from ledgerloom.sources import shapes


def test_commits_are_whole_and_versions_stay(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "s"))
    assert held.version() == 0
    with pytest.raises(KeyError):
        held.read("a")
    held.commit({"a": spark.createDataFrame([(1, "x")], "id long, name string"), "b": spark.range(2)})
    held.commit({"a": spark.createDataFrame([(1, "y"), (2, "z")], "id long, name string")})
    assert held.version() == 2 and held.read("a").count() == 3 and held.read("a", 1).count() == 1 and held.read("b").count() == 2
    assert {(r["id"], r["name"]) for r in held.latest("a", ["id"]).collect()} == {(1, "y"), (2, "z")}


def test_names_are_taken_once(spark):
    existing = spark.createDataFrame([("7", "Food")], "id string, name string")
    got = {r["name"]: (r["id"], r["is_new"]) for r in store.insert_or_get(existing, spark.createDataFrame([("FOOD",), ("Rent",), ("rent ",), ("",)], "name string")).collect()}
    assert got["FOOD"] == ("7", False) and len(got) == 2


def test_tags_are_replaced(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "transaction_id long, tag string")
    new = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "transaction_id long, tag string")
    assert {tuple(r) for r in store.set_tags(now, new).collect()} == {(1, "x"), (1, "y"), (3, "c")}


def test_a_session_sees_its_household_only(spark):
    book = Ledger(spark, "/root/testdata/sf0.001")
    session = access.bind(book, 3)
    seen = access.visible(session, "transactions")
    assert seen.count() == book.transactions.filter("household_id = 3").count() > 0
    assert access.visible(access.bind(book, None), "transactions").count() == 0
    with pytest.raises(PermissionError):
        access.visible(session, "all_transactions")
    assert {t.name for t in session.catalog.listTables()} == set(access.SECURED)
    with pytest.raises(AnalysisException):
        session.table("all_transactions")
    for name in access.SECURED:
        assert {r[0] for r in session.sql(f"select distinct household_id from {name}").collect()} == {3}
    access.assert_scoped(session)
    spark.range(1).createOrReplaceTempView("everything")
    with pytest.raises(PermissionError):
        access.assert_scoped(spark)
    spark.catalog.dropTempView("everything")


def test_roles(spark):
    actor = lambda role, scope=None: access.Actor(1, role, scope)
    assert access.refusal(actor("owner"), "household:delete", 1) is None and access.refusal(actor("admin"), "household:delete", 1)
    assert access.refusal(actor("viewer"), "transaction:create", 1) and access.refusal(actor("owner"), "household:read", 2)
    assert access.refusal(actor("child", frozenset({"p"})), "account:read", 1) and access.refusal(actor("child", frozenset({"p"})), "account:read", 1, "p") is None
    assert access.at_least("admin", "viewer") and not access.at_least("child", "viewer") and len(access.ACTIONS) == 24
    assert access.grants_table(spark).count() == sum(map(len, access.GRANTS.values()))


def test_header_and_columns(spark):
    rows = [["Name", "X"], ["a", "b"], ["Date", "Label", "Sum", "State"], ["31/01/2026", "l1", "1", "done"], ["01/02/2026", "", "2", "open"], ["02/02/2026", "l3", "3", "done"]]
    df = spark.createDataFrame([("f", k, r) for k, r in enumerate(rows)] + [("g", 0, ["a", "b", "c"])], "path string, pos int, cells array<string>")
    assert {tuple(r) for r in shapes.header_rows(df).collect()} == {("f", 2), ("g", 0)}
    cells = spark.createDataFrame([("f", rows[2][c], r[c]) for r in rows[3:] for c in range(4)], "path string, name string, value string")
    got = {r["name"]: (r["date_order"], r["values"]) for r in shapes.column_shapes(cells).collect()}
    assert got == {"Date": ("dmy", None), "Label": (None, "l1|l3"), "Sum": (None, None), "State": (None, "done|open")}


def test_broker_rows(spark):
    d = Decimal
    schema = "path string, line int, type string, date string, account_type string, currency string, amount decimal(28,10), tax decimal(28,10), shares decimal(38,18)"
    rows = spark.createDataFrame([
        ("f", 2, "TRANSFER_OUT", "d", "A", "EUR", d(-5), None, None), ("f", 3, "TRANSFER_OUT", "d", "A", "EUR", d(-5), None, None), ("f", 4, "TRANSFER_IN", "d", "B", "EUR", d(5), None, None),
        ("f", 5, "BUY", "d", "A", "EUR", d(-100), None, d(2)), ("f", 6, "DIVIDEND", "d", "A", "EUR", d(10), d(-3), None), ("f", 7, "ODD", "d", "A", "EUR", d(1), None, None)], schema)
    pair = shapes.broker_transfers(rows).collect()
    assert [(p["out_line"], p["in_line"], p["from_account"], p["to_account"]) for p in pair] == [(2, 4, "A", "B")]
    entries = shapes.broker_entries(rows.filter("line >= 5"))
    got = [(e["line"], e["kind"], e["account"], e["amount"], e["quantity"]) for e in entries.orderBy("line", "account", "amount").collect()]
    assert got == [(5, "buy", "A", d(-100), None), (5, "buy", "A:SECURITIES", d(100), d(2)), (6, "dividend", "A", d(-3), None), (6, "dividend", "A", d(10), None), (6, "dividend", "EXTERNAL", d(-7), None),
                   (7, "adjustment", "A", d(1), None), (7, "adjustment", "EXTERNAL", d(-1), None)]
    assert {r[1] for r in entries.groupBy("line").sum("amount").collect()} == {d(0)}
