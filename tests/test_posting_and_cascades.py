"""Commits that meet, refusals, reversals, what goes with a deleted row, rule sets from JSON, and the data source."""

import json
import threading
from decimal import Decimal

import pyarrow as pa
import pytest

from ledgerloom.operators import cascades, posting, rules
from ledgerloom.operators.ledger import LedgerError
from ledgerloom.operators.store import Conflict, Store
from ledgerloom.sources import readers

HEADS = "transaction_id long, reverses_id long, external_id string, booked_on string, kind string"
ENTRIES = "transaction_id long, account_id string, amount decimal(28,10), currency string"


def test_commits_at_once_take_versions_of_their_own(spark, tmp_path):
    root, got, failed = str(tmp_path / "s"), [], []

    def run(k):
        try:
            got.append(Store(spark, root).commit({"a": spark.createDataFrame([(k,)], "id long")}))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    held = Store(spark, root)
    assert not failed and sorted(got) == [1, 2, 3, 4, 5, 6] and held.version() == 6
    assert sorted(r["id"] for r in held.read("a").collect()) == list(range(6)) and {r["version"] for r in held.read("a").collect()} == set(range(1, 7))
    with pytest.raises(Conflict):
        held.commit({"a": spark.range(3)}, follows=5)
    assert held.version() == 6 and held.commit({"a": spark.createDataFrame([(9, "x")], "id long, more string")}, follows=6) == 7
    assert [tuple(r) for r in held.read("a").filter("version > 5 and id = 9").collect()] == [(9, "x", 7)] and held.read("a", 6).columns == ["id", "version"]
    assert len(list((tmp_path / "s/data/a").iterdir())) == 7 and not list((tmp_path / "s/manifest").glob(".draft-*"))


def test_a_version_is_claimed_once(spark, tmp_path):
    held = Store(spark, str(tmp_path / "s"))
    held.commit({"a": spark.range(1)})
    assert not held._claimed(1, "") and held.version() == 1 and held.read("a").count() == 1


def test_posting_refuses_and_reverses(spark, tmp_path):
    accounts = spark.createDataFrame([("a", "EUR"), ("b", "EUR"), ("d", "USD")], "account_id string, currency string")
    held = Store(spark, str(tmp_path / "s"))

    def post(*heads, legs):
        return posting.post(held, spark.createDataFrame([(*h, "2026-01-01", "transfer") for h in heads], HEADS), spark.createDataFrame([(t, a, Decimal(x), c) for t, a, x, c in legs], ENTRIES), accounts)

    assert post((1, None, "x"), (2, None, None), legs=[(1, "a", 5, "EUR"), (1, "b", -5, "EUR"), (2, "a", 1, "EUR"), (2, "b", -1, "EUR")]) == 1
    good = lambda t: [(t, "a", 2, "EUR"), (t, "b", -2, "EUR")]
    for head, legs, reason in (
            ((3, None, None), [(3, "a", 0, "EUR")], "fewer than two"), ((3, None, None), [], "fewer than two"), ((3, None, None), [(3, "a", 1, "EUR"), (3, "z", -1, "EUR")], "unknown account"), ((3, None, None), [(3, "a", 1, "EUR"), (3, "d", -1, "EUR")], "currency"),
            ((3, None, None), [(3, "a", 1, "EUR"), (3, "b", -2, "EUR")], "balance"), ((3, 99, None), good(3), "not there"), ((3, None, "x"), good(3), "taken")):
        with pytest.raises(LedgerError, match=reason):
            post(head, legs=legs)
    with pytest.raises(LedgerError, match="already reversed"):
        post((3, 1, None), (4, 1, None), legs=good(3) + good(4))
    assert held.version() == 1
    ask = lambda *rows: spark.createDataFrame(rows, "transaction_id long, new_id long, booked_on string")
    assert posting.reverse(held, ask((1, 10, "2026-02-01")), accounts) == 2
    back = {r["account_id"]: r["amount"] for r in held.read("entries").filter("transaction_id = 10").collect()}
    assert back == {"a": -5, "b": 5} and held.read("transactions").filter("transaction_id = 10").first()["kind"] == "transfer"
    for row, reason in (((1, 11, "2026-02-01"), "already reversed"), ((77, 11, "2026-02-01"), "not there"), ((10, 11, "2026-02-01"), "reverses a reversal")):
        with pytest.raises(LedgerError, match=reason):
            posting.reverse(held, ask(row), accounts)


def test_reversals_at_once_leave_one(spark, tmp_path, monkeypatch):
    accounts = spark.createDataFrame([("a", "EUR"), ("b", "EUR")], "account_id string, currency string")
    held = Store(spark, str(tmp_path / "s"))
    legs = [(1, "a", Decimal(1), "EUR"), (1, "b", Decimal(-1), "EUR")]
    posting.post(held, spark.createDataFrame([(1, None, None, "2026-01-01", "transfer")], HEADS), spark.createDataFrame(legs, ENTRIES), accounts)
    commit, overtaken = Store.commit, []

    def late(self, deltas, follows=None):
        if not overtaken:  # between the checks and the commit, another reversal is posted
            overtaken.append(True)
            posting.reverse(Store(spark, held.root), spark.createDataFrame([(1, 20, "2026-01-02")], "transaction_id long, new_id long, booked_on string"), accounts)
        return commit(self, deltas, follows)

    monkeypatch.setattr(Store, "commit", late)
    with pytest.raises(LedgerError, match="already reversed"):
        posting.reverse(held, spark.createDataFrame([(1, 21, "2026-01-02")], "transaction_id long, new_id long, booked_on string"), accounts)
    assert held.read("transactions").filter("reverses_id = 1").count() == 1


def test_references_are_followed_in_order(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "categories": make([("c1",), ("c2",)], "id string"), "tags": make([("t1",), ("t2",)], "id string"), "rules": make([("r1", "c1"), ("r2", "c2")], "id string, category_id string"),
        "rules_tags": make([("r1", "t1"), ("r2", "t1"), ("r2", "t2")], "rule_id string, tag_id string"), "transactions": make([("x",), ("y",)], "id string"),
        "transactions_tags": make([("x", "t1"), ("y", "t2")], "transaction_id string, tag_id string"),
        "entries": make([("e1", "x", "c1", "r1"), ("e2", "x", "c2", "r1"), ("e3", "y", "c2", "r2"), ("e4", "y", None, None)], "id string, transaction_id string, category_id string, rule_id string"),
    }
    rows = lambda frames: {n: sorted(map(tuple, f.collect()), key=str) for n, f in frames.items() if f.count()}
    gone = lambda *ids: make([(i,) for i in ids], "id string")
    removed, changed = cascades.deleted(tables, {"categories": gone("c1", "none")})
    assert rows(removed) == {"categories": [("c1",)], "rules": [("r1",)], "rules_tags": [("r1", "t1")]} and rows(changed) == {"entries": [("e1", "x", None, None), ("e2", "x", "c2", None)]}
    removed, changed = cascades.deleted(tables, {"tags": gone("t1"), "rules": gone("r2")})
    assert rows(removed) == {"tags": [("t1",)], "rules": [("r2",)], "rules_tags": [("r1", "t1"), ("r2", "t1"), ("r2", "t2")], "transactions_tags": [("x", "t1")]} and rows(changed) == {"entries": [("e3", "y", "c2", None)]}
    removed, changed = cascades.deleted(tables, {"transactions": gone("y"), "categories": gone("c2")})
    assert rows(removed)["entries"] == [("e3",), ("e4",)] and rows(changed) == {"entries": [("e2", "x", None, "r1")]}
    removed, changed = cascades.deleted(tables, {})
    assert not removed and not changed
    with pytest.raises(ValueError, match="circle"):
        cascades.in_order((cascades.Reference("a", "b_id", "b", True), cascades.Reference("b", "a_id", "a", True)))


def test_rule_sets_are_checked_whole(spark):
    rule = lambda **over: {"id": "super-markets", "name": " Shops ", "priority": 10, "when": {"descriptionMatches": "(?i)march[eé]"}, "then": {"category": "groceries"}} | over
    told = lambda *listed, **over: json.dumps({"country": "FR", "$comment": "x", "rules": list(listed)} | over)
    second = rule(id="b", priority=2, when={"amountBetween": ["-10.5", "0"]}, then={"counterparty": "Bank"}, stopOnMatch=True)
    got = rules.parse_rule_set(told(rule(), second), {"groceries"})
    assert [(r.id, r.priority, r.pattern, r.at_least, r.at_most, r.category, r.counterparty, r.stop, r.shipped) for r in got.rules] == [
        ("fr/b", 2, None, "-10.5", "0", None, "Bank", True, True), ("fr/super-markets", 10, "(?i)march[eé]", None, None, "groceries", None, False, True)]
    assert got.categories == ["groceries"] and got.names["fr/super-markets"] == "Shops"
    lines = spark.createDataFrame([("LE MARCHE", Decimal(5), "asset", "withdrawal", "a"), ("other", Decimal(-3), "asset", "withdrawal", "a")], "description string, amount decimal(28,10), classification string, kind string, account_id string")
    decided = [(r["decision"]["category"], r["decision"]["counterparty"]) for r in rules.decide(lines, list(got.rules)).orderBy("description").collect()]
    assert decided == [("groceries", None), (None, "Bank")]
    broken = [
        ("[]", "not an object"), ("{", "not JSON"), (told(rule(), country="fr"), "country"), (told(), "no array"), (told(rule(), extra=1), "unknown field extra"), (told(rule(colour=1)), "unknown field colour"), (told(rule(), rule()), "share the id"),
        (told(rule(id="Not Kebab")), "kebab"), (told(rule(name=" ")), "name"), (told(rule(priority=1.5)), "priority"), (told(rule(priority=True)), "priority"), (told(rule(when=None)), "not an object"), (told(rule(when={})), "no condition"),
        (told(rule(when={"accountId": "a"})), "unknown field accountId"), (told(rule(when={"descriptionMatches": "(open"})), "no expression"), (told(rule(when={"descriptionMatches": "x" * 300})), "no expression"), (told(rule(when={"amountBetween": ["2", "1"]})), "in order"),
        (told(rule(when={"amountBetween": [1, 2]})), "amounts"), (told(rule(then={"category": "unknown"})), "no category"), (told(rule(then={"counterparty": ""})), "no name"), (told(rule(then={})), "no effect"), (told(rule(then={"tags": []})), "unknown field tags")]
    for text, reason in broken:
        with pytest.raises(rules.RuleSetError, match=reason):
            rules.parse_rule_set(text, {"groceries"})


def test_stored_conditions_are_used_or_left(spark):
    assert rules.parse_conditions({"descriptionMatches": "a", "amountBetween": ["-1", "2"], "accountId": "x"}) == {"pattern": "a", "at_least": "-1", "at_most": "2", "account": "x"}
    assert rules.parse_conditions({"accountId": "x", "later": True}) == {"account": "x"}
    for raw in (None, [], {}, {"later": 1}, {"descriptionMatches": ""}, {"descriptionMatches": "(a"}, {"descriptionMatches": None, "accountId": "x"}, {"amountBetween": ["1"]}, {"amountBetween": ["2", "1"]}, {"amountBetween": ["a", "b"]}, {"accountId": ""}):
        assert rules.parse_conditions(raw) is None


def test_statements_are_found_wherever_ranges_cut(tmp_path, monkeypatch):
    parts = [f":20:{k}\n:25:A\n:61:2601{k % 28 + 1:02d}C{k},00NTRF//{'é' * (k % 5)}\n" for k in range(60)]
    raw = ("head\n" + "".join(parts)).encode()
    want = [(raw.index(p.encode()), p.encode()) for p in parts]
    for block in (7, 64, 1 << 20):
        monkeypatch.setattr(readers, "BLOCK", block)
        for split in (1, 5, 33, 500, 1 << 20):
            got = [s for begin in range(0, len(raw), split) for s in readers.statements_in(pa.PythonFile(pa.BufferReader(raw)), begin, min(begin + split, len(raw)))]
            assert got == want
    assert list(readers.statements_in(pa.PythonFile(pa.BufferReader(b"")), 0, 0)) == [] and list(readers.statements_in(pa.PythonFile(pa.BufferReader(b"x:20:\n")), 0, 6)) == []


def test_the_source_reads_folders_and_streams(spark, tmp_path):
    inbox = tmp_path / "inbox"
    (inbox / "sub").mkdir(parents=True)
    one = ":20:A\n:25:{a}\n:60F:C260101EUR0,00\n:61:2601050105C{n},00NTRFX//r\n:86:café\n"
    (inbox / "a.sta").write_text("".join(one.format(a=k, n=k) for k in range(1, 5)))
    (inbox / "sub/b.sta").write_bytes(one.format(a="b", n=9).encode("cp1252"))
    (inbox / "_SUCCESS").write_text(":20:no\n")
    got = readers.read_folder(spark, str(inbox), splitBytes="40")
    assert sorted((r["account"], r["amount"], r["description"], r["problem"]) for r in got.collect()) == [("1", 1, "café", None), ("2", 2, "café", None), ("3", 3, "café", None), ("4", 4, "café", None), ("b", 9, "café", None)]
    assert spark.read.format("mt940").load(str(inbox / "a.sta")).rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("mt940").load(str(tmp_path / "none")).count()

    def run():
        stream = spark.readStream.format("mt940").load(str(inbox)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "seen")).trigger(availableNow=True).start(str(tmp_path / "out"))
        stream.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 5
    (inbox / "c.sta").write_text(one.format(a="c", n=1) * 2)
    assert run() == 7


def test_heads_that_reverse_nothing_are_spread(spark):
    """Nulls meet nothing, so no task may hold all of them."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    try:
        [spark.conf.set(n, v) for n, v in zip(names, ("false", "-1"), strict=True)]
        heads = spark.range(4000).selectExpr("id as transaction_id", "cast(if(id = 7, 1, null) as long) as reverses_id", "cast(null as string) as external_id")
        standing = spark.range(3).selectExpr("id as transaction_id", "cast(null as long) as reverses_id", "cast(id as string) as external_id")
        got = posting.refusals(heads, spark.createDataFrame([], ENTRIES), spark.createDataFrame([], "account_id string, currency string"), standing)
        assert got.selectExpr("spark_partition_id() as p").distinct().count() > 1 and got.count() == 4000
    finally:
        [spark.conf.set(n, v) for n, v in zip(names, before, strict=True)]
