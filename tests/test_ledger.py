import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import trigram_similarity
from ledgerloom.operators import ledger as ops
from ledgerloom.operators import matching, rules
from ledgerloom.plans.bridge import Ledger

DATA = "/root/testdata/sf0.001"
ENTRY = "transaction_id long, account_id string, amount decimal(28,10), currency string, instrument_id long, quantity decimal(38,18)"


def test_random_balanced_batches_pass_and_perturbed_ones_do_not(spark):
    from decimal import Decimal

    rng = random.Random(3)
    rows = []
    for t in range(200):
        parts = [Decimal(rng.randrange(-10**6, 10**6)) / 100 for _ in range(rng.randrange(1, 5))]
        rows += [(t, "A", p, "EUR", None, None) for p in [*parts, -sum(parts)]]
    entries = spark.createDataFrame(rows, ENTRY)
    accounts = spark.createDataFrame([("A", "EUR")], "account_id string, currency string")
    transactions = spark.range(200).withColumnRenamed("id", "transaction_id")
    ops.validate(transactions, entries, accounts)
    with pytest.raises(ops.Unbalanced):
        ops.validate(transactions, entries.union(spark.createDataFrame([(5, "A", Decimal(1), "EUR", None, None)], ENTRY)), accounts)
    with pytest.raises(ops.TooFewEntries):
        ops.validate(spark.range(201).withColumnRenamed("id", "transaction_id"), entries, accounts)
    with pytest.raises(ops.CurrencyMismatch):
        ops.validate(transactions, entries, spark.createDataFrame([("A", "USD")], "account_id string, currency string"))
    with pytest.raises(ops.InconsistentHolding):
        ops.validate(transactions, entries.union(spark.createDataFrame([(5, "A", Decimal(0), "EUR", 1, None)], ENTRY)), accounts)


def test_pages_are_clamped(spark):
    book = Ledger(spark, DATA)
    last = ops.page_of(book, ops.Filters(kind="deposit"), page=10**6, per_page=1000)
    assert last.page == last.pages and last.rows.count() == (last.count - 1) % 200 + 1
    assert ops.page_of(book, ops.Filters(kind="none")).pages == 1


def sequential_verdicts(asks, rows):
    """Each candidate in turn against all rows, as plainly as it can be told."""
    rows = sorted(rows, key=lambda r: (r["booked_on"], r["transaction_id"]))
    by_id = {}
    for r in rows:
        if r["external_id"] is not None:
            k = (r["household_id"], r["external_id"])
            if k not in by_id or r["transaction_id"] < by_id[k]["transaction_id"]:
                by_id[k] = r
    taken, out = set(), {}
    for c in sorted(asks, key=lambda c: c["source_id"]):
        if c["external_id"] is not None:
            hit = by_id.get((c["household_id"], c["external_id"]))
            out[c["source_id"]] = ("certain", hit["transaction_id"]) if hit else ("new", None)
        else:
            free = [r for r in rows if r["household_id"] == c["household_id"] and r["transaction_id"] not in taken]
            hit, verdict = next((r for r in free if c["hash"] in r["keys"]), None), "certain"
            if hit is None:
                verdict, shaped = "probable", [r for r in free if r["shape"] == c["shape"]]
                gap = lambda r: abs((r["booked_on"] - c["booked_on"]).days)  # noqa: B023, E731
                hit = next((r for r in shaped if gap(r) == 0), None)
                if hit is None:
                    near = [r for r in shaped if gap(r) <= 3 and c["label"] and r["label"] and matching.similar(c["label"], r["label"]) >= 0.7]
                    hit = min(near, key=gap, default=None)
            out[c["source_id"]] = (verdict, hit["transaction_id"]) if hit else ("new", None)
        if hit:
            taken.add(hit["transaction_id"])
    return out


def test_verdicts_against_a_sequential_model(spark):
    """On the given tables, and on random worlds where identifiers clash across shapes, rows are few and claims cross."""
    book = Ledger(spark, DATA)
    digest = matching.dedupe_hash(F.col("booked_on"), F.col("shape"), F.col("label"))
    asks = [r.asDict() for r in matching.candidates(book).withColumn("hash", digest).collect()]
    rows = [r.asDict() for r in matching._open_rows(book).withColumn("keys", F.array(digest)).collect()]
    got = {r["source_id"]: (r["verdict"], r["transaction_id"]) for r in matching.duplicate_verdicts(book).collect()}
    by_household = {}
    for kind, items in (("asks", asks), ("rows", rows)):
        for x in items:
            by_household.setdefault(x["household_id"], {"asks": [], "rows": []})[kind].append(x)
    want = {}
    for h in by_household.values():
        want |= sequential_verdicts(h["asks"], h["rows"])
    assert got == want and {"new", "certain", "probable"} == {v for v, _ in got.values()}

    rng = random.Random(8)
    day = lambda: datetime.date(2026, 1, 1) + datetime.timedelta(rng.randrange(14))
    labels = ["", "MARCHE NORD", "MARCHE NORT", "GARE CENTRALE", "GARE CENTRAL", "OTHER"]
    asks, rows = [], []
    for household in range(60):
        name = lambda: f"id{rng.randrange(6)}" if rng.random() < 0.4 else None
        for _ in range(10):
            asks.append((household, len(asks), day(), name(), f"s{rng.randrange(3)}", rng.choice(labels)))
        ids = [f"id{k}" for k in range(6)]
        rng.shuffle(ids)
        for k in range(9):
            rows.append((household, 1000 + len(rows), day(), ids[k] if k < 4 else None, f"s{rng.randrange(3)}", rng.choice(labels)))
    schema = "household_id long, {} long, booked_on date, external_id string, shape string, label string"
    left = spark.createDataFrame(asks, schema.format("source_id")).withColumn("hash", digest)
    right = spark.createDataFrame(rows, schema.format("transaction_id")).withColumn("keys", F.array(digest))
    got = {r["source_id"]: (r["verdict"], r["transaction_id"]) for r in matching.verdicts(left, right).collect()}
    assert got == sequential_verdicts([r.asDict() for r in left.collect()], [r.asDict() for r in right.collect()])


def test_verdicts_of_one_amount_paid_for_years_and_of_many_amounts(spark):
    """One stretch of 12,000 candidates, and 30,000 stretches of one: neither takes time by pairs or by groups."""
    digest = matching.dedupe_hash(F.col("booked_on"), F.col("shape"), F.col("label"))
    day = lambda n: F.date_add(F.lit("2000-01-01").cast("date"), n.cast("int"))
    ids = spark.range(42_000)
    shape = F.when(F.col("id") < 12_000, "daily").otherwise(F.concat(F.lit("s"), F.col("id").cast("string")))
    one = ids.select(F.lit(1).cast("long").alias("household_id"), day(F.floor(F.col("id") / 4)).alias("booked_on"), shape.alias("shape"), F.lit(None).cast("string").alias("external_id"), F.concat(F.lit("LABEL "), (F.col("id") % 4).cast("string")).alias("label"), "id").withColumn("hash", digest)
    begin = time.time()
    got = matching.verdicts(one.withColumnRenamed("id", "source_id"), one.withColumn("keys", F.array("hash")).withColumnRenamed("id", "transaction_id"))
    assert got.filter("verdict = 'certain' and transaction_id = source_id").count() == 42_000 and time.time() - begin < 30


def test_similarity_in_python_is_that_of_columns(spark):
    pairs = [("MARCHE NORD", "MARCHE NORT"), ("A", "A B"), ("", "X"), ("GARE", "GARE CENTRALE"), ("AA AA", "AA")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(F.round(trigram_similarity(F.col("a"), F.col("b")), 6)).collect()]
    assert got == [matching.similar(a, b) for a, b in pairs]


def test_patterns_lose_accents_and_what_the_jvm_cannot_run_matches_nothing(spark):
    lines = spark.createDataFrame([("Marche\u0301 du Port", "asset"), ("MARCHÉ", "asset"), ("Ñandú", "asset"), (None, "asset")], "description string, classification string").selectExpr("*", "cast(1 as decimal(28,10)) as amount", "'k' as kind", "'a' as account_id")
    hit = lambda pattern: [r["decision"] is not None for r in rules.decide(lines, [rules.Rule("r", 1, pattern, category="c")]).collect()]
    assert hit("marché") == [True, True, False, False] and hit("(?i)ÑANDU") == [False, False, True, False]
    assert hit("(?P<n>marche)") == [False] * 4 and hit("(unclosed") == [False] * 4 and hit("m" * 201) == [False] * 4


def test_rules_refuse_no_effect_and_no_condition():
    with pytest.raises(ValueError):
        rules.Rule("x", 1, "a")
    with pytest.raises(ValueError):
        rules.Rule("x", 1, category="c")


def test_shipped_rules_only_fill(spark):
    lines = spark.createDataFrame([("Café du Port", "1", "asset"), ("Café", "1", "equity")], "description string, amount string, classification string").selectExpr("*", "cast(amount as decimal(28,10)) as amount_", "'k' as kind", "'a' as account_id").drop("amount").withColumnRenamed("amount_", "amount")
    found = rules.decide(lines, [rules.Rule("s", 1, "cafe", category="shipped", counterparty="C", shipped=True), rules.Rule("h", 9, "port", category="own", tags=("t",))])
    a, b = (r["decision"] for r in found.orderBy("classification").collect())
    assert (a["category"], a["rule_id"], a["counterparty"], a["tags"]) == ("own", "h", "C", ["t"]) and b is None


def test_binding_prefers_a_candidates_own_account(spark):
    asks = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "ordinal int, label string")
    binding = spark.createDataFrame([("x", "A")], "label string, account_id string")
    own = spark.createDataFrame([(2, "B")], "ordinal int, account_id string")
    got = {r["ordinal"]: (r["account_id"], r["problem"]) for r in matching.bind_accounts(asks, binding, own).collect()}
    assert got == {1: ("A", None), 2: ("B", None), 3: (None, "no account for y")}


def test_labels_of_a_pair_are_cut_once_and_equal_ones_not(spark):
    pairs = [("CARTE LAC", "CARTE LAC"), ("", ""), (" ", " "), ("A", " A"), ("CARTE LAC", "CARTE LAIT"), ("", "A"), (None, "A"), (None, None)]
    df = spark.createDataFrame(pairs, "a string, b string").select(trigram_similarity(F.col("a"), F.col("b")).alias("score"))
    assert [r["score"] for r in df.collect()] == [1.0, 0.0, 0.0, 1.0, 8 / 13, 0.0, None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2


def test_near_pairs_meet_on_all_days_once_and_with_fewer_than_three_copies_of_a_candidate(spark):
    days = [datetime.date(1969, 12, 15) + datetime.timedelta(days=n) for n in range(34)]
    asks = spark.createDataFrame([(1, "s", k, d, "L") for k, d in enumerate(days)], "household_id long, shape string, source_id long, booked_on date, label string")
    rows = spark.createDataFrame([(1, "s", 100 + k, d, "L") for k, d in enumerate(days)], "household_id long, shape string, transaction_id long, booked_on date, label string")
    got = sorted(map(tuple, matching.near_pairs(asks, rows).collect()))
    assert got == sorted((a, 100 + b, abs(a - b), 1.0) for a in range(34) for b in range(34) if abs(a - b) <= 3)
    window, span, copies = matching.WINDOW_DAYS, matching.SPAN_DAYS, range(-800, 800)
    assert sum((n + window) // span - (n - window) // span + 1 for n in copies) == 1.75 * len(copies)
