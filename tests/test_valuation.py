"""Lots, costs, values as of a day, returns, refreshed balances and exposure against plain loops."""

import random
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal

import pytest

from ledgerloom.operators import valuation as v
from ledgerloom.operators.ledger import LedgerError

DAY = date(2026, 1, 1)
TRADES = "key string, trade_id long, day date, quantity decimal(28,6), amount double"


def trades(spark, seed, keys=12, n=40):
    rng, out = random.Random(seed), []
    for k in range(keys):
        held = Decimal(0)
        for _ in range(rng.randrange(1, n)):
            q = Decimal(rng.randrange(1, 400)) / 8
            if k % 4 == 0 and rng.random() < 0.1 or held >= q and rng.random() < 0.45:
                q = held if rng.random() < 0.2 and held > 0 else q
                held, q = held - q, -q
            else:
                held += q
            out.append((f"k{k}", len(out), DAY + timedelta(rng.randrange(3) + len(out) // 3), q, float(abs(q)) * rng.uniform(1, 9)))
    rng.shuffle(out)
    return out, spark.createDataFrame([*out, ("k0", 10_000, DAY, Decimal(0), 0.0), ("only", 10_001, DAY, Decimal(-1), 0.0)], TRADES)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lots_are_taken_first_in_first_out(spark, seed):
    rows, df = trades(spark, seed)
    by_key, want = defaultdict(list), []
    for r in [*rows, ("only", 10_001, DAY, Decimal(-1), 0.0)]:
        by_key[r[0]].append(r)
    for key, listed in by_key.items():
        listed.sort(key=lambda r: (r[2], r[1]))
        lots, found, short = [], [], False
        for _, trade, _, q, _ in listed:
            if q > 0:
                lots.append([trade, q])
                continue
            need = -q
            while need and lots:
                take = min(need, lots[0][1])
                found.append((key, trade, lots[0][0], take, None))
                need, lots[0][1] = need - take, lots[0][1] - take
                if not lots[0][1]:
                    lots.pop(0)
            short = short or need > 0
        want += [(key, t, None, -q, "sold more than was held") for _, t, _, q, _ in listed if q < 0] if short else found
    got = [tuple(r) for r in v.fifo_lots(df).collect()]
    assert sorted(got, key=str) == sorted([(k, s, b, q.quantize(Decimal("0.000001")), p) for k, s, b, q, p in want], key=str)


def test_average_costs_follow_the_order_of_trades(spark):
    rows, df = trades(spark, 5)
    by_key, want = defaultdict(list), {}
    for r in [*rows, ("k0", 10_000, DAY, Decimal(0), 0.0), ("only", 10_001, DAY, Decimal(-1), 0.0)]:
        by_key[r[0]].append(r)
    for listed in by_key.values():
        held = cost = 0.0
        for _, trade, _, q, amount in sorted(listed, key=lambda r: (r[2], r[1])):
            q = float(q)
            held, cost = (held + q, cost + amount) if q > 0 else (0.0, 0.0) if held + q <= 0 else (held + q, cost * (held + q) / held)
            want[trade] = (held, cost, cost / held if held else 0.0)
    for r in v.average_costs(df).collect():
        assert (r["held"], r["cost"], r["average"]) == pytest.approx(want[r["trade_id"]])
    assert v.average_costs(df.limit(0)).count() == 0 and v.fifo_lots(df.limit(0)).count() == 0


def test_values_as_of_a_day(spark):
    rng = random.Random(7)
    known = [(f"k{rng.randrange(5)}", DAY + timedelta(rng.randrange(200)), float(rng.randrange(1000))) for _ in range(120)]
    asked = [(f"k{rng.randrange(6)}", DAY + timedelta(rng.randrange(-20, 260)), k) for k in range(400)] + [(None, DAY, 900), ("k1", None, 901)]
    got = {r["n"]: (r["value"], r["value_on"], r["estimated"]) for r in v.as_of(spark.createDataFrame(asked, "key string, day date, n long"), spark.createDataFrame(known, "key string, day date, value double")).collect()}
    assert len(got) == len(asked)
    for key, day, n in asked:
        if key is None or day is None:
            continue
        before = [(d, x) for k, d, x in known if k == key and d <= day]
        want = (None, None, None)
        if before:
            d, x = max(before)
            want = (x, d, (day - d).days > 7)
        assert got[n] == want


def test_refreshed_balances_are_those_worked_out_anew(spark):
    rng = random.Random(8)
    make = lambda n: [(f"a{rng.randrange(6)}", DAY + timedelta(rng.randrange(60)), Decimal(rng.randrange(-900, 900))) for _ in range(n)]
    schema = "account_id string, day date, amount decimal(28,10)"
    held = make(80)
    daily = v.daily_balances(spark.createDataFrame(held, schema))
    for commit in (make(1), make(3), [("new", DAY, Decimal(5))], make(15), []):
        late = spark.createDataFrame(commit, schema)
        cells = v.refreshed_cells(daily, late)
        touched = {a: min(d for b, d, _ in commit if b == a) for a, _, _ in commit}
        assert all(r["day"] >= touched[r["account_id"]] for r in cells.collect())
        daily = spark.createDataFrame(v.with_cells(daily, cells).collect(), daily.schema)
        held += commit
        assert sorted(daily.collect()) == sorted(v.daily_balances(spark.createDataFrame(held, schema)).collect())


def test_rates_leave_no_residual(spark):
    rng = random.Random(9)
    rows = [(f"k{k}", DAY + timedelta(30 * i), -float(rng.randrange(50, 200))) for k in range(20) for i in range(rng.randrange(1, 9))]
    rows += [(f"k{k}", DAY + timedelta(400 + 7 * k), float(rng.randrange(100, 3000))) for k in range(20)]
    rows += [("known", DAY, -100.0), ("known", DAY + timedelta(365), 110.0), ("double", DAY, -50.0), ("double", DAY, -50.0), ("double", DAY + timedelta(730), 400.0), ("none", DAY, 5.0), ("none", DAY + timedelta(9), 5.0)]
    got = {r["key"]: (r["rate"], r["residual"]) for r in v.internal_rate(spark.createDataFrame(rows, "key string, day date, flow double")).collect()}
    assert got["known"][0] == pytest.approx(0.1) and got["double"][0] == pytest.approx(1.0) and got["none"] == (None, None)
    assert all(abs(residual) < 1e-12 for key, (_, residual) in got.items() if key != "none") and len(got) == 23


def test_returns_of_known_periods(spark):
    values = spark.createDataFrame([("a", DAY, 0.0, 100.0), ("a", DAY + timedelta(10), 110.0, 50.0), ("a", DAY + timedelta(30), 144.0, 0.0), ("b", DAY, 0.0, 5.0)], "key string, day date, before double, flow double")
    assert {r["key"]: round(r["twr"], 12) for r in v.time_weighted(values).collect()} == {"a": round(1.1 * 0.9 - 1, 12), "b": 0.0}
    ends = spark.createDataFrame([("a", DAY, DAY + timedelta(30), 100.0, 144.0), ("b", DAY, DAY, 0.0, 5.0)], "key string, from_day date, to_day date, from_value double, to_value double")
    got = {r["key"]: r["dietz"] for r in v.modified_dietz(values.select("key", "day", "flow"), ends).collect()}
    assert got["a"] == pytest.approx((144 - 100 - 50) / (100 + 50 * 20 / 30)) and got["b"] is None


def test_exposure_is_that_of_all_paths_and_circles_are_refused(spark):
    rng = random.Random(10)
    edges = [(f"n{a}", f"n{b}", rng.random()) for a in range(12) for b in range(a + 1, 16) if rng.random() < 0.3] + [("n0", "n1", 0.25), ("n0", "n1", 0.25)]
    graph = defaultdict(list)
    for a, b, w in edges:
        graph[a].append((b, w))

    def walk(node):
        out = defaultdict(float)
        for b, w in graph[node]:
            for leaf, x in (walk(b) if b in graph else {b: 1.0}).items():
                out[leaf] += w * x
        return out

    frame = lambda rows: spark.createDataFrame(rows, "fund string, held string, weight double")
    roots = spark.createDataFrame([("n0",), ("n3",), ("n15",)], "root string")
    got = {(r["root"], r["held"]): r["weight"] for r in v.exposure(frame(edges), roots).collect()}
    want = {(root, leaf): w for root in ("n0", "n3") for leaf, w in walk(root).items()}
    assert got == pytest.approx(want)
    assert v.exposure(frame([]), roots).count() == 0
    for circle in ([("n0", "n0", 1.0)], [("n0", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5)]):
        with pytest.raises(LedgerError, match="circle"):
            v.exposure(frame(circle), roots)
